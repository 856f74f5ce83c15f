"""Threshold autoregressions for all pairs at once.

For a sorted regime variable q the regressors z I(q >= tau) and z I(q < tau) are orthogonal, and only sums of z times the
other columns over q < tau depend on tau.  One window of running sums per pair gives the cross-products of every candidate
tau, and the candidates are solved in small batches: rows are never multiplied by the grid.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions import dist, draws
from bazaarlens.operators import coint, features, joins, ranges, unitroot
from bazaarlens.operators.ols import complete, gram, grouped_ols, inverse, restriction_f, unpack
from bazaarlens.operators.unitroot import _head
from bazaarlens.plans.lineage import saved

KEYS, ORDER = ["pair_id"], ["ts"]
ABOVE, BELOW = "above", "below"


def prepare(residual: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, max_lags: int = 4, regime: str = "level", lag: int = 1, value: str = "z", rows: int | None = None) -> DataFrame:
    """dz, z1 (last residual), q (regime variable) and d1..: complete rows of an equilibrium error in ``value``.

    ``regime``: level, the last residual (TAR); or a momentum of F15: standard, moving_average, exponential (M-TAR).
    """
    part = ranges.cut(residual, keys, order, rows, max_lags + 1)
    w = part.window()
    made = part.data.withColumns({"z1": F.lag(value).over(w), "dz": F.col(value) - F.lag(value).over(w)})
    made = part.own(made.withColumns({f"d{j}": F.lag("dz", j).over(w) for j in range(1, max_lags + 1)}))
    if regime == "level":
        made = made.withColumn("q", F.col("z1"))
    else:
        made = features.momentum(made, value, keys, order, regime, lag, name="q", rows=rows)
    return complete(made, ["dz", "z1", "q", *[f"d{j}" for j in range(1, max_lags + 1)]])


def _lag_names(max_lags: int) -> list[str]:
    return [f"d{j}" for j in range(1, max_lags + 1)]


def search(rows: DataFrame, keys: Sequence[str], others: Sequence[str], ys: Sequence[str] = ("dz",), trim: float = 0.15, n_grid: int | None = None, order: Sequence[str] = ORDER, block: int | None = None) -> DataFrame:
    """(keys, threshold, ssr, ssr0, n_obs): the tau of least (summed) squared residuals, and those without a threshold.

    Candidates are the distinct values of q at sorted places [trim n, (1 - trim) n); ``n_grid`` thins them evenly.  ``block``
    rows make one range of a long series in the order of q (see ``ranges``).
    """
    columns = [F.lit(1.0), F.col("z1"), *[F.col(c) for c in others], *[F.col(y) for y in ys]]
    m = len(columns)
    totals = rows.groupBy(*keys).agg(F.count("*").alias("n_obs"), gram(columns).alias("g"))
    part = ranges.cut(rows, keys, ["q", *order], block, 1)
    # of equal values the first has the sums over what is strictly below
    marked = part.own(part.data.withColumns({"prev": F.lag("q").over(part.window()), "i": part.index().cast("long")}), True)
    sums = ranges.running(marked, {f"_b{j}": F.col("z1") * c for j, c in enumerate(columns)}, keys, ["q", *order], block, inclusive=False)
    below = F.array(*[F.coalesce(F.col(f"_b{j}"), F.lit(0.0)) for j in range(m)])
    placed = sums.where("prev is null or prev != q").select(*keys, "q", "i", below.alias("b"))
    found = placed.join(totals, list(keys))
    n = F.col("n_obs")
    inside = (F.col("i") >= F.floor(n * trim)) & (F.col("i") < F.floor(n * (1 - trim)))
    found = found.where(inside)
    if n_grid is not None:
        step = F.greatest(F.lit(1), F.ceil((F.floor(n * (1 - trim)) - F.floor(n * trim)) / n_grid))
        found = found.where((F.col("i") - F.floor(n * trim)) % step == 0)
    k, others_n = m - len(ys) + 1, len(others)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            g = unpack(np.array(frame["g"].tolist(), float), m)
            b = np.array(frame["b"].tolist(), float)
            rest = [0, *range(2, 2 + others_n)]
            # columns: 1, z above, z below, others
            xx = np.zeros((len(frame), k, k))
            place = {0: 0} | {2 + j: 3 + j for j in range(others_n)}
            for r in rest:
                for c in rest:
                    xx[:, place[r], place[c]] = g[:, r, c]
                xx[:, place[r], 2] = xx[:, 2, place[r]] = b[:, r]
                xx[:, place[r], 1] = xx[:, 1, place[r]] = g[:, 1, r] - b[:, r]
            xx[:, 2, 2], xx[:, 1, 1] = b[:, 1], g[:, 1, 1] - b[:, 1]
            inv, good = inverse(xx.copy())
            plain = g[:, : 2 + others_n, : 2 + others_n]
            inv0, good0 = inverse(plain.copy())
            ssr, ssr0 = np.zeros(len(frame)), np.zeros(len(frame))
            for j in range(len(ys)):
                y = 2 + others_n + j
                xy = np.zeros((len(frame), k))
                for r in rest:
                    xy[:, place[r]] = g[:, r, y]
                xy[:, 2], xy[:, 1] = b[:, y], g[:, 1, y] - b[:, y]
                for total, i, x, v in ((ssr, inv, xx, xy), (ssr0, inv0, plain, g[:, : 2 + others_n, y])):
                    beta = np.einsum("nij,nj->ni", i, v)
                    beta += np.einsum("nij,nj->ni", i, v - np.einsum("nij,nj->ni", x, beta))
                    total += g[:, y, y] - 2 * np.einsum("ni,ni->n", beta, v) + np.einsum("ni,nij,nj->n", beta, x, beta)
            out = frame[[*keys, "q", "n_obs"]].assign(ssr=np.where(good & good0 & (frame["n_obs"].to_numpy() > k), ssr, np.nan), ssr0=ssr0)
            yield out.dropna(subset=["ssr"])

    solved = found.mapInPandas(run, f"{_head(rows, keys)}, q double, n_obs long, ssr double, ssr0 double")
    # equal fits to rounding: the smaller threshold
    best = solved.groupBy(*keys).agg(F.min(F.struct("ssr", "q", "ssr0", "n_obs")).alias("m"))
    return best.select(*keys, F.col("m.q").alias("threshold"), F.col("m.ssr").alias("ssr"), F.col("m.ssr0").alias("ssr0"), F.col("m.n_obs").alias("n_obs"))


METHODS = ("grid", "hansen_seo", "adaptive")
FIT = ["model", "threshold", "fixed", "rho_above", "rho_below", "se_above", "se_below", "p_above", "p_below", "const", "f", "p_f", "r2", "adj_r2", "ssr", "aic", "bic", "n_obs", "df", "coef", "cov", "status"]


def fit_at(rows: DataFrame, taus: DataFrame, keys: Sequence[str], max_lags: int, model: str, fixed: bool, y: str = "dz", others: Sequence[str] | None = None) -> DataFrame:
    """The regressions at given thresholds (keys, threshold)."""
    others = _lag_names(max_lags) if others is None else list(others)
    joined = rows.join(taus.select(*keys, "threshold"), list(keys))
    up = F.col("q") >= F.col("threshold")
    xs = {ABOVE: F.when(up, F.col("z1")).otherwise(0.0), BELOW: F.when(up, 0.0).otherwise(F.col("z1"))} | {c: F.col(c) for c in others}
    fits = grouped_ols(joined, keys, y, xs).join(taus.select(*keys, "threshold"), list(keys))
    f = restriction_f(F.col("cov"), F.col("coef"), ["const", *xs], ABOVE, BELOW)
    at = lambda m, n: F.element_at(m, n)
    out = fits.withColumns({"model": F.lit(model), "fixed": F.lit(fixed), "const": at("coef", "const"), "f": f} | {f"{n}_{s}": at(c, s) for n, c in (("rho", "coef"), ("se", "se"), ("p", "p")) for s in (ABOVE, BELOW)})
    return out.withColumn("p_f", dist.f_p("f", F.lit(1.0), "df")).select(*keys, *FIT)


def fit(residual: DataFrame, mode: str = "standard", keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, max_lags: int = 4, trim: float = 0.15, n_grid: int | None = None, fixed_threshold: float | None = None, method: str = "grid", momentum: str = "standard", lag: int = 1, block: int | None = None) -> DataFrame:
    """One row per pair (H7, H17, H21): mode standard, fixed (tau = 0 unless given) or mtar.

    ``method`` (H8-H11): grid takes the thinned grid; hansen_seo and adaptive refine a grid to the best of all order
    statistics, which is what the full search finds.  ``block`` is the number of rows of a range of a long series.
    """
    if mode not in ("standard", "fixed", "mtar"):
        raise ValueError(f"unknown mode {mode}")
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    rows = saved(prepare(residual, keys, order, max_lags, momentum if mode == "mtar" else "level", lag, rows=block))
    least = 2 * (max_lags + 2) + 3
    counts = residual.groupBy(*keys).agg(F.count("*").alias("n_series"))
    fixed = 0.0 if mode == "fixed" and fixed_threshold is None else fixed_threshold
    if fixed is not None:
        taus = rows.select(*keys).distinct().withColumn("threshold", F.lit(float(fixed)))
    else:
        taus = saved(search(rows, keys, _lag_names(max_lags), trim=trim, n_grid=None if method in ("hansen_seo", "adaptive") else n_grid, order=order, block=block))
    names = {"standard": "tar", "fixed": "tar", "mtar": "mtar"}
    out = counts.join(fit_at(rows, taus, keys, max_lags, names[mode], fixed is not None), list(keys), "left")
    return out.withColumn("status", F.when(F.col("n_series") < least, "insufficient_data").otherwise(F.coalesce("status", F.lit("insufficient_data")))).drop("n_series")


def wald(fits: DataFrame) -> DataFrame:
    """(…, wald, df1, df2, p_wald) for equal adjustment."""
    return fits.withColumns({"wald": F.col("f"), "df1": F.lit(1), "df2": F.col("df"), "p_wald": F.col("p_f")})


def likelihood_ratio(residual: DataFrame, fits: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, max_lags: int = 4) -> DataFrame:
    """(keys, lr, p_lr): n ln(SSR without threshold / SSR with), chi-squared with one degree."""
    rows = prepare(residual, keys, order, max_lags)
    plain = grouped_ols(rows, keys, "dz", ["z1", *_lag_names(max_lags)]).select(*keys, F.col("ssr").alias("ssr0"))
    out = fits.select(*keys, "ssr", "n_obs").join(plain, list(keys)).withColumn("lr", F.col("n_obs") * F.log(F.col("ssr0") / F.col("ssr")))
    return out.select(*keys, "lr", dist.chi2_p("lr", F.lit(1.0)).alias("p_lr"))


#: Replicates that one task draws at once.
REPLICATES = 128


def replicated(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], n: int, extra: Sequence[str] = ()) -> DataFrame:
    """(keys, extra, h, v, first, last): a series as one array of rows, and the replicates [first, last) that a task takes.

    A series and its replicates are drawn in numpy from the array, which is sent once per REPLICATES of them: rows are not
    multiplied by the replicates, and no error is fetched by a join.
    """
    series = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, F.array(*[F.col(c).cast("double") for c in columns]).alias("v")))).alias("s"), *[F.first(c).alias(c) for c in extra])
    blocks = series.select(*keys, *extra, F.xxhash64(*keys).alias("h"), F.col("s.v").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(REPLICATES))).alias("first"))
    return blocks.withColumn("last", F.least(F.col("first") + REPLICATES, F.lit(n))).repartition(*keys, "first")


def _projected(basis: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared lengths of the rows of y outside the space of an orthonormal basis."""
    return (y * y).sum(1) - ((y @ basis) ** 2).sum(1)


def _tail(stars: DataFrame, keys: Sequence[str], seen: str, star: str) -> DataFrame:
    """(keys, seen, p_boot, crit, n_boot) of replicates of a statistic."""
    q = F.percentile(star, F.array(F.lit(0.9), F.lit(0.95), F.lit(0.99)))
    crit = F.create_map(F.lit("90%"), q[0], F.lit("95%"), q[1], F.lit("99%"), q[2])
    return stars.groupBy(*keys).agg(F.first(seen).alias(seen), F.avg((F.col(star) > F.col(seen)).cast("double")).alias("p_boot"), crit.alias("crit"), F.count("*").alias("n_boot"))


def bootstrap(residual: DataFrame, fits: DataFrame, n: int = 1000, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, max_lags: int = 4, regime: str = "level", lag: int = 1, kind: str = "nonparametric", base: str = "linear", seed: int = 0) -> DataFrame:
    """(keys, f_obs, p_boot, crit, n_boot): residual bootstrap of F at the fitted threshold.

    Errors come from the linear null (``base`` linear) or from the threshold fit (threshold) around the linear fit; see
    ``draws.errors`` for the kinds.  The regressors stay, so a replicate is a projection on two fixed bases.
    """
    if kind not in ("nonparametric", "wild", "parametric"):
        raise ValueError(f"unknown draws {kind}")
    others = _lag_names(max_lags)
    rows = prepare(residual, keys, order, max_lags, regime, lag).select(*keys, *order, "dz", "z1", "q", *others)
    rows = rows.join(fits.where("status = 'ok'").select(*keys, "threshold", F.col("f").alias("f_obs")), list(keys))
    blocks = replicated(rows, keys, order, ["dz", "z1", "q", *others], n, ["threshold", "f_obs"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.to_dict("records"):
                v = np.stack(r["v"])
                y, z1, lags, one = v[:, 0], v[:, 1], v[:, 3:], np.ones((len(v), 1))
                up = v[:, 2] >= r["threshold"]
                null = np.linalg.qr(np.hstack([one, z1[:, None], lags]))[0]
                full = np.linalg.qr(np.hstack([one, np.where(up, z1, 0)[:, None], np.where(up, 0, z1)[:, None], lags]))[0]
                fitted = null @ (null.T @ y)
                error = y - (full @ (full.T @ y) if base == "threshold" else fitted)
                reps = np.arange(r["first"], r["last"])
                star = fitted + draws.errors(kind, error, seed, r["h"], reps)
                ssr0, ssr1 = _projected(null, star), _projected(full, star)
                f = (ssr0 - ssr1) / (ssr1 / (len(v) - full.shape[1]))
                yield pd.DataFrame({**{k: [r[k]] * len(f) for k in keys}, "f_obs": r["f_obs"], "f_star": f})

    return _tail(blocks.mapInPandas(run, f"{_head(rows, keys)}, f_obs double, f_star double"), keys, "f_obs", "f_star")


def sup_lm(residual: DataFrame, n: int = 1000, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, max_lags: int = 4, trim: float = 0.15, n_grid: int = 100, seed: int = 0) -> DataFrame:
    """(keys, threshold, sup_lm, p_boot, crit): n (SSR0 - SSR1) / SSR0 at its largest, against resampled nulls.

    The candidates don't change with the replicate: the part of each candidate's regressor that the null leaves is found
    once, and a replicate's fall in squares is its squared product with it.
    """
    others = _lag_names(max_lags)
    rows = saved(prepare(residual, keys, order, max_lags).select(*keys, *order, "dz", "z1", "q", *others))
    value = F.col("n_obs") * (F.col("ssr0") - F.col("ssr")) / F.col("ssr0")
    seen = search(rows, keys, others, trim=trim, n_grid=n_grid, order=order).select(*keys, "threshold", value.alias("sup_lm"))
    blocks = replicated(rows.join(seen, list(keys)), keys, order, ["dz", "z1", "q", *others], n, ["threshold", "sup_lm"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.to_dict("records"):
                v = np.stack(r["v"])
                y, z1, q, size = v[:, 0], v[:, 1], v[:, 2], len(v)
                null = np.linalg.qr(np.hstack([np.ones((size, 1)), z1[:, None], v[:, 3:]]))[0]
                lo, hi = int(size * trim), int(size * (1 - trim))
                step = max(1, -(-(hi - lo) // n_grid))
                ranked = np.sort(q)
                places = [i for i in range(lo, hi, step) if i == 0 or ranked[i] != ranked[i - 1]]
                fitted = null @ (null.T @ y)
                star = fitted + draws.errors("nonparametric", y - fitted, seed, r["h"], np.arange(r["first"], r["last"]))
                part = np.where(q[:, None] < ranked[places][None, :], z1[:, None], 0.0)
                part -= null @ (null.T @ part)
                length = (part * part).sum(0)
                part = part[:, length > 1e-9 * (z1 @ z1)]
                gain = ((star @ part) ** 2 / (part * part).sum(0)).max(1, initial=0.0)
                yield pd.DataFrame({**{k: [r[k]] * len(gain) for k in keys}, "threshold": r["threshold"], "sup_lm": r["sup_lm"], "star": size * gain / _projected(null, star)})

    stars = blocks.mapInPandas(run, f"{_head(rows, keys)}, threshold double, sup_lm double, star double")
    return _tail(stars, [*keys, "threshold"], "sup_lm", "star").drop("n_boot")


def asymmetry(fits: DataFrame, keys: Sequence[str] = KEYS, n_boot: int = 0, seed: int = 0) -> DataFrame:
    """(keys, z, p_z, joint, p_joint[, p_boot]): tests of equal adjustment from the coefficients and their errors."""
    a, b, sa, sb = (F.col(c) for c in ("rho_above", "rho_below", "se_above", "se_below"))
    z = (a - b) / F.sqrt(sa * sa + sb * sb)
    joint = (F.pow(a / sa, 2) + F.pow(b / sb, 2)) / 2
    out = fits.where("status = 'ok'").select(*keys, "rho_above", "rho_below", "se_above", "se_below", z.alias("z"), joint.alias("joint"))
    out = out.withColumn("p_z", dist.normal_p("z")).withColumn("p_joint", dist.udf(dist.f_sf, 2.0, np.inf)("joint"))
    if not n_boot:
        return out.select(*keys, "z", "p_z", "joint", "p_joint")
    # both coefficients drawn around the pooled one
    wide = out.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    draw = lambda tag: dist.normal_quantile((F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), "rep", *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52))
    star = (sa * draw(1) - sb * draw(2)) / F.sqrt(sa * sa + sb * sb)
    p = wide.withColumn("hit", (F.abs(star) >= F.abs(F.col("z"))).cast("double")).groupBy(*keys).agg(F.avg("hit").alias("p_boot"))
    return out.join(p, list(keys)).select(*keys, "z", "p_z", "joint", "p_joint", "p_boot")


def _vecm_rows(pairs: DataFrame, keys: Sequence[str], order: Sequence[str], k_ar_diff: int, deterministic: str) -> tuple[DataFrame, list[str]]:
    beta = coint.johansen(pairs, keys=keys, order=order, k_ar_diff=k_ar_diff, deterministic="nc" if deterministic == "nc" else "co").where("status = 'ok'").select(*keys, "beta", "alpha")
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = pairs.join(beta, list(keys)).withColumn("z", F.col("y") * F.col("beta")[0] + F.col("x") * F.col("beta")[1])
    if deterministic != "nc":
        rows = rows.withColumn("z", F.col("z") - F.avg("z").over(Window.partitionBy(*keys)))
    rows = rows.withColumns({"dy": F.col("y") - F.lag("y").over(w), "dx": F.col("x") - F.lag("x").over(w), "z1": F.lag("z").over(w)}).withColumn("q", F.col("z1"))
    others = [f"d{c}{j}" for j in range(1, k_ar_diff) for c in ("y", "x")]
    rows = rows.withColumns({f"d{c}{j}": F.lag(f"d{c}", j).over(w) for j in range(1, k_ar_diff) for c in ("y", "x")})
    return complete(rows, ["dy", "dx", "z1", *others]), others


def tvecm(pairs: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, k_ar_diff: int = 2, deterministic: str = "co", trim: float = 0.15, fixed_threshold: float | None = None, n_grid: int | None = None) -> DataFrame:
    """Threshold VECM (H19): a row per pair and equation (y, x), one threshold for both, by the sum of their squares."""
    rows, others = _vecm_rows(pairs, keys, order, k_ar_diff, deterministic)
    rows = saved(rows)
    if fixed_threshold is None:
        taus = saved(search(rows, keys, others, ("dy", "dx"), trim, n_grid, order))
    else:
        taus = rows.select(*keys).distinct().withColumn("threshold", F.lit(float(fixed_threshold)))
    fits = reduce(DataFrame.unionAll, [fit_at(rows, taus, keys, 0, "tvecm", fixed_threshold is not None, f"d{e}", others).withColumn("equation", F.lit(e)) for e in ("y", "x")])
    whole = Window.partitionBy(*keys)
    fits = fits.withColumns({"system_aic": F.sum("aic").over(whole), "system_bic": F.sum("bic").over(whole)})
    return fits.join(rows.groupBy(*keys).agg(F.first("beta").alias("beta"), F.first("alpha").alias("alpha")), list(keys))


def tvecm_bootstrap(pairs: DataFrame, n: int = 1000, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, k_ar_diff: int = 2, deterministic: str = "co", trim: float = 0.15, seed: int = 0) -> DataFrame:
    """(keys, f_obs, p_boot, n_boot): the larger F of the two equations against resampled linear nulls.

    Errors of both equations are drawn from the same dates.
    """
    rows, others = _vecm_rows(pairs, keys, order, k_ar_diff, deterministic)
    rows = saved(rows.select(*keys, *order, "dy", "dx", "z1", "q", *others))
    taus = saved(search(rows, keys, others, ("dy", "dx"), trim, order=order)).select(*keys, "threshold")
    blocks = replicated(rows.join(taus, list(keys)), keys, order, ["dy", "dx", "z1", "q", *others], n, ["threshold"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.to_dict("records"):
                v = np.stack(r["v"])
                z1, lags, one = v[:, 2], v[:, 4:], np.ones((len(v), 1))
                up = v[:, 3] >= r["threshold"]
                null = np.linalg.qr(np.hstack([one, z1[:, None], lags]))[0]
                full = np.linalg.qr(np.hstack([one, np.where(up, z1, 0)[:, None], np.where(up, 0, z1)[:, None], lags]))[0]
                df = len(v) - full.shape[1]
                f = lambda y: (_projected(null, y) / _projected(full, y) - 1) * df  # noqa: B023, E731
                reps, seen, star = np.arange(r["first"], r["last"]), -np.inf, None
                for y in (v[:, 0], v[:, 1]):
                    fitted = null @ (null.T @ y)
                    found = f(fitted + draws.errors("nonparametric", y - fitted, seed, r["h"], reps))
                    seen, star = max(seen, float(f(y[None, :])[0])), found if star is None else np.maximum(star, found)
                yield pd.DataFrame({**{k: [r[k]] * len(star) for k in keys}, "f_obs": seen, "f_star": star})

    return _tail(blocks.mapInPandas(run, f"{_head(rows, keys)}, f_obs double, f_star double"), keys, "f_obs", "f_star").drop("crit")


def fit_pairs(pairs: DataFrame, mode: str = "standard", **options) -> DataFrame:
    """``fit`` or ``tvecm`` from prices: the dispatcher of modes standard, fixed, mtar and tvecm."""
    if mode == "tvecm":
        return tvecm(pairs, **options)
    keys = options.get("keys", KEYS)
    return fit(coint.residuals(pairs, keys), mode, **options)


def compare(pairs: DataFrame, modes: Sequence[str] = ("standard", "fixed", "mtar", "tvecm"), criterion: str = "bic", keys: Sequence[str] = KEYS, **options) -> DataFrame:
    """(keys, mode, aic, bic, is_best): all models of a pair and the best by the criterion (H22); TVECM by its system."""
    parts = []
    for mode in modes:
        found = fit_pairs(pairs, mode, keys=keys, **({} if mode == "tvecm" else options))
        if mode == "tvecm":
            found = found.where("equation = 'y'").withColumns({"aic": F.col("system_aic"), "bic": F.col("system_bic")})
        parts.append(found.where("status = 'ok'").select(*keys, F.lit(mode).alias("mode"), "aic", "bic"))
    rows = reduce(DataFrame.unionAll, parts)
    best = rows.groupBy(*keys).agg(F.min_by("mode", F.struct(criterion, "mode")).alias("best"))
    return rows.join(best, list(keys)).withColumn("is_best", F.col("mode") == F.col("best")).drop("best")


def with_breaks(pairs: DataFrame, break_dates: DataFrame | None = None, mode: str = "standard", keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, least: int = 10, **options) -> DataFrame:
    """(keys, regime, …): fits within the intervals between break dates, with n-weighted aic and bic per pair.

    ``break_dates`` (keys, break_date); if None, the Zivot-Andrews dates of y and x.  Regimes under ``least`` rows go.
    """
    if break_dates is None:
        found = [unitroot.zivot_andrews(pairs, keys, order, v).where("break_date is not null").select(*keys, "break_date") for v in ("y", "x")]
        break_dates = found[0].unionAll(found[1]).distinct()
    rows = joins.regimes(pairs, break_dates, order[0], keys)
    counts = rows.groupBy(*keys, "regime").count().where(F.col("count") >= least).drop("count")
    rows = rows.join(counts, [*keys, "regime"])
    fits = fit_pairs(rows, mode, keys=[*keys, "regime"], order=order, **options)
    whole, n = Window.partitionBy(*keys), F.when(F.col("status") == "ok", F.col("n_obs"))
    weighted = {f"weighted_{c}": F.sum(n * F.col(c)).over(whole) / F.sum(n).over(whole) for c in ("aic", "bic")}
    return fits.withColumns(weighted)


def regime_table(residual: DataFrame, fits: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, max_lags: int = 4, regime: str = "level", lag: int = 1) -> DataFrame:
    """(keys, order, z, q, regime): each date's residual, regime variable and side of the threshold."""
    rows = prepare(residual, keys, order, max_lags, regime, lag)
    side = F.when(F.col("q") >= F.col("threshold"), ABOVE).otherwise(BELOW)
    return rows.join(fits.select(*keys, "threshold"), list(keys)).where("threshold is not null").select(*keys, *order, "z", "q", side.alias("regime"))

