"""Cointegration and error correction for all pairs at once (H1-H6, H26, H27).  Pairs have pair_id, ts, y, x.

``rows``, where it is given, is the number of rows of the ranges into which a long series is cut (see ``ranges``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions import dist
from bazaarlens.operators import joins, ranges
from bazaarlens.operators.ols import complete, gram, grouped_ols, restriction_f, unpack
from bazaarlens.operators.unitroot import _head, adf_statistics, break_range, mackinnon_map, small_fits

# Gregory and Hansen (1996) critical values at 1, 5 and 10 %, one regressor.
GH = {"c": (-5.13, -4.61, -4.34), "ct": (-5.45, -4.99, -4.72), "cshift": (-5.47, -4.95, -4.68)}
# Johansen, two series, unrestricted constant, at 90, 95 and 99 %.
TRACE = ((13.43, 15.49, 19.93), (2.71, 3.84, 6.63))
MAX_EIGEN = ((12.30, 14.26, 18.52), (2.71, 3.84, 6.63))

KEYS, ORDER = ["pair_id"], ["ts"]


def cointegrating_vectors(pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, const, slope, n_obs, r2): least squares of y on 1, x in one aggregate."""
    return pairs.groupBy(*keys).agg(F.regr_intercept("y", "x").alias("const"), F.regr_slope("y", "x").alias("slope"), F.regr_count("y", "x").alias("n_obs"), F.regr_r2("y", "x").alias("r2"))


def panel_vectors(panel: DataFrame, value: str = "price", market: str = "market", date: str = "date", **tiles) -> DataFrame:
    """(pair_id, const, slope, n_obs, r2) of all market pairs of a panel by products of tiles: no row for a pair and date (H1)."""
    sums = joins.pair_sums(panel, value, market, date, **tiles)
    slope = F.col("s_lr") / F.nullif(F.col("s_rr"), F.lit(0.0))
    r2 = F.when(F.col("s_rr") != 0, F.when(F.col("s_ll") == 0, 1.0).otherwise(F.col("s_lr") ** 2 / (F.col("s_ll") * F.col("s_rr"))))
    return sums.select(F.concat_ws("|", "left", "right").alias("pair_id"), (F.col("m_left") - slope * F.col("m_right")).alias("const"), slope.alias("slope"), F.col("n").alias("n_obs"), r2.alias("r2"))


def residuals(pairs: DataFrame, keys: Sequence[str] = KEYS, rows: int | None = None) -> DataFrame:
    """The pairs with ``z``, what the cointegrating vector leaves."""
    if rows is not None:
        vectors = cointegrating_vectors(pairs, keys).select(*keys, F.col("const").alias("_a"), F.col("slope").alias("_b"))
        return ranges.matched(pairs, vectors, keys).withColumn("z", F.col("y") - F.col("_a") - F.col("_b") * F.col("x")).drop("_a", "_b")
    whole = Window.partitionBy(*keys)
    a, b = F.regr_intercept("y", "x").over(whole), F.regr_slope("y", "x").over(whole)
    return pairs.withColumn("z", F.col("y") - a - b * F.col("x"))


def engle_granger(pairs: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, max_lags: int = 4, alpha: float = 0.05, rows: int | None = None) -> DataFrame:
    """Engle-Granger (H1): ADF without constant on the residuals, with fixed lags; p and critical values for two series."""
    found = adf_statistics(residuals(pairs, keys, rows), keys, order, "z", "n", max_lags, choose=False, rows=rows)
    found = found.withColumn("p_value", dist.udf(dist.mackinnon_p, "c", 2)("statistic")).drop("n_obs")
    least = 2 * (max_lags + 2) + 1
    enough = F.col("n_series") >= least
    out = cointegrating_vectors(pairs, keys).join(found, list(keys), "left")
    out = out.withColumns({"crit": mackinnon_map(F.col("n_obs"), "c", 2), "test": F.lit("engle_granger"), "is_cointegrated": F.when(enough, F.coalesce(F.col("p_value") < alpha, F.lit(False))), "status": F.when(enough, "ok").otherwise("insufficient_data")})
    for c in ("statistic", "p_value"):
        out = out.withColumn(c, F.when(enough, F.col(c)))
    return out.select(*keys, "test", "statistic", "p_value", "crit", "const", "slope", "n_obs", "is_cointegrated", "status")


def johansen(pairs: DataFrame, columns: Sequence[str] = ("y", "x"), keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, k_ar_diff: int = 2, deterministic: str = "co", level: int = 1) -> DataFrame:
    """Johansen's trace and largest-eigenvalue statistics, rank, vectors and loadings (H2), from moments alone.

    ``deterministic``: nc none, co (unrestricted) constant.  ``level`` picks the column of the tables: 90, 95 or 99 %.
    """
    k = len(columns)
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = complete(pairs, columns)
    # a constant in the regression makes levels less the first one as good as levels, and smaller
    base = {c: (F.col(c) - F.first(c).over(w)) if deterministic == "co" else F.col(c) for c in columns}
    rows = rows.select(*keys, *order, *[b.alias(c) for c, b in base.items()])
    rows = rows.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(w) for c in columns} | {f"l_{c}": F.lag(c).over(w) for c in columns})
    lags = {f"d_{c}_{j}": F.lag(f"d_{c}", j).over(w) for j in range(1, k_ar_diff + 1) for c in columns}
    rows = complete(rows.withColumns(lags), list(lags) or [f"d_{c}" for c in columns])
    fixed = ([F.lit(1.0)] if deterministic == "co" else []) + [F.col(c) for c in lags]
    cols = [*[F.col(f"d_{c}") for c in columns], *[F.col(f"l_{c}") for c in columns], *fixed]
    counts = pairs.groupBy(*keys).agg(F.count("*").alias("n_series"))
    sums = counts.join(rows.groupBy(*keys).agg(F.count("*").alias("n_obs"), gram(cols).alias("g")), list(keys), "left")
    least, m = 4 * k * (k_ar_diff + 1), len(cols)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for g, n, series in zip(frame["g"], frame["n_obs"], frame["n_series"], strict=True):
                if series < least or g is None or n <= m:
                    out.append((None,) * 7 + (int(series), "insufficient_data"))
                    continue
                s = unpack(np.array(g, float)[None], m)[0]
                a, f = s[: 2 * k, : 2 * k], s[2 * k :, 2 * k :]
                if len(f):
                    a = a - s[: 2 * k, 2 * k :] @ np.linalg.pinv(f, rcond=1e-13) @ s[2 * k :, : 2 * k]
                a = a / n
                s00, s01, s11 = a[:k, :k], a[:k, k:], a[k:, k:]
                try:
                    c = np.linalg.inv(np.linalg.cholesky(s11))
                    value, vector = np.linalg.eigh(c @ s01.T @ np.linalg.solve(s00, s01) @ c.T)
                except np.linalg.LinAlgError:
                    out.append((None,) * 7 + (int(n), "singular"))
                    continue
                value, vector = np.clip(value[::-1], 0, 1 - 1e-15), (c.T @ vector[:, ::-1])
                trace = [float(-n * np.log(1 - value[i:]).sum()) for i in range(k)]
                largest = [float(-n * np.log(1 - v)) for v in value]
                rank = None
                if k == 2:
                    rank = next((i for i in range(k) if trace[i] < TRACE[i][level]), k)
                beta = vector / np.where(vector[0] == 0, 1, vector[0])
                alpha = s01 @ beta @ np.linalg.inv(beta.T @ s11 @ beta)
                out.append((trace, largest, value.tolist(), rank, None if rank is None else rank > 0, beta[:, 0].tolist(), alpha[:, 0].tolist(), int(n), "ok"))
            names = ["trace", "max_eigen", "eigenvalues", "rank", "is_cointegrated", "beta", "alpha", "n_obs", "status"]
            made = pd.DataFrame({n: pd.Series([o[i] for o in out], dtype=object) for i, n in enumerate(names)})
            yield pd.concat([frame[list(keys)].reset_index(drop=True), made], axis=1)

    return sums.mapInPandas(run, f"{_head(pairs, keys)}, trace array<double>, max_eigen array<double>, eigenvalues array<double>, rank int, is_cointegrated boolean, beta array<double>, alpha array<double>, n_obs long, status string")


def _break_statistics(frame: pd.DataFrame, model: str, lags: int) -> np.ndarray:
    """For each candidate date the t of the residual's last level, from sums before the date and the rows around it.

    Step one regresses y on 1, x, the step and what the model adds; its cross-products are totals (and totals less sums
    before the date, for what begins there).  The residual is a linear form in (1, u, y, x) with one set of numbers before
    the date and another from it on, so the sums of the second step are quadratic forms in sums of products of lagged
    columns; only the ``lags + 1`` rows from the date on mix both sets, and are added one by one.
    """
    array = lambda c: np.array(frame[c].tolist(), float)
    count = len(frame)
    n = frame["n"].to_numpy(float)
    start = frame["break_at"].to_numpy(np.int64)
    full = unpack(array("g0"), 4)  # of 1, x, u, y
    late = full - unpack(array("p0"), 4)
    names = [(0, False), (0, True), (1, False)] + ([(2, False)] if model == "ct" else []) + ([(1, True)] if model == "cshift" else [])
    part = lambda a, b: (late if a[1] or b[1] else full)[:, a[0], b[0]]
    xx = np.stack([np.stack([part(a, b) for b in names], 1) for a in names], 1)
    xy = np.stack([part(a, (3, False)) for a in names], 1)
    coef, _, good = small_fits(xx, xy, full[:, 3, 3], n)
    const, step, slope = coef[:, 0], coef[:, 1], coef[:, 2]
    trend = coef[:, 3] if model == "ct" else np.zeros(count)
    shift = coef[:, 3] if model == "cshift" else np.zeros(count)
    # columns of the second step: 1, u, then y and x at each lag
    depth = lags + 2
    m = 2 + 2 * depth

    def residual(lag: int, after: bool) -> np.ndarray:
        form = np.zeros((count, m))
        form[:, 0] = -const - (step if after else 0) + trend * lag / n
        form[:, 1] = -trend
        form[:, 2 + 2 * lag] = 1
        form[:, 3 + 2 * lag] = -slope - (shift if after else 0)
        return form

    def forms(after) -> np.ndarray:
        e = [residual(j, after(j)) for j in range(depth)]
        return np.stack([e[1], *[e[j] - e[j + 1] for j in range(1, lags + 1)], e[0] - e[1]], 1)

    total, early = unpack(array("g1"), m), unpack(array("p1"), m)
    ys, xs = array("near_y"), array("near_x")  # places start - lags - 1 to start + lags
    rest = total - early
    before = forms(lambda j: False)
    q = np.einsum("nai,nij,nbj->nab", before, early, before)
    for row in range(lags + 1):
        place = start + row
        there = (place < n) & (place >= lags + 1)
        base = np.zeros((count, m))
        base[:, 0], base[:, 1] = 1, place / n
        for j in range(depth):
            base[:, 2 + 2 * j], base[:, 3 + 2 * j] = ys[:, row - j + lags + 1], xs[:, row - j + lags + 1]
        base[~there] = 0
        rest = rest - base[:, :, None] * base[:, None, :]
        mixed = np.einsum("nai,ni->na", forms(lambda j: row >= j), base)  # noqa: B023
        q += mixed[:, :, None] * mixed[:, None, :]
    later = forms(lambda j: True)
    q += np.einsum("nai,nij,nbj->nab", later, rest, later)
    _, t, fine = small_fits(q[:, :-1, :-1], q[:, :-1, -1], q[:, -1, -1], total[:, 0, 0])
    return np.where(good & fine, t[:, 0], np.nan)


def gregory_hansen(pairs: DataFrame, model: str = "c", keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, max_lags: int = 1, trim: float = 0.15, rows: int | None = None) -> DataFrame:
    """Gregory-Hansen (H3): the least residual ADF over break dates; c level, ct level and trend, cshift regime.

    Every date between the trimmed ends is tried: one row with running sums and one solve of both steps a date.
    """
    if model not in GH:
        raise ValueError(f"unknown model {model}")
    some = complete(pairs, ["y", "x"]).select(*keys, *order, F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    whole = some.groupBy(*keys).agg(F.avg("y").alias("_my"), F.avg("x").alias("_mx"), F.count("*").alias("n"))
    # a constant is in the first step, and a step wherever x begins anew: numbers less their means leave the same
    placed = ranges.matched(some, whole, keys).withColumns({"y": F.col("y") - F.col("_my"), "x": F.col("x") - F.col("_mx")}).drop("_my", "_mx")
    depth = max_lags + 2
    part = ranges.cut(placed, keys, order, rows, depth - 1, max_lags)
    w = part.window()
    shifted = part.data.withColumn("i", part.index().cast("long")).withColumns({f"{c}_{j}": F.lag(c, j).over(w) for c in ("y", "x") for j in range(-max_lags, depth)})
    made = part.own(shifted, True).withColumn("u", F.col("i").cast("double") / F.col("n"))
    first = [F.lit(1.0), F.col("x"), F.col("u"), F.col("y")]
    second = [F.lit(1.0), F.col("u"), *[F.col(f"{c}_{j}") for j in range(depth) for c in ("y", "x")]]
    whole_row = F.col("i") >= depth - 1
    upper = lambda cs: [a * b for k, a in enumerate(cs) for b in cs[k:]]
    products = {f"a{k}": c for k, c in enumerate(upper(first))} | {f"b{k}": F.when(whole_row, c).otherwise(0.0) for k, c in enumerate(upper(second))}
    made = made.withColumns(products)
    lists = lambda s, f: F.array(*[f(c) for c in products if c[0] == s])
    totals = made.groupBy(*keys).agg(lists("a", F.sum).alias("g0"), lists("b", F.sum).alias("g1"))
    so_far = ranges.running(made, {f"r{c}": F.col(c) for c in products}, keys, order, rows, inclusive=False)
    low, high = break_range(F.col("n"), trim)
    near = lambda c: F.array(*[F.coalesce(F.col(f"{c}_{j}"), F.lit(0.0)) for j in range(depth - 1, -max_lags - 1, -1)]).alias(f"near_{c}")
    sums = lambda c: F.coalesce(F.col(f"r{c}"), F.lit(0.0))
    tried = so_far.where((F.col("i") >= low) & (F.col("i") <= high)).select(*keys, F.col(order[0]).alias("break_date"), F.col("i").alias("break_at"), "n", lists("a", sums).alias("p0"), lists("b", sums).alias("p1"), near("y"), near("x"))
    tried = ranges.matched(tried, totals, keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame[[*keys, "break_at", "break_date"]].assign(statistic=_break_statistics(frame, model, max_lags)).dropna(subset=["statistic"])

    stats = tried.mapInPandas(run, f"{_head(tried, [*keys, 'break_at', 'break_date'])}, statistic double")
    best = stats.groupBy(*keys).agg(F.min(F.struct("statistic", "break_at", "break_date")).alias("m")).select(*keys, F.col("m.statistic").alias("statistic"), F.col("m.break_date").alias("break_date"))
    least = 2 * (max_lags + 2) + 3
    out = whole.select(*keys, F.col("n").alias("n_obs")).join(best, list(keys), "left")
    enough = (F.col("n_obs") >= least) & F.col("statistic").isNotNull()
    crit = F.create_map(*[x for name, v in zip(dist.LEVELS, GH[model], strict=True) for x in (F.lit(name), F.lit(v))])
    return out.select(*keys, F.lit(f"gregory_hansen_{model}").alias("test"), F.when(enough, F.col("statistic")).alias("statistic"), crit.alias("crit"), "break_date", "n_obs", F.when(enough, F.col("statistic") < GH[model][1]).alias("is_cointegrated"), F.when(enough, "ok").otherwise("insufficient_data").alias("status"))


def all_tests(pairs: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, max_lags: int = 4, gh_model: str = "c") -> DataFrame:
    """(keys, engle_granger, johansen, gregory_hansen, is_cointegrated): any of the three (H4)."""
    a = engle_granger(pairs, keys, order, max_lags).select(*keys, F.col("is_cointegrated").alias("engle_granger"))
    b = johansen(pairs, keys=keys, order=order).select(*keys, F.col("is_cointegrated").alias("johansen"))
    c = gregory_hansen(pairs, gh_model, keys, order).select(*keys, F.col("is_cointegrated").alias("gregory_hansen"))
    out = a.join(b, list(keys), "left").join(c, list(keys), "left")
    tests = [F.coalesce(t, F.lit(False)) for t in ("engle_granger", "johansen", "gregory_hansen")]
    return out.withColumn("is_cointegrated", tests[0] | tests[1] | tests[2])


def _dynamics(pairs: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int | None) -> DataFrame:
    part = ranges.cut(residuals(pairs, keys, rows), keys, order, rows, 1)
    w = part.window()
    return part.own(part.data.withColumns({"dy": F.col("y") - F.lag("y").over(w), "dx": F.col("x") - F.lag("x").over(w), "z1": F.lag("z").over(w)}))


def error_correction(pairs: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, rows: int | None = None) -> DataFrame:
    """Error-correction model (H5): the change of y on 1, the change of x and the last residual."""
    return grouped_ols(_dynamics(pairs, keys, order, rows), keys, "dy", {"dx": F.col("dx"), "z": F.col("z1")})


def asymmetric_error_correction(pairs: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, rows: int | None = None) -> DataFrame:
    """The same with the residual's positive and negative part, and F and p of their equality (H6)."""
    names = ["const", "dx", "z_pos", "z_neg"]
    fits = grouped_ols(_dynamics(pairs, keys, order, rows), keys, "dy", {"dx": F.col("dx"), "z_pos": F.greatest("z1", F.lit(0.0)), "z_neg": F.least("z1", F.lit(0.0))})
    return fits.withColumn("f_asym", restriction_f(F.col("cov"), F.col("coef"), names, "z_pos", "z_neg")).withColumn("p_asym", dist.f_p("f_asym", F.lit(1.0), "df"))


def granger(pairs: DataFrame, max_lag: int = 5, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, rows: int | None = None) -> DataFrame:
    """(keys, lag, f, p): do lags of x help to tell y (H26); a sample for each number of lags."""
    part = ranges.cut(pairs, keys, order, rows, max_lag)
    lagged = part.own(part.data.withColumns({f"{c}{j}": F.lag(c, j).over(part.window()) for c in ("y", "x") for j in range(1, max_lag + 1)}))
    parts = []
    for p in range(1, max_lag + 1):
        some = complete(lagged, ["y", *[f"{c}{j}" for c in ("y", "x") for j in range(1, p + 1)]])
        own, both = [f"y{j}" for j in range(1, p + 1)], [f"{c}{j}" for c in ("y", "x") for j in range(1, p + 1)]
        a = grouped_ols(some, keys, "y", own).select(*keys, F.col("ssr").alias("ssr0"))
        b = grouped_ols(some, keys, "y", both).select(*keys, "ssr", "df")
        f = (F.col("ssr0") - F.col("ssr")) / p / (F.col("ssr") / F.col("df"))
        parts.append(a.join(b, list(keys)).select(*keys, F.lit(p).alias("lag"), f.alias("f"), "df"))
    out = reduce(DataFrame.unionAll, parts)
    return out.withColumn("p", dist.f_p("f", F.col("lag").cast("double"), "df"))


def integration_network(results: DataFrame, coordinates: DataFrame, market: str = "market") -> DataFrame:
    """Integrated pairs with the coordinates of both ends."""
    ends = F.split("pair_id", r"\|")
    edges = results.where("is_cointegrated").select("pair_id", ends[0].alias("market_y"), ends[1].alias("market_x"))
    side = lambda m, s: coordinates.select(F.col(market).alias(m), F.col("x").alias(f"x_{s}"), F.col("y").alias(f"y_{s}"))
    return edges.join(side("market_y", "from"), "market_y").join(side("market_x", "to"), "market_x")
