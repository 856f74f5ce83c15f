"""Unit-root tests for all series at once (G): one row per series.

The regressions with 0..max_lags lagged differences are sub-matrices of one table of cross-products, kept apart by how
many lags a row has; so one aggregation serves both the lag choice on the common sample and the fit on the longest one.

Break searches (Zivot-Andrews) take the cross-products of a dummy that begins at a date as the totals less running sums up to
it, so that each date is a small solve and rows are never multiplied by dates.

``rows``, where it is given, is the number of rows of the ranges into which a long series is cut (see ``ranges``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions import dist
from bazaarlens.operators import ranges
from bazaarlens.operators.ols import complete, gram, grouped_ols, inverse, unpack

TRENDS = {"n": 0, "c": 1, "ct": 2, "ctt": 3}
# KPSS (1992), Zivot-Andrews (1992) and Elliott-Rothenberg-Stock (1996) critical values.
KPSS = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}
KPSS_P = (0.10, 0.05, 0.025, 0.01)
ZA = {"c": (-5.34, -4.80, -4.58), "t": (-4.93, -4.42, -4.11), "ct": (-5.57, -5.08, -4.82)}
DFGLS = {"c": (-2.58, -1.94, -1.62), "ct": (-3.48, -2.89, -2.57)}


def _head(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)


def _values(data: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int | None = None) -> DataFrame:
    """Complete rows with their place from 1 (i), the length of their series (n) and its first value (v0)."""
    some = complete(data.select(*keys, *order, F.col(value).cast("double").alias("v")), ["v"])
    if rows is not None:
        placed = ranges.numbered(some, keys, order, ["v"])
        return placed.withColumns({"i": F.col(ranges.INDEX) + 1, "n": F.col(ranges.LENGTH)}).withColumnRenamed("_first_v", "v0")
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = Window.partitionBy(*keys)
    return some.withColumns({"i": F.row_number().over(w), "n": F.count("*").over(whole), "v0": F.first("v").over(w)})


def _lagged(data: DataFrame, keys: Sequence[str], order: Sequence[str], level: Column, max_lags: int, rows: int | None = None) -> DataFrame:
    """d (difference), z (last level), d1.. (lagged differences, 0 where there is none) and how many of them there are."""
    part = ranges.cut(data.withColumn("x", level), keys, order, rows, max_lags + 1)
    w = part.window()
    out = part.data.withColumn("z", F.lag("x").over(w)).withColumn("d", F.col("x") - F.col("z"))
    out = out.withColumns({f"d{k}": F.coalesce(F.lag("d", k).over(w), F.lit(0.0)) for k in range(1, max_lags + 1)})
    return part.own(out, True).where("d is not null").withColumn("have", F.least(F.col("i") - 2, F.lit(max_lags)).cast("int"))


def adf_statistics(data: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, trend: str = "c", max_lags: int = 4, choose: bool = True, rows: int | None = None) -> DataFrame:
    """(keys, statistic, n_lags, n_obs, n_series): the t of the last level; lags by AIC on the common sample if ``choose``."""
    values = _values(data, keys, order, value, rows)
    level = F.col("v") if trend == "n" else F.col("v") - F.col("v0")
    lagged = _lagged(values, keys, order, level, max_lags, rows)
    fixed = [F.lit(1.0), F.col("i").cast("double") / F.col("n"), (F.col("i").cast("double") / F.col("n")) ** 2][: TRENDS[trend]]
    columns = [*fixed, F.col("z"), *[F.col(f"d{k}") for k in range(1, max_lags + 1)], F.col("d")]
    sums = lagged.groupBy(*keys, "have").agg(F.count("*").alias("c"), gram(columns).alias("g"), F.max("n").alias("n"))
    # at most max_lags + 1 rows a series
    series = sums.groupBy(*keys).agg(F.collect_list(F.struct("have", "c", "g")).alias("parts"), F.max("n").alias("n_series"))
    t, m = TRENDS[trend], len(columns)

    def fit(g: np.ndarray, n: float, lags: int) -> tuple[float, float]:
        take = [*range(t + 1 + lags)]
        xx, xy, yy = g[np.ix_(take, take)], g[take, -1], g[-1, -1]
        inv, good = inverse(xx[None].copy())
        k = len(take)
        if not good[0] or n <= k:
            return np.nan, np.nan
        b = inv[0] @ xy
        b = b + inv[0] @ (xy - xx @ b)
        ssr = max(yy - 2 * b @ xy + b @ xx @ b, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            aic = n * (np.log(2 * np.pi) + np.log(ssr / n) + 1) + 2 * k
            return float(b[t] / np.sqrt(inv[0][t, t] * ssr / (n - k))), float(aic)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for parts, n in zip(frame["parts"], frame["n_series"], strict=True):
                most = min(max_lags, int(n) // 2 - 1 - t) if choose else max_lags
                found = {int(p["have"]): (float(p["c"]), unpack(np.array(p["g"], float)[None], m)[0]) for p in parts}
                total = lambda lags: (sum(c for h, (c, _) in found.items() if h >= lags), sum(g for h, (_, g) in found.items() if h >= lags))  # noqa: B023, E731
                if most < 0 or not any(h >= most for h in found):
                    out.append((None, None, None))
                    continue
                lags = most
                if choose:
                    c, g = total(most)
                    scores = [fit(g, c, p)[1] for p in range(most + 1)]
                    lags = int(np.nanargmin(scores)) if np.isfinite(scores).any() else 0
                c, g = total(lags)
                s = fit(g, c, lags)[0]
                out.append((s if np.isfinite(s) else None, lags, int(c)))
            yield pd.concat([frame[list(keys)].reset_index(drop=True), pd.DataFrame({"statistic": pd.Series([o[0] for o in out], dtype=object), "n_lags": pd.Series([o[1] for o in out], dtype=object), "n_obs": pd.Series([o[2] for o in out], dtype=object), "n_series": frame["n_series"].to_numpy()})], axis=1)

    return series.mapInPandas(run, f"{_head(values, keys)}, statistic double, n_lags int, n_obs long, n_series long")


RESULT = ["test", "trend", "statistic", "p_value", "crit", "n_lags", "n_obs", "break_date", "is_stationary", "status"]


def _result(df: DataFrame, keys: Sequence[str], test: str, trend: str, least: int, p: Column | None, crit: Column | None, stationary: Column) -> DataFrame:
    """The common schema; short series have a status and no numbers."""
    enough = (F.col("n_series") >= least) & F.col("statistic").isNotNull()
    given = {"p_value": p if p is not None else F.lit(None).cast("double"), "crit": crit if crit is not None else F.lit(None).cast("map<string,double>")}
    extra = {c: F.lit(None).cast(t) for c, t in (("n_lags", "int"), ("break_date", "date")) if c not in df.columns}
    out = df.withColumns({"test": F.lit(test), "trend": F.lit(trend), **given, **extra})
    out = out.withColumns({"is_stationary": F.when(enough, F.coalesce(stationary, F.lit(False))), "status": F.when(enough, "ok").when(F.col("n_series") < least, "insufficient_data").otherwise("singular"), "min_required": F.lit(least)})
    for c in ("statistic", "p_value"):
        out = out.withColumn(c, F.when(enough, F.col(c)))
    return out.select(*keys, *RESULT, "min_required")


def _levels(values: Sequence[float]) -> Column:
    return F.create_map(*[x for name, v in zip(dist.LEVELS, values, strict=True) for x in (F.lit(name), F.lit(float(v)))])


def mackinnon_map(n_obs: Column, trend: str, n: int = 1) -> Column | None:
    """Critical values at the sample size, as an expression."""
    if (n, trend) not in dist.CRITICAL:
        return None
    t = n_obs.cast("double")
    value = lambda row: reduce(lambda a, b: a + b, [F.lit(float(k)) / F.pow(t, F.lit(i)) for i, k in enumerate(row)])
    return F.create_map(*[x for name, row in zip(dist.LEVELS, dist.CRITICAL[n, trend], strict=True) for x in (F.lit(name), value(row))])


def adf(data: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "price", trend: str = "c", max_lags: int = 4, alpha: float = 0.05, rows: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller (G1)."""
    found = adf_statistics(data, keys, order, value, trend, max_lags, rows=rows)
    p = dist.udf(dist.mackinnon_p, trend, 1)("statistic")
    out = found.withColumn("p", p)
    return _result(out, keys, "adf", trend, 4, F.col("p"), mackinnon_map(F.col("n_obs"), trend), F.col("p") < alpha)


def _variance(data: DataFrame, keys: Sequence[str], order: Sequence[str], e: str, lags: Column, most: int, rows: int | None = None) -> DataFrame:
    """(keys, g0, lrv): the variance of e and its Bartlett long-run variance with ``lags`` (up to ``most``) lags."""
    part = ranges.cut(data, keys, order, rows, most)
    shifted = part.data.withColumns({"l": lags, "e": F.col(e)} | {f"e{k}": F.lag(e, k).over(part.window()) for k in range(1, most + 1)})
    sums = part.own(shifted).groupBy(*keys).agg(F.count("*").alias("m"), F.max("l").alias("l"), F.sum(F.col("e") ** 2).alias("s0"), *[F.coalesce(F.sum(F.col("e") * F.col(f"e{k}")), F.lit(0.0)).alias(f"s{k}") for k in range(1, most + 1)])
    terms = [F.when(F.col("l") >= k, 2 * (1 - F.lit(float(k)) / (F.col("l") + 1)) * F.col(f"s{k}")).otherwise(0.0) for k in range(1, most + 1)]
    return sums.select(*keys, "m", (F.col("s0") / F.col("m")).alias("g0"), (reduce(lambda a, b: a + b, terms, F.col("s0")) / F.col("m")).alias("lrv"))


def _trend_residuals(data: DataFrame, keys: Sequence[str], trend: str, rows: int | None = None) -> DataFrame:
    """``e``: the value less its mean, or less its line in time."""
    if trend == "c" and rows is None:
        return data.withColumn("e", F.col("v") - F.avg("v").over(Window.partitionBy(*keys)))
    place = F.col("i").cast("double")
    fit = {"c": (F.avg("v"), F.lit(0.0)), "ct": (F.regr_intercept("v", place), F.regr_slope("v", place))}[trend]
    line = data.groupBy(*keys).agg(fit[0].alias("a"), fit[1].alias("b"))
    return ranges.matched(data, line, keys).withColumn("e", F.col("v") - F.col("a") - F.col("b") * F.col("i"))


def kpss(data: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "price", trend: str = "c", max_lags: int = 4, robust: bool = True, alpha: float = 0.05, rows: int | None = None) -> DataFrame:
    """KPSS (G3): stationary unless the statistic is large; p by interpolation in the table, within [.01, .10]."""
    left = _trend_residuals(_values(data, keys, order, value, rows), keys, trend, rows)
    lags = F.least(F.floor(12 * F.pow(F.col("n") / 100.0, 0.25)), F.lit(max_lags)).cast("int") if robust else F.lit(max_lags)
    variance = _variance(left, keys, order, "e", lags, max_lags, rows)
    sums = ranges.running(left, {"s": F.col("e")}, keys, order, rows).groupBy(*keys).agg(F.sum(F.col("s") ** 2).alias("ss"), F.max("n").alias("n_series"), F.max(lags).alias("n_lags"))
    found = ranges.matched(sums, variance, keys).withColumn("statistic", F.col("ss") / F.col("n_series") ** 2 / F.nullif(F.col("lrv"), F.lit(0.0))).withColumn("n_obs", F.col("n_series"))
    x, s = KPSS[trend], F.col("statistic")
    p = F.when(s <= x[0], KPSS_P[0]).when(s >= x[3], KPSS_P[3])
    for i in range(3):
        p = p.when(s <= x[i + 1], KPSS_P[i] + (KPSS_P[i + 1] - KPSS_P[i]) * (s - x[i]) / (x[i + 1] - x[i]))
    return _result(found.withColumn("p", p), keys, "kpss", trend, 4, F.col("p"), _levels((x[3], x[1], x[0])), F.col("p") > alpha)


def phillips_perron(data: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "price", trend: str = "c", max_lags: int | None = None, alpha: float = 0.05, rows: int | None = None) -> DataFrame:
    """Phillips-Perron Z_tau (G2), Bartlett window of 12 (n/100)^(1/4) lags unless given."""
    values = _values(data, keys, order, value, rows).withColumn("x", F.col("v") - F.col("v0") if trend != "n" else F.col("v"))
    part = ranges.cut(values, keys, order, rows, 1)
    lagged = part.own(part.data.withColumn("z", F.lag("x").over(part.window())), True).where("z is not null").withColumn("t", F.col("i").cast("double"))
    if rows is not None:  # the first row of a series is gone
        lagged = lagged.withColumns({ranges.INDEX: F.col(ranges.INDEX) - 1, ranges.LENGTH: F.col(ranges.LENGTH) - 1})
    xs = {"z": F.col("z")} | ({"t": F.col("t")} if trend == "ct" else {})
    fits = grouped_ols(lagged, keys, "x", xs, const=trend != "n")
    e = F.col("x") - F.coalesce(F.element_at("coef", "const"), F.lit(0.0)) - F.element_at("coef", "z") * F.col("z") - (F.element_at("coef", "t") * F.col("t") if trend == "ct" else 0.0)
    residuals = ranges.matched(lagged, fits.where("status = 'ok'").select(*keys, "coef"), keys).withColumn("e", e)
    lags = F.ceil(12 * F.pow((F.col("n") - 1) / 100.0, 0.25)).cast("int") if max_lags is None else F.lit(max_lags)
    most = max_lags if max_lags is not None else lagged.agg(F.max(lags)).first()[0] or 0
    variance = _variance(residuals, keys, order, "e", lags, most, rows)
    counts = lagged.groupBy(*keys).agg(F.max("n").alias("n_series"), F.max(lags).alias("n_lags"))
    found = ranges.matched(ranges.matched(fits.select(*keys, "n_obs", "sigma2", F.element_at("coef", "z").alias("b"), F.element_at("se", "z").alias("se")), variance, keys), counts, keys)
    n, lrv, g0, s = F.col("n_obs"), F.col("lrv"), F.col("g0"), F.sqrt("sigma2")
    z = F.sqrt(g0 / lrv) * (F.col("b") - 1) / F.col("se") - 0.5 * (lrv - g0) / F.sqrt(lrv) * n * F.col("se") / s
    found = found.withColumn("statistic", z).withColumn("p", dist.udf(dist.mackinnon_p, trend, 1)("statistic"))
    return _result(found, keys, "pp", trend, 4, F.col("p"), mackinnon_map(F.col("n_obs"), trend), F.col("p") < alpha)


def break_range(n: Column, trim: float) -> tuple[Column, Column]:
    """The first and the last candidate date by its place from 0: floor(trim n) to n - floor(trim n) - 1."""
    a = F.floor(n * trim).cast("int")
    return a, n - a - 1


def small_fits(xx: np.ndarray, xy: np.ndarray, yy: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients and their t of a stack of regressions given by cross-products, and which of them are regular."""
    inv, good = inverse(xx.copy())
    k = xx.shape[1]
    b = np.einsum("nij,nj->ni", inv, xy)
    b += np.einsum("nij,nj->ni", inv, xy - np.einsum("nij,nj->ni", xx, b))
    ssr = np.maximum(yy - 2 * np.einsum("ni,ni->n", b, xy) + np.einsum("ni,nij,nj->n", b, xx, b), 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return b, b / np.sqrt(np.einsum("nii->ni", inv) * (ssr / (n - k))[:, None]), good & (n > k)


def zivot_andrews(data: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "price", trend: str = "c", lags: int = 1, trim: float = 0.15, rows: int | None = None) -> DataFrame:
    """Zivot-Andrews (G4): the least t over break dates in the intercept, the trend or both; a fixed number of lags.

    The step and the ramp that begin at a date have cross-products that are totals less running sums of the columns and of
    time times the columns; each candidate date is one row with these sums, and one small solve.
    """
    values = _values(data, keys, order, value, rows)
    made = _lagged(values, keys, order, F.col("v") - F.col("v0"), lags, rows).where(F.col("have") >= lags)
    u = F.col("i").cast("double") / F.col("n")
    columns = [F.lit(1.0), F.col("z"), u, *[F.col(f"d{k}") for k in range(1, lags + 1)], F.col("d")]
    m = len(columns)
    made = made.select(*keys, *order, *([ranges.INDEX, ranges.LENGTH] if rows is not None else []), "i", "n", *[c.alias(f"c{j}") for j, c in enumerate(columns)])
    totals = made.groupBy(*keys).agg(F.count("*").alias("n_obs"), gram([F.col(f"c{j}") for j in range(m)]).alias("g"))
    if rows is not None:  # the first rows are gone
        made = made.withColumns({ranges.INDEX: F.col(ranges.INDEX) - lags - 1, ranges.LENGTH: F.col(ranges.LENGTH) - lags - 1})
    sums = {f"p{j}": F.col(f"c{j}") for j in range(m)} | {f"q{j}": F.col("c2") * F.col(f"c{j}") for j in range(m)}
    so_far = ranges.running(made, sums, keys, order, rows, inclusive=False)
    low, high = break_range(F.col("n"), trim)
    place = F.col("i") - 1
    tried = so_far.where((place >= low) & (place <= high))
    array = lambda s: F.array(*[F.coalesce(F.col(f"{s}{j}"), F.lit(0.0)) for j in range(m)]).alias(s)
    date = F.col(order[0]).cast("date")
    tried = ranges.matched(tried.select(*keys, place.cast("long").alias("break_at"), date.alias("break_date"), "n", array("p"), array("q")), totals, keys)
    step, ramp = trend in ("c", "ct"), trend in ("t", "ct")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            g = unpack(np.array(frame["g"].tolist(), float), m)
            s, t = g[:, 0, :] - np.array(frame["p"].tolist(), float), g[:, 2, :] - np.array(frame["q"].tolist(), float)
            at = (frame["break_at"] / frame["n"]).to_numpy(float)[:, None]
            # the products of a step and of a ramp u - at with every column, and with each other
            dummies = ([("step", s)] if step else []) + ([("ramp", t - at * s)] if ramp else [])
            own = {("step", "step"): s[:, 0], ("step", "ramp"): t[:, 0] - at[:, 0] * s[:, 0], ("ramp", "ramp"): t[:, 2] - 2 * at[:, 0] * t[:, 0] + at[:, 0] ** 2 * s[:, 0]}
            k = m - 1 + len(dummies)
            xx, xy = np.zeros((len(frame), k, k)), np.zeros((len(frame), k))
            xx[:, : m - 1, : m - 1], xy[:, : m - 1] = g[:, : m - 1, : m - 1], g[:, : m - 1, m - 1]
            for a, (name, products) in enumerate(dummies, m - 1):
                xx[:, a, : m - 1] = xx[:, : m - 1, a] = products[:, : m - 1]
                xy[:, a] = products[:, m - 1]
                for b, (other, _) in enumerate(dummies, m - 1):
                    xx[:, a, b] = own[(name, other) if (name, other) in own else (other, name)]
            _, tz, good = small_fits(xx, xy, g[:, m - 1, m - 1], frame["n_obs"].to_numpy(float))
            yield frame[[*keys, "break_at", "break_date", "n_obs"]].assign(tz=np.where(good, tz[:, 1], np.nan)).dropna(subset=["tz"])

    fits = tried.mapInPandas(run, f"{_head(values, keys)}, break_at long, break_date date, n_obs long, tz double".lstrip(", "))
    best = fits.groupBy(*keys).agg(F.min(F.struct("tz", "break_at", "n_obs", "break_date")).alias("m")).select(*keys, F.col("m.tz").alias("statistic"), F.col("m.break_at").alias("break_at"), F.col("m.n_obs").alias("n_obs"), F.col("m.break_date").alias("break_date"), F.lit(lags).alias("n_lags"))
    counts = values.groupBy(*keys).agg(F.max("n").alias("n_series"))
    found = ranges.matched(counts, best, keys, "left") if keys else counts.join(best, how="left")
    return _result(found, keys, "za", trend, 9, None, _levels(ZA[trend]), F.col("statistic") < ZA[trend][1])


def dfgls(data: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "price", trend: str = "c", max_lags: int = 4) -> DataFrame:
    """GLS-detrended ADF (G5): quasi-differences with 1 - 7/n (constant) or 1 - 13.5/n (line), then ADF without either."""
    rows = _values(data, keys, order, value)
    w = Window.partitionBy(*keys).orderBy(*order)
    a = 1 - F.lit(7.0 if trend == "c" else 13.5) / F.col("n")
    first = F.col("i") == 1
    quasi = lambda c: F.when(first, c).otherwise(c - a * F.lag(c).over(w))
    one, t = F.lit(1.0), F.col("i").cast("double")
    wide = rows.withColumns({"qy": quasi(F.col("v")), "q1": F.when(first, one).otherwise(1 - a), "qt": F.when(first, t).otherwise(t - a * (t - 1))})
    fits = grouped_ols(wide, keys, "qy", {"q1": F.col("q1")} | ({"qt": F.col("qt")} if trend == "ct" else {}), const=False)
    fitted = F.element_at("coef", "q1") + (F.element_at("coef", "qt") * t if trend == "ct" else 0.0)
    detrended = rows.join(fits.where("status = 'ok'").select(*keys, "coef"), list(keys)).withColumn("g", F.col("v") - fitted).select(*keys, *order, "g")
    found = adf_statistics(detrended, keys, order, "g", "n", max_lags)
    p = dist.udf(dist.mackinnon_p, "n", 1)("statistic") if trend == "c" else F.lit(None).cast("double")
    found = found.withColumn("p", p)
    return _result(found, keys, "dfgls", trend, 8, F.col("p"), _levels(DFGLS[trend]), F.col("statistic") < DFGLS[trend][1])


def all_tests(data: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "price", include_dfgls: bool = True, include_za: bool = True, max_lags: int = 4) -> DataFrame:
    """All tests as rows, with ``overall``: every test of the series finds it stationary."""
    parts = [adf(data, keys, order, value, max_lags=max_lags), phillips_perron(data, keys, order, value), kpss(data, keys, order, value, max_lags=max_lags)]
    parts += [dfgls(data, keys, order, value, max_lags=max_lags)] if include_dfgls else []
    parts += [zivot_andrews(data, keys, order, value)] if include_za else []
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumn("overall", F.bool_and("is_stationary").over(Window.partitionBy(*keys)))


def order_of_integration(data: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "price", max_diff: int = 2, max_lags: int = 4) -> DataFrame:
    """(keys, order_of_integration): the least number of differences at which ADF, KPSS and PP agree; max_diff + 1 if none."""
    rows = data.select(*keys, *order, F.col(value).alias("x"))
    w = Window.partitionBy(*keys).orderBy(*order)
    stages, now = [], rows
    for d in range(max_diff + 1):
        stages.append(now.select(*keys, *order, F.lit(d).alias("n_diff"), "x").where("x is not null"))
        now = now.withColumn("x", F.col("x") - F.lag("x").over(w))
    batch, k = reduce(DataFrame.unionAll, stages), [*keys, "n_diff"]
    ok = reduce(DataFrame.unionByName, [f.select(*k, "is_stationary") for f in (adf(batch, k, order, "x", max_lags=max_lags), kpss(batch, k, order, "x", max_lags=max_lags), phillips_perron(batch, k, order, "x"))])
    met = ok.groupBy(*k).agg(F.bool_and(F.coalesce("is_stationary", F.lit(False))).alias("ok"))
    return met.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("ok"), F.col("n_diff"))), F.lit(max_diff + 1)).alias("order_of_integration"))


def verdicts(data: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "price", max_lags: int = 4) -> DataFrame:
    """(keys, adf_ok, kpss_ok, verdict): the two-by-two reading of ADF and KPSS."""
    a = adf(data, keys, order, value, max_lags=max_lags).select(*keys, F.col("is_stationary").alias("adf_ok"), F.col("p_value").alias("adf_p"))
    k = kpss(data, keys, order, value, max_lags=max_lags).select(*keys, F.col("is_stationary").alias("kpss_ok"))
    a_, k_ = F.col("adf_ok"), F.col("kpss_ok")
    word = F.when(a_ & k_, "Stationary").when(a_ & ~k_, "Difference stationary").when(~a_ & k_, "Trend stationary").when(~a_ & ~k_, "Non-stationary")
    return a.join(k, list(keys)).withColumn("verdict", word)


def _candidates(data: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, season: int) -> DataFrame:
    """(keys, order, rank, transform, x): the series under each transformation."""
    w = Window.partitionBy(*keys).orderBy(*order)
    least = F.min(value).over(Window.partitionBy(*keys))
    log = F.log(F.col(value) + F.when(least <= 0, F.abs(least) + 1).otherwise(0.0))
    made = data.withColumn("_l", log)
    made = made.withColumn("_d", F.col(value) - F.lag(value).over(w))
    forms = {"none": F.col(value).cast("double"), "log": F.col("_l"), "diff1": F.col("_d"), "log_diff1": F.col("_l") - F.lag("_l").over(w), "diff2": F.col("_d") - F.lag("_d").over(w), "seasonal_diff": F.col(value) - F.lag(value, season).over(w)}
    wide = made.select(*keys, *order, *[c.alias(f"_{n}") for n, c in forms.items()])
    rows = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(n).alias("transform"), F.col(f"_{n}").alias("x")) for i, n in enumerate(forms)])
    return wide.select(*keys, *order, F.explode(rows).alias("r")).select(*keys, *order, "r.*").where("x is not null")


def make_stationary(data: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "price", max_lags: int = 4) -> DataFrame:
    """(keys, order, transform, x): the first of none, log, diff1, log_diff1, diff2 that ADF and KPSS call stationary.

    Where none is, diff1.
    """
    batch = _candidates(data, keys, order, value, 12).where("transform != 'seasonal_diff'")
    found = verdicts(batch, [*keys, "rank", "transform"], order, "x", max_lags).where("verdict = 'Stationary'")
    best = found.groupBy(*keys).agg(F.min("rank").alias("best"))
    chosen = data.select(*keys).distinct().join(best, list(keys), "left").withColumn("rank", F.coalesce("best", F.lit(2))).drop("best")
    return batch.join(chosen, [*keys, "rank"]).drop("rank")


def recommend(data: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "price", max_lags: int = 4, season: int = 12) -> DataFrame:
    """(keys, transform, adf_p): of log, diff1, seasonal diff (from 24 rows) and log diff, the stationary one of least p (F8)."""
    n = data.groupBy(*keys).agg(F.count(value).alias("n"))
    batch = _candidates(data, keys, order, value, season).where(F.col("transform").isin("log", "diff1", "seasonal_diff", "log_diff1")).join(n, list(keys)).where("transform != 'seasonal_diff' or n >= 24").drop("n")
    found = verdicts(batch, [*keys, "transform"], order, "x", max_lags).where("verdict = 'Stationary'")
    best = found.groupBy(*keys).agg(F.min_by("transform", F.struct("adf_p", "transform")).alias("transform"), F.min("adf_p").alias("adf_p"))
    return data.select(*keys).distinct().join(best, list(keys), "left")


def apply_recommended(data: DataFrame, recommended: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "price", season: int = 12) -> DataFrame:
    """(keys, order, transform, x): each series under its recommended transformation; as it is where there is none (F8)."""
    batch = _candidates(data, keys, order, value, season)
    return batch.join(recommended.select(*keys, F.coalesce("transform", F.lit("none")).alias("transform")), [*keys, "transform"]).drop("rank")


