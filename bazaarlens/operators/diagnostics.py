"""Residual diagnostics and distribution tests for all groups at once (M).  One row per group, unless a lag is a key."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations_with_replacement, product

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions import dist
from bazaarlens.operators import unitroot
from bazaarlens.operators.ols import grouped_ols


def breusch_pagan(data: DataFrame, residual: str, xs: Sequence[str], keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """(keys, lm, p_lm, f, p_f, heteroskedastic): squared residuals over their mean, on the regressors (M1)."""
    scaled = F.pow(F.col(residual), 2) / F.avg(F.pow(F.col(residual), 2)).over(Window.partitionBy(*keys))
    return _auxiliary(data.withColumn("_u", scaled), {x: F.col(x) for x in xs}, keys, alpha)


def white(data: DataFrame, residual: str, xs: Sequence[str], keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """The same on regressors, squares and cross products (M2)."""
    terms = {x: F.col(x) for x in xs} | {f"{a}*{b}": F.col(a) * F.col(b) for a, b in combinations_with_replacement(xs, 2)}
    return _auxiliary(data.withColumn("_u", F.pow(F.col(residual), 2)), terms, keys, alpha)


def _auxiliary(data: DataFrame, terms: dict, keys: Sequence[str], alpha: float) -> DataFrame:
    q = float(len(terms))
    fits = grouped_ols(data, keys, "_u", terms)
    f = F.col("r2") / q / ((1 - F.col("r2")) / F.col("df"))
    out = fits.withColumns({"lm": F.col("n_obs") * F.col("r2"), "f": f})
    out = out.withColumns({"p_lm": dist.chi2_p("lm", F.lit(q)), "p_f": dist.f_p("f", F.lit(q), "df")})
    return out.select(*keys, "lm", "p_lm", "f", "p_f", (F.col("p_lm") < alpha).alias("heteroskedastic"))


def goldfeld_quandt(data: DataFrame, residual: str, by: str, keys: Sequence[str], order: Sequence[str], drop: float = 0.2, alpha: float = 0.05) -> DataFrame:
    """(keys, f, p, heteroskedastic): variance (ddof 0) of the residuals above over below the dropped middle (M3)."""
    rows = data.withColumns({"_i": F.row_number().over(Window.partitionBy(*keys).orderBy(by, *order)), "_n": F.count("*").over(Window.partitionBy(*keys))})
    half = F.floor((F.col("_n") - F.floor(F.col("_n") * drop)) / 2)
    low, high = F.col("_i") <= half, F.col("_i") > F.col("_n") - half
    out = rows.groupBy(*keys).agg(F.var_pop(F.when(low, F.col(residual))).alias("v1"), F.var_pop(F.when(high, F.col(residual))).alias("v2"), F.max(half).alias("h"))
    out = out.withColumn("f", F.col("v2") / F.nullif(F.col("v1"), F.lit(0.0))).withColumn("p", dist.f_p("f", F.col("h") - 1, F.col("h") - 1))
    return out.select(*keys, "f", "p", (F.col("p") < alpha).alias("heteroskedastic"))


def breusch_godfrey(data: DataFrame, residual: str, keys: Sequence[str], order: Sequence[str], lags: int = 4, xs: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """(keys, lm, p, serial_correlation): residuals on their lags (and regressors); the first rows are dropped (M4)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = data.withColumns({f"_e{k}": F.lag(residual, k).over(w) for k in range(1, lags + 1)})
    fits = grouped_ols(rows, keys, residual, [*[f"_e{k}" for k in range(1, lags + 1)], *xs])
    out = fits.withColumn("lm", F.col("n_obs") * F.col("r2")).withColumn("p", dist.chi2_p("lm", F.lit(float(lags))))
    return out.select(*keys, "lm", "p", (F.col("p") < alpha).alias("serial_correlation"))


def _autocovariances(data: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], lags: int) -> DataFrame:
    """(keys, n, s0, lag, s): sums of squares and of lagged products around the mean."""
    rows = data.where(F.col(value).isNotNull()).withColumn("_e", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumns({f"_e{k}": F.lag("_e", k).over(w) for k in range(1, lags + 1)})
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.pow("_e", F.lit(2))).alias("s0"), F.array(*[F.coalesce(F.sum(F.col("_e") * F.col(f"_e{k}")), F.lit(0.0)) for k in range(1, lags + 1)]).alias("_s"))
    return sums.select(*keys, "n", "s0", F.posexplode("_s").alias("lag", "s")).withColumn("lag", F.col("lag") + 1)


def ljung_box(data: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], lags: int = 10, alpha: float = 0.05) -> DataFrame:
    """(keys, lag, q, p, autocorrelated) for each number of lags (M5)."""
    rows = _autocovariances(data, value, keys, order, lags).where("lag < n")
    term = F.pow(F.col("s") / F.nullif(F.col("s0"), F.lit(0.0)), 2) / (F.col("n") - F.col("lag"))
    q = F.col("n") * (F.col("n") + 2) * F.sum(term).over(Window.partitionBy(*keys).orderBy("lag"))
    out = rows.withColumn("q", q).withColumn("p", dist.chi2_p("q", F.col("lag").cast("double")))
    return out.select(*keys, "lag", "q", "p", (F.col("p") < alpha).alias("autocorrelated"))


def durbin_watson(data: DataFrame, residual: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(keys, dw, p null, autocorrelated): flagged below 1.5 and above 2.5 (M6)."""
    d = F.col(residual) - F.lag(residual).over(Window.partitionBy(*keys).orderBy(*order))
    out = data.where(F.col(residual).isNotNull()).withColumn("_d", d).groupBy(*keys).agg((F.sum(F.pow("_d", F.lit(2))) / F.nullif(F.sum(F.pow(F.col(residual), 2)), F.lit(0.0))).alias("dw"))
    return out.select(*keys, "dw", F.lit(None).cast("double").alias("p"), ((F.col("dw") < 1.5) | (F.col("dw") > 2.5)).alias("autocorrelated"))


def jarque_bera(data: DataFrame, value: str, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """(keys, jb, p, skew, kurtosis, normal) from population moments (M7)."""
    out = data.groupBy(*keys).agg(F.count(value).alias("n"), F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurtosis"))
    jb = F.col("n") / 6 * (F.pow("skew", F.lit(2)) + F.pow(F.col("kurtosis") - 3, 2) / 4)
    return out.withColumn("jb", jb).withColumn("p", dist.chi2_p("jb", F.lit(2.0))).select(*keys, "jb", "p", "skew", "kurtosis", (F.col("p") >= alpha).alias("normal"))


def _sorted(data: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    rows = data.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    return rows.withColumns({"_i": F.row_number().over(Window.partitionBy(*keys).orderBy("_v")), "_n": F.count("*").over(Window.partitionBy(*keys))})


def shapiro_wilk(data: DataFrame, value: str, keys: Sequence[str], alpha: float = 0.05, most: int = 5000) -> DataFrame:
    """(keys, w, p, normal, status) by Royston (1995); 3 to ``most`` values, else a status (M8)."""
    rows = _sorted(data, value, keys).withColumn("_m", dist.normal_quantile((F.col("_i") - 0.375) / (F.col("_n") + 0.25)))
    whole = Window.partitionBy(*keys)
    rows = rows.withColumns({"_ss": F.sum(F.pow("_m", F.lit(2))).over(whole), "_m1": F.max("_m").over(whole), "_m2": F.max(F.when(F.col("_i") == F.col("_n") - 1, F.col("_m"))).over(whole)})
    u = 1 / F.sqrt("_n")
    poly = lambda c, x: reduce(lambda s, k: s * x + k, c[1:], F.lit(c[0]))
    # Royston's polynomials in 1 / sqrt(n) for the two outer weights.
    a1 = poly([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157], u) * u + F.col("_m1") / F.sqrt("_ss")
    a2 = poly([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981], u) * u + F.col("_m2") / F.sqrt("_ss")
    rows = rows.withColumns({"_a1": F.when(F.col("_n") == 3, math.sqrt(0.5)).otherwise(a1), "_a2": a2})
    two = F.col("_n") > 5
    phi = F.when(two, (F.col("_ss") - 2 * F.col("_m1") ** 2 - 2 * F.col("_m2") ** 2) / (1 - 2 * F.col("_a1") ** 2 - 2 * F.col("_a2") ** 2)).otherwise((F.col("_ss") - 2 * F.col("_m1") ** 2) / (1 - 2 * F.col("_a1") ** 2))
    side = F.when(F.col("_i") * 2 > F.col("_n") + 1, 1.0).otherwise(-1.0)
    outer = F.greatest(F.col("_i"), F.col("_n") + 1 - F.col("_i"))
    weight = F.when(outer == F.col("_n"), side * F.col("_a1")).when(two & (outer == F.col("_n") - 1), side * F.col("_a2")).otherwise(F.when(F.col("_n") == 3, 0.0).otherwise(F.col("_m") / F.sqrt(phi)))
    out = rows.withColumn("_w", weight).groupBy(*keys).agg(F.max("_n").alias("n"), F.pow(F.sum(F.col("_w") * F.col("_v")), 2).alias("b"), ((F.count("*") - 1) * F.var_samp("_v")).alias("s"))
    out = out.withColumn("w", F.least(F.lit(1.0), F.col("b") / F.nullif(F.col("s"), F.lit(0.0))))
    n, ln = F.col("n").cast("double"), F.log("n")
    small = n <= 11
    gamma = -2.273 + 0.459 * n
    y = F.when(small, -F.log(gamma - F.log(1 - F.col("w")))).otherwise(F.log(1 - F.col("w")))
    # Royston's normalising polynomials.
    mu = F.when(small, poly([-0.0006714, 0.025054, -0.39978, 0.5440], n)).otherwise(poly([0.0038915, -0.083751, -0.31082, -1.5861], ln))
    sd = F.exp(F.when(small, poly([-0.0020322, 0.062767, -0.77857, 1.3822], n)).otherwise(poly([0.0030302, -0.082676, -0.4803], ln)))
    out = out.withColumn("_z", (y - mu) / sd)
    three = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.asin(F.sqrt("w")) - math.asin(math.sqrt(0.75))) * 6 / math.pi))
    out = out.withColumn("p", F.when(F.col("n") == 3, three).otherwise(1 - dist.normal_cdf("_z")))
    ok = F.col("n").between(3, most) & F.col("w").isNotNull()
    return out.select(*keys, F.when(ok, F.col("w")).alias("w"), F.when(ok, F.col("p")).alias("p"), F.when(ok, F.col("p") >= alpha).alias("normal"), F.when(ok, "ok").when(F.col("n") < 3, "insufficient_data").when(F.col("n") > most, "too_many_rows").otherwise("singular").alias("status"))


def anderson_darling(data: DataFrame, value: str, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """(keys, a2, critical, normal): against the normal of the group's mean and deviation (M9)."""
    whole = Window.partitionBy(*keys)
    rows = _sorted(data, value, keys).withColumn("_z", (F.col("_v") - F.avg("_v").over(whole)) / F.nullif(F.stddev_samp("_v").over(whole), F.lit(0.0)))
    rows = rows.withColumns({"_f": dist.normal_cdf("_z"), "_g": dist.normal_cdf(-F.col("_z"))})
    i = F.col("_i")
    out = rows.groupBy(*keys).agg(F.max("_n").alias("n"), F.sum((2 * i - 1) * F.log("_f") + (2 * (F.col("_n") - i) + 1) * F.log("_g")).alias("s"))
    n = F.col("n").cast("double")
    # Critical values at 15, 10, 5, 2.5 and 1 % (Stephens 1974), for the adjusted statistic.
    table = {0.15: 0.576, 0.10: 0.656, 0.05: 0.787, 0.025: 0.918, 0.01: 1.092}
    level = min(table, key=lambda a: abs(a - alpha))
    out = out.withColumns({"a2": -n - F.col("s") / n, "critical": F.lit(table[level]) / (1 + 4 / n - 25 / n / n)})
    return out.select(*keys, "a2", "critical", (F.col("a2") < F.col("critical")).alias("normal"))


def kolmogorov_smirnov(data: DataFrame, value: str, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """(keys, d, p, normal): against N(0, 1), values as they are (M10); the asymptotic p."""
    rows = _sorted(data, value, keys).withColumn("_f", dist.normal_cdf("_v"))
    gap = F.greatest(F.col("_i") / F.col("_n") - F.col("_f"), F.col("_f") - (F.col("_i") - 1) / F.col("_n"))
    out = rows.groupBy(*keys).agg(F.max(gap).alias("d"), F.max("_n").alias("n"))

    def tail(d, n):
        x = d * (np.sqrt(n) + 0.12 + 0.11 / np.sqrt(n))
        p = 2 * sum((-1) ** (k - 1) * np.exp(-2 * k * k * x * x) for k in range(1, 101))
        return np.where(x < 0.2, 1.0, np.clip(p, 0, 1))

    out = out.withColumn("p", dist.udf(tail)("d", "n"))
    return out.select(*keys, "d", "p", (F.col("p") >= alpha).alias("normal"))


def sensitivity(model: Callable[..., DataFrame], data: DataFrame, grid: dict[str, Sequence]) -> DataFrame:
    """The results of ``model(data, **parameters)`` for all combinations, with the parameters as columns.

    Each call only adds a plan; Spark runs them as one union.
    """
    parts = []
    for values in product(*grid.values()):
        found = model(data, **dict(zip(grid, values, strict=True)))
        parts.append(found.withColumns({f"param_{k}": F.lit(v) for k, v in zip(grid, values, strict=True)}))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def all_diagnostics(data: DataFrame, residual: str, xs: Sequence[str], keys: Sequence[str], order: Sequence[str], lags: int = 4, alpha: float = 0.05) -> DataFrame:
    """(keys, heteroskedastic, serial_correlation, autocorrelated, normal, stationary, valid, issues)."""
    tests = {
        "heteroskedastic": breusch_pagan(data, residual, xs, keys, alpha).select(*keys, "heteroskedastic"),
        "serial_correlation": breusch_godfrey(data, residual, keys, order, lags, alpha=alpha).select(*keys, "serial_correlation"),
        "autocorrelated": ljung_box(data, residual, keys, order, lags, alpha).where(F.col("lag") == lags).select(*keys, "autocorrelated"),
        "normal": jarque_bera(data, residual, keys, alpha).select(*keys, "normal"),
        "stationary": unitroot.adf(data, keys, order, residual, "c", 10, alpha).select(*keys, F.col("is_stationary").alias("stationary")),
    }
    out = reduce(lambda a, b: a.join(b, list(keys), "left"), tests.values())
    bad = {"heteroskedasticity": F.col("heteroskedastic"), "serial correlation": F.col("serial_correlation"), "autocorrelation": F.col("autocorrelated"), "non-normality": ~F.col("normal"), "non-stationarity": ~F.col("stationary")}
    issues = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in bad.items()]), lambda x: x.isNotNull())
    return out.withColumn("issues", issues).withColumn("valid", F.size("issues") == 0)
