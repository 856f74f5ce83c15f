"""Lags, rolling windows, differences, scaling and exchange-rate regimes (F).

Order is explicit everywhere: keys name the series, order the time and what breaks its ties.  ``rows``, where it is given, is
the number of rows of the ranges into which a long series is cut (see ``ranges``); results don't depend on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.operators import clean, ranges


def lags(data: DataFrame, columns: Sequence[str], ks: Sequence[int], keys: Sequence[str], order: Sequence[str], rows: int | None = None) -> DataFrame:
    """``c_lag_k`` (F1); a negative k leads."""
    part = ranges.cut(data, keys, order, rows, max(0, *ks), max(0, *[-k for k in ks]))
    return part.own(part.data.withColumns({f"{c}_lag_{k}": F.lag(c, k).over(part.window()) for c in columns for k in ks}))


def rolling(data: DataFrame, columns: Sequence[str], windows: Sequence[int], keys: Sequence[str], order: Sequence[str], functions: Sequence[str] = ("mean", "std", "min", "max"), rows: int | None = None) -> DataFrame:
    """``c_roll_w_f`` over the last w rows, from one row on (F2)."""
    made = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "median": lambda c: F.percentile(c, 0.5)}
    part = ranges.cut(data, keys, order, rows, max(windows) - 1)
    return part.own(part.data.withColumns({f"{c}_roll_{n}_{f}": made[f](F.col(c)).over(part.window().rowsBetween(-(n - 1), 0)) for c in columns for n in windows for f in functions}))


def differences(data: DataFrame, columns: Sequence[str], keys: Sequence[str], order: Sequence[str], periods: Sequence[int] = (1,), seasonal: int | None = None, rows: int | None = None) -> DataFrame:
    """``c_diff_k``; with a season also ``c_sdiff_s`` and ``c_diff1_sdiff_s``."""
    part = ranges.cut(data, keys, order, rows, max(*periods, (seasonal or 0) + 1))
    w = part.window()
    out = {f"{c}_diff_{k}": F.col(c) - F.lag(c, k).over(w) for c in columns for k in periods}
    if seasonal:
        for c in columns:
            out[f"{c}_sdiff_{seasonal}"] = F.col(c) - F.lag(c, seasonal).over(w)
            out[f"{c}_diff1_sdiff_{seasonal}"] = F.col(c) - F.lag(c, seasonal).over(w) - (F.lag(c, 1).over(w) - F.lag(c, seasonal + 1).over(w))
    return part.own(part.data.withColumns(out))


def pct_changes(data: DataFrame, columns: Sequence[str], keys: Sequence[str], order: Sequence[str], periods: Sequence[int] = (1,), rows: int | None = None) -> DataFrame:
    """``c_pct_k``: the change over k rows, after nulls took the last value."""
    placed = data if rows is None else ranges.numbered(data, keys, order)
    filled = ranges.known(placed, {f"_p_{c}": F.col(c) for c in columns}, keys, order, rows)
    part = ranges.cut(filled, keys, order, rows, max(periods))
    out = part.data.withColumns({f"{c}_pct_{k}": F.col(f"_p_{c}") / F.nullif(F.lag(f"_p_{c}", k).over(part.window()), F.lit(0.0)) - 1 for c in columns for k in periods})
    return part.own(out).drop(*[f"_p_{c}" for c in columns])


def log_transform(data: DataFrame, columns: Sequence[str], add: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """``c_log``: ln(x + add), and |min| + 1 more where the least value isn't positive."""
    ends = data.groupBy(*keys).agg(*[F.min(c).alias(f"_m_{c}") for c in columns])
    out = data.join(ends, list(keys)) if keys else data.crossJoin(F.broadcast(ends))
    shift = lambda c: F.when(F.col(f"_m_{c}") <= 0, F.abs(F.col(f"_m_{c}")) + 1).otherwise(0.0) + add
    return out.withColumns({f"{c}_log": F.log(F.col(c) + shift(c)) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def scale_parameters(data: DataFrame, columns: Sequence[str], method: str = "standard", keys: Sequence[str] = (), ddof: int = 0) -> DataFrame:
    """(keys, c_centre, c_width): what ``scale`` takes, to be saved and used on other rows."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    made: list[Column] = []
    table = data
    for i, c in enumerate(columns):
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        if method == "robust" and not keys:
            table = table.crossJoin(F.broadcast(clean.quantiles(data, c, (0.25, 0.5, 0.75), f"_q{i}")))  # one row
            q = F.any_value(f"_q{i}")
        centre, width = {"standard": (F.avg(c), std(c)), "minmax": (F.min(c), F.max(c) - F.min(c)), "robust": (q[1], q[2] - q[0])}[method]
        made += [centre.cast("double").alias(f"{c}_centre"), width.cast("double").alias(f"{c}_width")]
    return table.groupBy(*keys).agg(*made)


def scale(data: DataFrame, parameters: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), suffix: str = "_norm") -> DataFrame:
    """``c_norm``: (x - centre) / width, null where the width is zero."""
    out = data.join(parameters, list(keys)) if keys else data.crossJoin(F.broadcast(parameters))  # one row without keys
    return out.withColumns({f"{c}{suffix}": (F.col(c) - F.col(f"{c}_centre")) / F.nullif(F.col(f"{c}_width"), F.lit(0.0)) for c in columns}).drop(*[f"{c}_{p}" for c in columns for p in ("centre", "width")])


def normalize(data: DataFrame, columns: Sequence[str], method: str = "standard", keys: Sequence[str] = ()) -> DataFrame:
    """Fit and apply, with the sample standard deviation."""
    return scale(data, scale_parameters(data, columns, method, keys, ddof=1), columns, keys)


def fill(data: DataFrame, column: str, keys: Sequence[str], order: Sequence[str], directions: Sequence[str] = ("forward", "backward"), rows: int | None = None) -> DataFrame:
    """Nulls take the last value, then the next one."""
    out = data if rows is None else ranges.numbered(data, keys, order)
    for d in directions:
        out = ranges.known(out, {f"_{d}": F.col(column)}, keys, order, rows, following=d == "backward")
    out = out.withColumn(column, F.coalesce(*[f"_{d}" for d in directions])).drop(*[f"_{d}" for d in directions])
    return out.drop(ranges.INDEX, ranges.LENGTH) if rows is not None else out


def regime_rates(data: DataFrame, regime: str, rates: Sequence[str], price: str = "price") -> DataFrame:
    """``price_adj``: the price over the rate that the regime column (from 0) names."""
    rate = F.get(F.array(*rates), F.col(regime).cast("int"))
    return data.withColumn(f"{price}_adj", F.try_divide(price, rate))


def inferred_regimes(data: DataFrame, rate_a: str, rate_b: str, keys: Sequence[str], order: Sequence[str], price: str = "price", threshold: float = 3.0, width: int = 10, rows: int | None = None) -> DataFrame:
    """``regime`` and ``price_adj`` (F13): a ratio far from its trailing mean toggles the regime; the first row doesn't."""
    part = ranges.cut(data.withColumn("_r", F.col(rate_a) / F.nullif(F.col(rate_b), F.lit(0.0))), keys, order, rows, width - 1)
    frame = part.window().rowsBetween(-(width - 1), 0)
    z = F.abs(F.col("_r") - F.avg("_r").over(frame)) / (F.stddev_samp("_r").over(frame) + 1e-8)
    out = part.own(part.data.withColumn("_t", F.when((part.index() > 0) & (z > threshold), 1).otherwise(0)), True)
    out = ranges.running(out, {"regime": F.col("_t")}, keys, order, rows).withColumn("regime", (F.col("regime") % 2).cast("int"))
    return regime_rates(out, "regime", [rate_a, rate_b], price).drop("_r", "_t", *([ranges.INDEX, ranges.LENGTH] if rows is not None else []))


def steadiest_rate(data: DataFrame, rates: Sequence[str], keys: Sequence[str], order: Sequence[str], price: str = "price", width: int = 10, rows: int | None = None) -> DataFrame:
    """``regime`` and ``price_adj`` by the rate of least rolling variation around the row, the first on ties."""
    part = ranges.cut(data, keys, order, rows, width // 2, width // 2)
    frame = part.window().rowsBetween(-(width // 2), width // 2)
    found = part.own(part.data.withColumns({f"_cv{i}": F.coalesce(F.stddev_samp(r).over(frame) / F.nullif(F.avg(r).over(frame), F.lit(0.0)), F.lit(float("inf"))) for i, r in enumerate(rates)}))
    least = F.array_min(F.array(*[F.struct(F.col(f"_cv{i}").alias("cv"), F.lit(i).alias("i")) for i in range(len(rates))]))
    out = found.withColumn("regime", least["i"]).drop(*[f"_cv{i}" for i in range(len(rates))])
    return regime_rates(out, "regime", rates, price)


def momentum(data: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], kind: str = "standard", lag: int = 1, alpha: float = 0.5, name: str = "momentum", rows: int | None = None) -> DataFrame:
    """The momentum of a series z (F15): a lagged difference; the mean of the last max(2, lag); or their running EWMA.

    The EWMA starts at the first difference and takes alpha of each later one, up to the row before; it is exact for every
    alpha, see ``ranges.smoothed``.
    """
    if kind not in ("standard", "moving_average", "exponential"):
        raise ValueError(f"unknown momentum {kind}")
    n = max(2, lag)
    part = ranges.cut(data, keys, order, rows, n + 1)
    w = part.window()
    out = part.data.withColumn("_d", F.col(value) - F.lag(value).over(w))
    if kind == "standard":
        return part.own(out.withColumn(name, F.lag("_d", lag).over(w)).drop("_d"))
    if kind == "moving_average":
        frame = w.rowsBetween(-n, -1)
        return part.own(out.withColumn(name, F.when(F.count("_d").over(frame) == n, F.avg("_d").over(frame))).drop("_d"))
    smooth = ranges.smoothed(part.own(out, True), "_d", "_s", keys, order, alpha, rows)
    last = ranges.cut(smooth, keys, order, rows, 1)
    return last.own(last.data.withColumn(name, F.lag("_s").over(last.window())).drop("_d", "_s"))


def heaviside(data: DataFrame, z: str, q: str, tau: Column | float) -> DataFrame:
    """``above`` = I(q >= tau), and z times it and its complement (F16)."""
    tau = tau if isinstance(tau, Column) else F.lit(tau)
    above = F.when(F.col(q) >= tau, 1.0).when(F.col(q).isNotNull(), 0.0)
    return data.withColumns({"above": above, f"{z}_above": F.col(z) * above, f"{z}_below": F.col(z) * (1 - above)})


def decompose(data: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], period: int = 12, model: str = "additive", rows: int | None = None) -> DataFrame:
    """``trend`` (centred moving average over one period), ``seasonal`` and ``resid``."""
    half = period // 2
    part = ranges.cut(data, keys, order, rows, half, half)
    w = part.window()
    v = F.col(value)
    wide = w.rowsBetween(-half, half)
    whole = F.count(value).over(wide) == 2 * half + 1
    if period % 2:
        centre = F.avg(value).over(wide)
    else:
        ends = (F.lag(value, half).over(w) + F.lead(value, half).over(w)) / 2
        centre = (F.sum(value).over(w.rowsBetween(-(half - 1), half - 1)) + ends) / period
    out = part.own(part.data.withColumn("trend", F.when(whole, centre)).withColumn("_ph", part.index() % period))
    off = v - F.col("trend") if model == "additive" else v / F.nullif(F.col("trend"), F.lit(0.0))
    phase = out.withColumn("_off", off).groupBy(*keys, "_ph").agg(F.avg("_off").alias("_s"))
    mean = phase.groupBy(*keys).agg(F.avg("_s").alias("_sm"))
    phase = phase.join(mean, list(keys)).withColumn("seasonal", F.col("_s") - F.col("_sm") if model == "additive" else F.col("_s") / F.col("_sm")).drop("_s", "_sm")
    out = out.join(phase, [*keys, "_ph"]).drop("_ph")
    rest = v - F.col("trend") - F.col("seasonal") if model == "additive" else v / F.col("trend") / F.col("seasonal")
    return out.withColumn("resid", rest)


def acf(data: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], lags_: int = 40, rows: int | None = None) -> DataFrame:
    """(keys, lag, acf) up to ``lags_`` or the length of the series (F18): one window pass, then sums per lag."""
    some = data.where(F.col(value).isNotNull())
    some = ranges.matched(some, some.groupBy(*keys).agg(F.avg(value).alias("_m"), F.count("*").alias("_n")), list(keys)).withColumn("_e", F.col(value) - F.col("_m"))
    part = ranges.cut(some.select(*keys, *order, "_n", "_e"), keys, order, rows, lags_)
    w = part.window()
    shifted = part.data.select(*keys, "_n", "_e", *([ranges.OWN] if part.ranged else []), *[F.lag("_e", k).over(w).alias(f"_l{k}") for k in range(1, lags_ + 1)])
    sums = (shifted.where(ranges.OWN) if part.ranged else shifted).groupBy(*keys).agg(F.first("_n").alias("_n"), F.sum(F.col("_e") * F.col("_e")).alias("_s"), F.array(F.lit(1.0), *[F.coalesce(F.sum(F.col("_e") * F.col(f"_l{k}")), F.lit(0.0)) for k in range(1, lags_ + 1)]).alias("_p"))
    out = sums.select(*keys, "_n", "_s", F.posexplode("_p").alias("lag", "_v")).where("lag < _n")
    return out.select(*keys, "lag", F.when(F.col("lag") == 0, 1.0).otherwise(F.col("_v") / F.nullif(F.col("_s"), F.lit(0.0))).alias("acf"))


def pacf(correlations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, lag, pacf) from an ACF table, by the Durbin-Levinson recursion on each series' few numbers."""
    import numpy as np
    import pandas as pd

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in correlations.select(*keys).schema) + ", lag int, pacf double"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("lag")
        r = frame["acf"].to_numpy(float)
        out, phi = [1.0], np.zeros(0)
        for k in range(1, len(r)):
            den = 1 - phi @ r[1:k]
            new = (r[k] - phi @ r[1:k][::-1]) / den if den else np.nan
            phi = np.append(phi - new * phi[::-1], new)
            out.append(float(new))
        return pd.concat([frame[list(keys)].reset_index(drop=True), pd.DataFrame({"lag": frame["lag"].to_numpy(), "pacf": out})], axis=1)

    return correlations.groupBy(*keys).applyInPandas(run, schema)


def qq(data: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], rows: int | None = None) -> DataFrame:
    """(keys, i, sample, theoretical): ordered values and normal quantiles at (i - 0.5) / n."""
    from bazaarlens.functions import dist

    some = data.where(F.col(value).isNotNull())
    if rows is None:
        some = some.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(value, *order)))
        some = some.join(some.groupBy(*keys).agg(F.count("*").alias("_n")), list(keys))
    else:
        some = ranges.numbered(some, keys, [value, *order]).withColumns({"i": F.col(ranges.INDEX) + 1, "_n": F.col(ranges.LENGTH)})
    return some.select(*keys, "i", F.col(value).alias("sample"), dist.normal_quantile((F.col("i") - 0.5) / F.col("_n")).alias("theoretical"))
