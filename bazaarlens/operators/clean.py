"""Imputation, outliers, scaling and data quality (C).

Whole-table statistics are one-row aggregates joined back by broadcast, grouped ones a join on the group; there is no
window without a partition key over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.operators import ranges
from bazaarlens.operators.local_lines import local_lines
from bazaarlens.plans.lineage import saved


def _stats(data: DataFrame, aggregates: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """``data`` with aggregates of its group (or of the whole table: one row)."""
    columns = [c.alias(n) for n, c in aggregates.items()]
    if keys:
        return data.join(data.groupBy(*keys).agg(*columns), list(keys))
    return data.crossJoin(F.broadcast(data.agg(*columns)))


def cumulated(data: DataFrame, column: str) -> DataFrame:
    """(column, _c, _before): distinct values, how often each comes, and how many rows are less.

    Values are placed by range partitions, each of which starts from the rows of those before it.
    """
    counts = data.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_c"))
    placed = saved(counts.repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    offsets = placed.groupBy("_part").agg(F.sum("_c").alias("_s"))
    offsets = offsets.withColumn("_less", F.sum("_s").over(Window.orderBy("_part")) - F.col("_s")).drop("_s")  # a row per partition
    inner = F.sum("_c").over(Window.partitionBy("_part").orderBy(column)) - F.col("_c")
    return placed.withColumn("_in", inner).join(F.broadcast(offsets), "_part").select(column, "_c", (F.col("_less") + F.col("_in")).alias("_before"))


def quantiles(data: DataFrame, column: str, levels: Sequence[float], name: str = "_q") -> DataFrame:
    """One row with an array: exact quantiles of the table, with straight lines between values, from ranks in ranges."""
    values = cumulated(data, column)
    n = values.agg(F.sum("_c").alias("_n"))
    found = values.crossJoin(F.broadcast(n))  # one row
    at = lambda place: F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_c")), F.col(column).cast("double")))
    places = [F.lit(p) * (F.col("_n") - 1) for p in levels]
    ends = found.agg(*[at(f(x)).alias(f"_{s}{i}") for i, x in enumerate(places) for s, f in (("lo", F.floor), ("hi", F.ceil))], F.max("_n").alias("_n"))
    part = lambda x: x - F.floor(x)
    return ends.select(F.array(*[F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * part(x) for i, x in enumerate(places)]).alias(name))


def _with_quantiles(data: DataFrame, name: str, column: str, levels: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """``data`` with an array of quantiles of its group, or of the table."""
    if keys:
        return _stats(data, {name: F.percentile(column, F.array(*map(F.lit, levels)))}, keys)
    return data.crossJoin(F.broadcast(quantiles(data, column, levels, name)))  # one row


def interpolate(data: DataFrame, value: str = "price", keys: Sequence[str] = ("market",), order: Sequence[str] = ("date",), rows: int | None = None) -> DataFrame:
    """Nulls by a straight line between the neighbours in row order; leading ones stay, trailing ones take the last.

    ``rows`` cuts long series into ranges (see ``ranges``).
    """
    out = _neighbours(data, value, keys, order, rows)
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_i") - F.col("_i0")) / (F.col("_i1") - F.col("_i0"))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_v1").isNull(), F.col("_v0")).when(F.col("_v0").isNull(), None).otherwise(line)
    return out.withColumn(value, filled).drop("_i", "_i0", "_v0", "_i1", "_v1")


def _neighbours(data: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], rows: int | None) -> DataFrame:
    """With ``_i``, the row's place, and place and value of the last row that has one (``_i0``, ``_v0``) and of the next."""
    if rows is None:
        out = data.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        out = ranges.numbered(data, keys, order).withColumn("_i", F.col(ranges.INDEX))
    place = F.when(F.col(value).isNotNull(), F.col("_i"))
    for side, following in (("0", False), ("1", True)):
        out = ranges.known(out, {f"_i{side}": place, f"_v{side}": F.col(value)}, keys, order, rows, following)
    return out if rows is None else out.drop(ranges.INDEX, ranges.LENGTH)


def fill_median(data: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls of numbers by the column's median over the table."""
    out = data
    for c in columns:
        out = out.crossJoin(F.broadcast(quantiles(data, c, [0.5], f"_m_{c}")))  # one row
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")[0]) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def fill_mode(data: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls of texts by the column's most frequent value, the smallest on ties."""
    out = data
    for c in columns:
        out = out.crossJoin(F.broadcast(_most_frequent(data, c, f"_m_{c}")))  # one row
    return out.withColumns({c: F.coalesce(c, f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])


def _most_frequent(data: DataFrame, column: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """The most frequent value, the smallest on ties: counts by value first, so no buffer holds all values."""
    counts = data.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_c")).alias("less"), F.col("_v").alias("v"))).alias("m")).select(*keys, F.col("m.v").alias(name))


def preprocess(data: DataFrame, value: str = "price", market: str = "market", date: str = "date") -> DataFrame:
    """Dates parsed, prices interpolated per market, other numbers and texts filled (C4)."""
    out = interpolate(data.withColumn(date, F.to_date(date)), value, [market], [date])
    kinds = dict(out.dtypes)
    numbers = [c for c, t in kinds.items() if t in ("double", "float", "int", "bigint") and c != value]
    texts = [c for c, t in kinds.items() if t == "string" and c != market]
    out = fill_median(out, numbers) if numbers else out
    return fill_mode(out, texts) if texts else out


def outlier_flags(data: DataFrame, value: str, method: str = "zscore", threshold: float = 3.0, keys: Sequence[str] = (), ddof: int = 0, name: str = "is_outlier") -> DataFrame:
    """A flag for values far off by zscore, iqr or modified_zscore, per group if keys are given."""
    v = F.col(value)
    if method == "zscore":
        spread = F.stddev_pop(value) if ddof == 0 else F.stddev_samp(value)
        out = _stats(data, {"_m": F.avg(value), "_s": spread}, keys)
        flag = F.abs(v - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)) > threshold
    elif method == "iqr":
        out = _with_quantiles(data, "_m", value, (0.25, 0.75), keys).withColumn("_s", F.col("_m")[1] - F.col("_m")[0])
        flag = (v < F.col("_m")[0] - threshold * F.col("_s")) | (v > F.col("_m")[1] + threshold * F.col("_s"))
    elif method == "modified_zscore":
        out = _with_quantiles(data, "_m", value, [0.5], keys).withColumn("_d", F.abs(v - F.col("_m")[0]))
        out = _with_quantiles(out, "_s", "_d", [0.5], keys)
        flag = 0.6745 * F.col("_d") / F.nullif(F.col("_s")[0], F.lit(0.0)) > threshold
    else:
        raise ValueError(f"unknown method {method}")
    return out.withColumn(name, F.coalesce(flag, F.lit(False))).drop("_m", "_s", "_d")


def handle_outliers(data: DataFrame, value: str, how: str = "winsorize", method: str = "zscore", threshold: float = 3.0, keys: Sequence[str] = ()) -> DataFrame:
    """winsorize: to the bounds (iqr) or the 1 and 99 % quantiles; trim: to null; mean: to the mean of the others."""
    flagged = outlier_flags(data, value, method, threshold, keys, name="_o")
    if how == "trim":
        return flagged.withColumn(value, F.when(~F.col("_o"), F.col(value))).drop("_o")
    if how == "mean":
        out = _stats(flagged, {"_m": F.avg(F.when(~F.col("_o"), F.col(value)))}, keys)
        return out.withColumn(value, F.when(F.col("_o"), F.col("_m")).otherwise(F.col(value))).drop("_o", "_m")
    if how != "winsorize":
        raise ValueError(f"unknown treatment {how}")
    levels = (0.25, 0.75) if method == "iqr" else (0.01, 0.99)
    out = _with_quantiles(flagged, "_q", value, levels, keys)
    q0, q1 = F.col("_q")[0], F.col("_q")[1]
    if method == "iqr":
        q0, q1 = q0 - threshold * (q1 - q0), q1 + threshold * (q1 - q0)
    return out.withColumn(value, F.when(F.col("_o"), F.greatest(F.least(F.col(value), q1), q0)).otherwise(F.col(value))).drop("_o", "_q")


def replace_outliers(data: DataFrame, value: str, replace_with: str = "median", method: str = "zscore", threshold: float = 3.0, keys: Sequence[str] = ("market",), order: Sequence[str] = ("date",), rows: int | None = None) -> DataFrame:
    """Outliers become the median, mean, mode, nearest sound value (the earlier on ties) or the interpolation."""
    flagged = outlier_flags(data, value, method, threshold, keys, name="_o").withColumn("_v", F.when(~F.col("_o"), F.col(value)))
    if replace_with == "median":
        out = _with_quantiles(flagged, "_m", "_v", [0.5], keys)
        return out.withColumn(value, F.when(F.col("_o"), F.col("_m")[0]).otherwise(F.col(value))).drop("_o", "_v", "_m")
    if replace_with in ("mean", "mode"):
        out = _stats(flagged, {"_m": F.avg("_v")}, keys) if replace_with == "mean" else ranges.matched(flagged, _most_frequent(flagged, "_v", "_m", keys), list(keys), "left")
        return out.withColumn(value, F.when(F.col("_o"), F.col("_m")).otherwise(F.col(value))).drop("_o", "_v", "_m")
    if replace_with == "interpolate":
        # a null that was there stays one
        out = interpolate(flagged.withColumn("_n", F.col(value).isNull()), "_v", keys, order, rows)
        return out.withColumn(value, F.when(~F.col("_n"), F.col("_v"))).drop("_o", "_v", "_n")
    if replace_with != "nearest":
        raise ValueError(f"unknown replacement {replace_with}")
    out = _neighbours(flagged, "_v", keys, order, rows)
    nearer = F.when(F.col("_v1").isNull() | (F.col("_i") - F.col("_i0") <= F.col("_i1") - F.col("_i")), F.col("_v0")).otherwise(F.col("_v1"))
    return out.withColumn(value, F.when(F.col("_o"), nearer).otherwise(F.col(value))).drop("_o", "_v", "_i", "_i0", "_v0", "_i1", "_v1")


def quality_report(data: DataFrame, required: Sequence[str] = ("market", "date", "price", "commodity", "geometry"), market: str = "market", date: str = "date", price: str = "price") -> DataFrame:
    """(check, severity, n_bad) rows (C7): size, missing columns, nulls, repeated keys, negative prices, uneven spacing."""
    spark = data.sparkSession
    counts = {"empty_table": F.when(F.count("*") == 0, 1).otherwise(0)} | {f"null_{c}": F.count_if(F.col(c).isNull()) for c in data.columns}
    if price in data.columns:
        counts["negative_price"] = F.count_if(F.col(price) < 0)
    one = data.agg(*[c.cast("long").alias(n) for n, c in counts.items()])
    severity = F.when(F.col("check") == "empty_table", "error").otherwise("warning")
    out = one.unpivot([], list(counts), "check", "n_bad").select("check", severity.alias("severity"), "n_bad")
    missing = [(f"missing_{c}", "error" if c in (date, price) else "warning", 1) for c in required if c not in data.columns]
    if missing:
        out = out.unionAll(spark.createDataFrame(missing, "check string, severity string, n_bad long"))
    if {market, date} <= set(data.columns):
        repeated = data.groupBy(market, date).count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count") - 1)), F.lit(0)).alias("n_bad"))
        gaps = data.select(market, date).distinct().withColumn("gap", F.datediff(date, F.lag(date).over(Window.partitionBy(market).orderBy(date))))
        uneven = gaps.groupBy(market).agg(F.count_distinct("gap").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_bad"))
        for name, found in (("duplicate_dates", repeated), ("irregular_spacing", uneven)):
            out = out.unionAll(found.select(F.lit(name).alias("check"), F.lit("warning").alias("severity"), F.col("n_bad").cast("long")))
    return out


def minmax(data: DataFrame, column: str, name: str | None = None, keys: Sequence[str] = (), only_outside: bool = False) -> DataFrame:
    """(x - min) / (max - min), null where all are equal; ``only_outside`` leaves columns within [0, 1] as they are (C11)."""
    out = _stats(data, {"_lo": F.min(column), "_hi": F.max(column)}, keys)
    scaled = (F.col(column) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    if only_outside:
        scaled = F.when((F.col("_hi") > 1) | (F.col("_lo") < 0), scaled).otherwise(F.col(column))
    return out.withColumn(name or column, scaled).drop("_lo", "_hi")


def conflict_outliers(data: DataFrame, price: str = "price", conflict: str = "conflict_intensity", threshold: float = 3.0, keys: Sequence[str] = ("market",), order: Sequence[str] = ("date",), rows: int | None = None) -> DataFrame:
    """``is_outlier`` by a centred rolling median and MAD, with a limit that rises with conflict.

    The frame is clip(n // 4, 5..30) rows wide, as wide as its series asks: rows are split by width, at most 26 of them.
    ``rows`` cuts long series into ranges (see ``ranges``).
    """
    out = minmax(data, conflict, "_c", only_outside=True)
    out = ranges.matched(out, out.groupBy(*keys).agg(F.count("*").alias("_n")), list(keys)).withColumn("_w", F.greatest(F.least(F.lit(30), F.floor(F.col("_n") / 4)), F.lit(5)).cast("int"))
    if rows is not None:
        out = ranges.numbered(out, keys, order)
    parts = None
    lengths = sorted(r[0] for r in out.select("_w").distinct().collect())  # widths, from 5 to 30

    def middle(part: DataFrame, column: str, width: int, name: str) -> DataFrame:
        before, after = width - 1 - (width - 1) // 2, (width - 1) // 2
        own = ranges.cut(part, keys, order, rows, before, after)
        frame = own.window().rowsBetween(-before, after)
        found = own.own(own.data.withColumn("_q", F.when(F.count(column).over(frame) >= 3, F.percentile(column, 0.5).over(frame))), True)
        for side, following in (("_up", False), ("_down", True)):
            found = ranges.known(found, {side: F.col("_q")}, keys, order, rows, following)
        return found.withColumn(name, F.coalesce("_down", "_up")).drop("_q", "_up", "_down")

    for width in lengths:
        part = middle(out.where(F.col("_w") == width), price, width, "_m").withColumn("_d", F.abs(F.col(price) - F.col("_m")))
        part = middle(part, "_d", width, "_s")
        parts = part if parts is None else parts.unionAll(part)
    if parts is None:
        return data.withColumn("is_outlier", F.lit(False))
    flag = 0.6745 * F.col("_d") / (F.col("_s") + 1e-8) > threshold * (1 + F.col("_c"))
    flagged = parts.withColumn("is_outlier", F.coalesce(flag, F.lit(False))).drop("_c", "_n", "_w", "_m", "_d", "_s")
    return flagged if rows is None else flagged.drop(ranges.INDEX, ranges.LENGTH)


def lowess(data: DataFrame, value: str = "price", keys: Sequence[str] = ("market",), order: Sequence[str] = ("date",), fraction: float = 0.2, rounds: int = 3, name: str = "trend", rows: int | None = None) -> DataFrame:
    """Locally weighted lines on the row number (Cleveland 1979), robustly re-weighted.

    A point's neighbours are its ceil(fraction * n) nearest rows, known from its place in the series; sums over them come from
    running sums (see ``local_lines``).  ``rows`` cuts long series into ranges (see ``ranges``).
    """
    known = data.where(F.col(value).isNotNull())
    if rows is None:
        series = Window.partitionBy(*keys)
        placed = known.withColumns({"_j": F.row_number().over(series.orderBy(*order)) - 1, "_n": F.count("*").over(series)})
    else:
        placed = ranges.numbered(known, keys, order).withColumnsRenamed({ranges.INDEX: "_j", ranges.LENGTH: "_n"})
    k = F.least(F.greatest(F.ceil(F.col("_n") * fraction), F.lit(2)), F.col("_n")).cast("int")
    # on evenly numbered points the nearest k are the block around the point, pushed inwards at the ends
    placed = saved(placed.withColumn("_k", k).withColumn("_a", F.greatest(F.lit(0), F.least(F.col("_j") - F.floor((F.col("_k") - 1) / 2), F.col("_n") - F.col("_k"))).cast("long")))
    # lines are fitted to differences from the mean, which lose fewer digits
    means = placed.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    centred = placed.join(means, list(keys)).select(*keys, "_j", "_n", "_k", "_a", "_mean", (F.col(value) - F.col("_mean")).alias("_y"))
    values = centred.withColumn("_r", F.lit(1.0))
    for turn in range(rounds + 1):
        fitted = saved(local_lines(values, keys, rows))
        if turn < rounds:
            off = centred.join(fitted, [*keys, "_j"]).withColumn("_off", F.abs(F.col("_y") - F.col("_fit")))
            off = off.join(off.groupBy(*keys).agg((6 * F.percentile("_off", 0.5)).alias("_six")), list(keys))
            u = F.col("_off") / F.nullif(F.col("_six"), F.lit(0.0))
            weight = F.when(u < 1, F.pow(1 - u * u, 2)).when(u.isNull(), 1.0).otherwise(0.0)
            values = off.withColumn("_r", weight).drop("_fit", "_off", "_six")
    trend = fitted.join(means, list(keys)).select(*keys, "_j", (F.col("_fit") + F.col("_mean")).alias(name))
    return placed.join(trend, [*keys, "_j"]).drop("_j", "_n", "_k", "_a")


def trend_outliers(data: DataFrame, price: str = "price", threshold: float = 3.0, keys: Sequence[str] = ("market",), order: Sequence[str] = ("date",), rows: int | None = None) -> DataFrame:
    """``is_outlier`` by the MAD z-score of what a LOWESS trend leaves (C10); ``rows`` cuts long series into ranges."""
    out = lowess(data, price, keys, order, rows=rows).withColumn("_e", F.col(price) - F.col("trend"))
    return outlier_flags(out, "_e", "modified_zscore", threshold, keys).drop("_e")


def conflict_transform(data: DataFrame, value: str, method: str, conflict: str = "conflict_intensity", name: str | None = None) -> DataFrame:
    """robust_scaling, segmented_scaling, winsorized_scaling or log_transform of a conflict-affected number."""
    name, v, c = name or f"{value}_transformed", F.col(value), F.col(conflict)
    centre = "_q", value, (0.25, 0.5, 0.75)
    width = F.when(F.col("_q")[2] > F.col("_q")[0], F.col("_q")[2] - F.col("_q")[0]).otherwise(1.0)
    if method == "robust_scaling":
        return _with_quantiles(data, *centre, []).withColumn(name, (v - F.col("_q")[1]) / width).drop("_q")
    if method == "segmented_scaling":
        band = F.when(c <= 0.3, "low").when(c <= 0.7, "medium").otherwise("high")
        return _with_quantiles(data.withColumn("_band", band), *centre, ["_band"]).withColumn(name, (v - F.col("_q")[1]) / width).drop("_q", "_band")
    if method == "log_transform":
        offset = F.when(F.col("_lo") <= 0, F.abs(F.col("_lo")) + 1).otherwise(1.0)
        return _stats(data, {"_lo": F.min(value)}, []).withColumn(name, F.log(v + offset)).drop("_lo")
    if method != "winsorized_scaling":
        raise ValueError(f"unknown method {method}")
    # each row has its own quantile level: the values at the ranks around it are joined from a table of ranks
    count = data.where(v.isNotNull()).agg(F.count("*").alias("_n"))
    rows = data.crossJoin(F.broadcast(count)).withColumn("_level", 0.01 + 0.04 * c)
    sides = ("lo", "hi")
    for side, level in (("lo", F.col("_level")), ("hi", 1 - F.col("_level"))):
        rows = rows.withColumn(f"_p{side}", level * (F.col("_n") - 1)).withColumn(f"_f{side}", F.floor(f"_p{side}")).withColumn(f"_g{side}", F.ceil(f"_p{side}"))
    ranks = ranked(data.where(v.isNotNull()).select(v.alias("_x")), "_x")
    for key in ("_flo", "_glo", "_fhi", "_ghi"):
        rows = rows.join(ranks.select(F.col("_rank").alias(key), F.col("_x").alias(f"{key}_v")), key, "left")
    cut = {s: F.col(f"_f{s}_v") + (F.col(f"_g{s}_v") - F.col(f"_f{s}_v")) * (F.col(f"_p{s}") - F.col(f"_f{s}")) for s in sides}
    out = rows.withColumn("_w", F.greatest(F.least(v, cut["hi"]), cut["lo"]))
    out = _stats(out, {"_m": F.avg("_w"), "_s": F.stddev_samp("_w")}, [])
    scaled = (F.col("_w") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return out.withColumn(name, scaled).select(*data.columns, name)


def ranked(values: DataFrame, column: str) -> DataFrame:
    """(column, _rank from 0) in sorted order, by range partitions and their offsets: no task sees all rows."""
    placed = values.repartitionByRange(column).withColumn("_part", F.spark_partition_id())
    placed = saved(placed)
    sizes = placed.groupBy("_part").count()
    offsets = sizes.withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count")).drop("count")  # a row per partition
    number = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return placed.withColumn("_rank", number).join(F.broadcast(offsets), "_part").select(column, (F.col("_before") + F.col("_rank")).alias("_rank"))


def profile_columns(data: DataFrame) -> DataFrame:
    """(column, kind, n, n_distinct, lo, hi, suggested): the narrowest Spark type that holds each column (C13), by one scan."""
    parts = []
    for name, kind in data.dtypes:
        number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double")
        lo, hi = (F.min(f"`{name}`").cast("double"), F.max(f"`{name}`").cast("double")) if number else (F.lit(None).cast("double"),) * 2
        parts.append(F.struct(F.lit(name).alias("column"), F.lit(kind).alias("kind"), F.count(f"`{name}`").alias("n"), F.approx_count_distinct(f"`{name}`").alias("n_distinct"), lo.alias("lo"), hi.alias("hi")))
    rows = data.agg(F.array(*parts).alias("rows")).select(F.inline("rows"))
    fits = lambda bits: (F.col("lo") >= -(2.0 ** (bits - 1))) & (F.col("hi") <= 2.0 ** (bits - 1) - 1)
    whole = F.col("kind").isin("tinyint", "smallint", "int", "bigint")
    suggested = F.when(whole & fits(8), "tinyint").when(whole & fits(16), "smallint").when(whole & fits(32), "int").when(F.col("kind") == "double", "float")
    suggested = suggested.when((F.col("kind") == "string") & (F.col("n_distinct") < F.col("n") * 0.5), "dictionary-encoded string").otherwise(F.col("kind"))
    return rows.withColumn("suggested", suggested)
