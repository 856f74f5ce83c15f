"""Aggregations, descriptive statistics, correlations, histograms, bootstrap intervals (E)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.operators import clean, joins, ranges
from bazaarlens.plans.lineage import saved


def aggregate(data: DataFrame, group: Sequence[str], columns: dict[str, str | Sequence[str]], order: Sequence[str] = ()) -> DataFrame:
    """``column_function`` for each column and function named.

    ``first`` and ``last`` are the first and the last value that isn't null by ``order``, which they need: a table's rows have
    no order of their own.
    """
    todo = [(c, f) for c, fs in columns.items() for f in ([fs] if isinstance(fs, str) else fs)]
    names = {"mean": "avg", "std": "stddev_samp", "var": "var_samp", "nunique": "count_distinct"}
    if not order and any(f in ("first", "last") for _, f in todo):
        raise ValueError("first and last need an order")
    at = lambda c: F.when(c.isNotNull(), F.struct(*order))
    special = {"count_distinct": F.count_distinct, "first": lambda c: F.min_by(c, at(c)), "last": lambda c: F.max_by(c, at(c))}
    column = lambda c, f: special[names.get(f, f)](F.col(c)) if names.get(f, f) in special else getattr(F, names.get(f, f))(F.col(c))
    return data.groupBy(*group).agg(*[column(c, f).alias(f"{c}_{f}") for c, f in todo])


def describe(data: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """A row per column (E2): count, mean, std, min, quartiles, max, skew, kurtosis (bias-corrected), median, var, se, cv."""
    one, table = [], data
    for i, c in enumerate(columns):
        n, s, k = F.count(c), F.skewness(c), F.kurtosis(c)
        if keys:
            q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        else:
            table = table.crossJoin(F.broadcast(clean.quantiles(data, c, (0.25, 0.5, 0.75), f"_q{i}")))  # one row
            q = F.any_value(f"_q{i}")
        skew = F.when(n > 2, s * F.sqrt(n * (n - 1)) / (n - 2))
        kurt = F.when(n > 3, ((n + 1) * k + 6) * (n - 1) / ((n - 2) * (n - 3)))
        std = F.stddev_samp(c)
        parts = {"count": n, "mean": F.avg(c), "std": std, "min": F.min(c), "q25": q[0], "median": q[1], "q75": q[2], "max": F.max(c), "skew": skew, "kurtosis": kurt, "var": F.var_samp(c), "se": std / F.sqrt(n), "cv": std / F.nullif(F.avg(c), F.lit(0.0))}
        one.append(F.struct(F.lit(c).alias("column"), *[(v.cast("double") if p != "count" else v).alias(p) for p, v in parts.items()]))
    grouped = data.groupBy(*keys).agg(F.array(*one).alias("rows")) if keys else table.agg(F.array(*one).alias("rows"))
    return grouped.select(*keys, F.explode("rows").alias("r")).select(*keys, "r.*")


def _pairwise(data: DataFrame, columns: Sequence[str], value) -> DataFrame:
    pairs = list(combinations(columns, 2))
    one = data.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), value(a, b).alias("corr")) for a, b in pairs]).alias("rows"))
    half = one.select(F.explode("rows").alias("r")).select("r.*")
    same = data.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "a string, b string, corr double")
    return half.unionAll(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")).unionAll(same)


def average_ranks(data: DataFrame, column: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """``name``: the average rank of each value, by a table of distinct values and their counts."""
    if keys:
        counts = data.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_c"))
        ranks = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy(*keys).orderBy(column)) - F.col("_c"))
    else:
        ranks = clean.cumulated(data, column)
    ranks = ranks.withColumn(name, F.col("_before") + (F.col("_c") + 1) / 2.0).drop("_c", "_before")
    return data.join(ranks, [*keys, column], "left")


def correlation(data: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """(a, b, corr) for all pairs of columns: pearson (E3), spearman (E4), or kendall's tau-b (E5)."""
    if method == "pearson":
        # corr over rows that have both
        return _pairwise(data, columns, lambda a, b: F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))))
    if method not in ("spearman", "kendall"):
        raise ValueError(f"unknown method {method}")
    rows = saved(data.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]))
    holes = rows.agg(*[F.count_if(F.col(c).isNull()) for c in rows.columns]).first()
    if method == "spearman" and not any(holes):  # a column's ranks are the same beside every other one
        ranked = rows
        for i in range(len(columns)):
            ranked = average_ranks(ranked, f"c{i}", f"r{i}")
        return _pairwise(ranked.select(*[F.col(f"r{i}").alias(c) for i, c in enumerate(columns)]), columns, lambda a, b: F.corr(a, b))
    out = None
    for (i, a), (j, b) in combinations(enumerate(columns), 2):
        both = rows.select(F.col(f"c{i}").alias("a"), F.col(f"c{j}").alias("b")).dropna()
        value = kendall(both, "a", "b") if method == "kendall" else average_ranks(average_ranks(both, "a", "ra"), "b", "rb").agg(F.corr("ra", "rb").alias("corr"))
        row = value.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "corr")
        out = row if out is None else out.unionAll(row)
    same = data.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "a string, b string, corr double")
    return out.unionAll(out.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")).unionAll(same)


def inversions(ranks: np.ndarray, weight: np.ndarray) -> float:
    """The weight of the pairs i < j with ranks[i] > ranks[j]: by bits from the highest down, within equal higher bits."""
    total = 0.0
    for bit in range(int(ranks.max(initial=0)).bit_length() - 1, -1, -1):
        order = np.argsort(ranks >> (bit + 1), kind="stable")
        group, one, w = (ranks >> (bit + 1))[order], ((ranks >> bit) & 1)[order], weight[order]
        ones = np.cumsum(w * one)
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        base = np.repeat(np.concatenate([[0.0], ones])[start], np.diff(np.append(start, len(group))))
        total += float((w * (1 - one) * (ones - base)).sum())
    return total


#: Points that a range holds at least, and ranges in each direction at most.
RANGE_POINTS, MOST_RANGES = 4096, 1024


def kendall(both: DataFrame, a: str, b: str, range_points: int = RANGE_POINTS) -> DataFrame:
    """tau-b: concordant less discordant pairs, by counting inversions in ranges.

    Distinct points with counts are placed in the order of (a, b), and by the values of b; discordant pairs are inversions of b
    in that order.  Places are cut into rows and values into columns of a table of at most MOST_RANGES each way.  Pairs within
    a column are counted there; pairs of two columns within a row by the columns' numbers; and pairs of two rows and two
    columns from the table of counts alone.  A value that is a column of its own has no inversion and isn't looked at.
    """
    counted = both.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("c"))
    points = saved(ranges.numbered(counted, [], ["a", "b"]))
    total = points.count()
    size = max(range_points, -(-total // MOST_RANGES))
    values = clean.cumulated(points.select("b"), "b")  # points with a smaller b, and with this one
    # a value of very many points is a column of its own, after those that begin in the same range of points
    column = (2 * F.floor(F.col("_before") / size) + F.when(F.col("_c") > size, 1).otherwise(0)).cast("long")
    placed = saved(points.join(values.select("b", column.alias("column")), "b").select("a", "b", "c", F.col(ranges.INDEX).alias("place"), F.floor(F.col(ranges.INDEX) / size).alias("row"), "column"))

    def within(by: str):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("place")
            ranks = np.unique(frame["b" if by == "column" else "column"].to_numpy(), return_inverse=True)[1]
            return pd.DataFrame({"d": [inversions(ranks, frame["c"].to_numpy(float))]})

        return run

    own = placed.where("column % 2 = 0").select("place", "b", "c", "column").groupBy("column").applyInPandas(within("column"), "d double")
    crossed = placed.select("place", "column", "c", "row").groupBy("row").applyInPandas(within("row"), "d double")

    def apart(cells: pd.DataFrame) -> pd.DataFrame:
        rows, i = np.unique(cells["row"], return_inverse=True)
        columns, j = np.unique(cells["column"], return_inverse=True)
        table = np.zeros((len(rows), len(columns)))
        table[i, j] = cells["c"]
        before = np.cumsum(table, 0) - table
        above = before.sum(1, keepdims=True) - np.cumsum(before, 1)  # earlier rows, later columns
        return pd.DataFrame({"d": [float((table * above).sum())]})

    # at most MOST_RANGES by 2 MOST_RANGES cells
    cells = placed.groupBy("row", "column").agg(F.sum("c").alias("c")).withColumn("one", F.lit(0))
    discordant = own.unionAll(crossed).unionAll(cells.groupBy("one").applyInPandas(apart, "d double")).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("d"))
    ties = lambda by, name: points.groupBy(*by).agg(F.sum("c").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias(name))
    whole = points.agg(F.sum("c").alias("c")).select((F.col("c") * (F.col("c") - 1) / 2).alias("n0"))
    for one in (ties(["a"], "n1"), ties(["b"], "n2"), ties(["a", "b"], "n3"), discordant):
        whole = whole.crossJoin(F.broadcast(one))  # one row each
    s = F.col("n0") - F.col("n1") - F.col("n2") + F.col("n3") - 2 * F.col("d")
    return whole.select((s / F.sqrt(F.nullif((F.col("n0") - F.col("n1")) * (F.col("n0") - F.col("n2")), F.lit(0.0)))).alias("corr"))


def dispersion(data: DataFrame, value: str = "price", date: str = "date") -> DataFrame:
    """(date, mean, std, cv) across markets."""
    return data.groupBy(date).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), (F.stddev_samp(value) / F.nullif(F.avg(value), F.lit(0.0))).alias("cv"))


def mean_by(data: DataFrame, value: str, key: str = "date", name: str | None = None) -> DataFrame:
    """(key, mean of value)."""
    return data.groupBy(key).agg(F.avg(value).alias(name or f"mean_{value}"))


def market_correlation(pairs: DataFrame) -> DataFrame:
    """(market_y, market_x, corr, n) from aligned pairs."""
    return pairs.groupBy("market_y", "market_x").agg(F.corr("y", "x").alias("corr"), F.count("*").alias("n"))


def market_correlations(panel: DataFrame, value: str = "price", market: str = "market", date: str = "date", **tiles) -> DataFrame:
    """The same from a panel, by products of tiles: no row for a pair and date."""
    sums = joins.pair_sums(panel, value, market, date, **tiles)
    corr = F.col("s_lr") / F.sqrt(F.nullif(F.col("s_ll") * F.col("s_rr"), F.lit(0.0)))
    return sums.select(F.col("left").alias("market_y"), F.col("right").alias("market_x"), F.when(F.col("n") > 1, corr).alias("corr"), "n")


def market_wide(data: DataFrame, value: str = "price", market: str = "market", date: str = "date", markets: Sequence[str] | None = None) -> DataFrame:
    """date x market, mean price."""
    return data.groupBy(date).pivot(market, list(markets) if markets else None).agg(F.avg(value))


def group_levels(data: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, std and count of a value above and up to the median of another."""
    median = clean.quantiles(data, by, [0.5], "_m")  # one row
    level = F.when(F.col(by) > F.col("_m")[0], "high").otherwise("low")
    return data.crossJoin(F.broadcast(median)).groupBy(level.alias("level")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def cluster_flags(data: DataFrame, value: str) -> DataFrame:
    """``cluster``: high or low beyond mean +- one standard deviation, else medium."""
    stats = data.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))  # one row
    flag = F.when(F.col(value) > F.col("_m") + F.col("_s"), "high").when(F.col(value) < F.col("_m") - F.col("_s"), "low").otherwise("medium")
    return data.crossJoin(F.broadcast(stats)).withColumn("cluster", flag).drop("_m", "_s")


def histogram(data: DataFrame, value: str, bins: int = 20, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, bin from 1, lo, hi, n): equal widths between the extremes, the last bin closed."""
    rows = data.where(F.col(value).isNotNull())
    ends = rows.groupBy(*keys).agg(F.min(value).cast("double").alias("_a"), F.max(value).cast("double").alias("_b"))
    joined = rows.join(ends, list(keys)) if keys else rows.crossJoin(F.broadcast(ends))
    width = (F.col("_b") - F.col("_a")) / bins
    number = F.when(F.col("_b") == F.col("_a"), 1).otherwise(F.least(F.floor((F.col(value) - F.col("_a")) / width) + 1, F.lit(bins)))
    counted = joined.groupBy(*keys, number.cast("int").alias("bin"), "_a", "_b").agg(F.count("*").alias("n"))
    return counted.select(*keys, "bin", (F.col("_a") + (F.col("bin") - 1) * width).alias("lo"), (F.col("_a") + F.col("bin") * width).alias("hi"), "n")


#: Statistics of a resample that combine from those of its parts, or are read off ranks.
STATISTICS = {"mean": F.avg, "median": lambda c: F.percentile(c, 0.5), "std": F.stddev_samp, "var": F.var_samp, "sum": F.sum, "min": F.min, "max": F.max}
#: Rows of a part of a group.
PART_ROWS = 1 << 16


def part_counts(n: int, parts: int, part: int, rows: int, replicates: int, seed: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each replicate, how many of n draws with replacement fall into a part, and how many into the parts before it.

    Parts hold ``rows`` rows each, the last one what is left.  Draws are split between the halves of the parts by binomials,
    seeded by the half, so that every part finds its own number in as many steps as the parts can be halved.
    """
    low, high = 0, parts
    inside, before = np.full(replicates, n, np.int64), np.zeros(replicates, np.int64)
    size = lambda a, b: min(b * rows, n) - a * rows
    while high - low > 1:
        middle = (low + high) // 2
        left = np.random.default_rng([*seed, low, high]).binomial(inside, size(low, middle) / size(low, high))
        if part < middle:
            inside, high = left, middle
        else:
            before, inside, low = before + left, inside - left, middle
    return inside, before


def resampled(data: DataFrame, value: str, n: int, keys: Sequence[str], order: Sequence[str], seed: int = 0, part_rows: int = PART_ROWS) -> DataFrame:
    """(keys, rep, n, s1, s2, lo, hi, mid): n resamples with replacement of each group, by parts of the group.

    A part holds neighbouring values, so that ranks of a resample follow from the parts' numbers of draws: a middle rank that
    falls into a part is read there (``mid`` is its share of the median).  The other columns are the resample's number of
    draws, sums of (value - first value) and their squares, and extremes within the part.  No row is sent more than once.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.select(*keys).schema)
    placed = ranges.numbered(data.select(*keys, *[o for o in order if o not in (*keys, value)], F.col(value).cast("double").alias("_v")), keys, ["_v", *[o for o in order if o not in (*keys, value)]], ["_v"])
    name = F.xxhash64(*keys) if keys else F.lit(0).cast("long")
    rows = placed.select(*keys, name.alias("_h"), F.floor(F.col(ranges.INDEX) / part_rows).alias("_part"), F.col(ranges.INDEX).alias("_at"), F.col(ranges.LENGTH).alias("_n"), "_v", F.col("_first__v").alias("_base"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_at")
        values, total, part = frame["_v"].to_numpy(float), int(frame["_n"].iloc[0]), int(frame["_part"].iloc[0])
        off = values - float(frame["_base"].iloc[0])
        own = [seed, int(frame["_h"].iloc[0]) % (1 << 63)]
        inside, before = part_counts(total, -(-total // part_rows), part, part_rows, n, own)
        rng = np.random.default_rng([*own, part])
        ranks = ((total - 1) // 2, total // 2)  # of the median
        found = np.full((n, 5), np.nan)
        found[:, :2], found[:, 4] = 0, 0
        for r in range(n):
            if not inside[r]:
                continue
            drawn = rng.integers(0, len(values), inside[r])
            x = off[drawn]
            found[r, :4] = x.sum(), (x * x).sum(), values[drawn.min()], values[drawn.max()]
            for k in ranks:
                at = k - before[r]
                if 0 <= at < inside[r]:
                    found[r, 4] += values[np.partition(drawn, at)[at]] / 2
        out = {k: [frame[k].iloc[0]] * n for k in keys} | {"rep": np.arange(n, dtype=np.int32), "n": inside} | dict(zip(("s1", "s2", "lo", "hi", "mid"), found.T, strict=True)) | {"base": float(frame["_base"].iloc[0])}
        return pd.DataFrame(out)

    return rows.groupBy(*keys, "_part").applyInPandas(run, f"{schema + ', ' if keys else ''}rep int, n long, s1 double, s2 double, lo double, hi double, mid double, base double")


def bootstrap(data: DataFrame, value: str, statistic: str | Callable[[pd.Series], float] = "mean", n: int = 1000, level: float = 0.95, keys: Sequence[str] = (), order: Sequence[str] = ("date",), seed: int = 0, part_rows: int = PART_ROWS) -> DataFrame:
    """(keys, statistic, lower, upper, se) by resampling.

    A callable gets the resampled values of a replicate, and a group of which one is asked has to fit in a task.
    """
    rows = data.where(F.col(value).isNotNull()).select(*keys, *[o for o in order if o not in keys], value)
    if callable(statistic):
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
        name = F.xxhash64(*keys) if keys else F.lit(0).cast("long")

        def own(frame: pd.DataFrame) -> pd.DataFrame:
            values = frame.sort_values(list(order))[value]
            rng = np.random.default_rng([seed, int(frame["_h"].iloc[0]) % (1 << 63)])
            drawn = [float(statistic(values.iloc[rng.integers(0, len(values), len(values))])) for _ in range(n)]
            return pd.DataFrame({k: [frame[k].iloc[0]] * (n + 1) for k in keys} | {"rep": [-1, *range(n)], "s": [float(statistic(values)), *drawn]})

        found = saved(rows.withColumn("_h", name).groupBy(*(keys or ["_h"])).applyInPandas(own, f"{schema + ', ' if keys else ''}rep int, s double"))
        reps, seen = found.where("rep >= 0"), found.where("rep < 0").select(*keys, F.col("s").alias("statistic"))
    else:
        whole = resampled(rows, value, n, keys, order, seed, part_rows).groupBy(*keys, "rep").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2", "mid")], F.min(F.when(~F.isnan("lo"), F.col("lo"))).alias("lo"), F.max(F.when(~F.isnan("hi"), F.col("hi"))).alias("hi"), F.max("base").alias("base"))
        variance = F.when(F.col("n") > 1, F.greatest(F.col("s2") - F.col("s1") ** 2 / F.col("n"), F.lit(0.0)) / (F.col("n") - 1))
        made = {"mean": F.col("base") + F.col("s1") / F.col("n"), "sum": F.col("base") * F.col("n") + F.col("s1"), "var": variance, "std": F.sqrt(variance), "median": F.col("mid"), "min": F.col("lo"), "max": F.col("hi")}
        reps, seen = saved(whole.select(*keys, "rep", "n", made[statistic].alias("s"))), rows.groupBy(*keys).agg(STATISTICS[statistic](F.col(value)).alias("statistic"))
    tail = (1 - level) / 2
    q = F.percentile("s", F.array(F.lit(tail), F.lit(1 - tail)))
    bounds = reps.groupBy(*keys).agg(q[0].alias("lower"), q[1].alias("upper"), F.stddev_samp("s").alias("se"))
    return ranges.matched(seen, bounds, list(keys))
