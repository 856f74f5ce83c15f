"""Pairs, alignments, distance and interval joins, and unions of market tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.plans.lineage import saved


#: Blocks into which a period's units are dealt.
BLOCKS = 8


def align(left: DataFrame, right: DataFrame, on: Sequence[str] = ("date",), y: str = "price", x: str = "price") -> DataFrame:
    """(on..., y, x): complete cases of two series on equal keys."""
    a = left.select(*on, F.col(y).alias("y")).dropna()
    return a.join(right.select(*on, F.col(x).alias("x")).dropna(), list(on))


def market_pairs(panel: DataFrame, value: str = "price", market: str = "market", ts: str = "date", on: Sequence[str] = (), pair_filter: DataFrame | None = None, modes: Sequence[str] = (), blocks: int = BLOCKS) -> DataFrame:
    """All pairs of markets i < j at equal dates (D1): pair_id, market_y, market_x, ts, y, x, and mode if any are named.

    Pairs grow with the square of the markets; ``pair_filter`` (src, dst) restricts them to an edge table.  A date's markets
    are dealt into blocks, and pairs of blocks are the keys of the join beside the date.  Where sums over the dates are all
    that is asked for, ``pair_sums`` makes no row for a pair and date.
    """
    side = lambda m, v: panel.select(F.col(ts).alias("ts"), *on, F.col(market).alias(m), F.col(value).cast("double").alias(v)).dropna()
    a, b = side("market_y", "y"), side("market_x", "x")
    if pair_filter is not None:
        edges = pair_filter.select(F.least("src", "dst").alias("market_y"), F.greatest("src", "dst").alias("market_x")).where("market_y != market_x").distinct()
        joined = a.join(edges, "market_y").join(b, ["ts", *on, "market_x"])
    else:
        joined = unit_pairs(a, b, ["ts", *on], "market_y", "market_x", blocks)
    out = joined.select(F.concat_ws("|", "market_y", "market_x").alias("pair_id"), "market_y", "market_x", *on, "ts", "y", "x")
    return out.withColumn("mode", F.explode(F.array(*map(F.lit, modes)))) if modes else out


def unit_pairs(a: DataFrame, b: DataFrame, on: Sequence[str], left: str, right: str, blocks: int = BLOCKS) -> DataFrame:
    """Rows of ``a`` and ``b`` alike in ``on`` whose units are in order: left < right.

    The join is on pairs of blocks as well, so that a period's pairs are blocks^2 keys; nothing runs before it is asked for.
    """
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = a.withColumn("_a", own(left)).withColumn("_b", every)
    b = b.withColumn("_b", own(right)).withColumn("_a", every)
    return a.join(b, [*on, "_a", "_b"]).where(F.col(left) < F.col(right)).drop("_a", "_b")


#: Units of a tile, and ranges of periods; a pair has one row for each range, not for each period.
TILE_UNITS, TILE_RANGES = 256, 8


def pair_sums(data: DataFrame, value: str, unit: str, time: str, blocks: int = BLOCKS, spans: int = TILE_RANGES) -> DataFrame:
    """(left, right, n, m_left, m_right, s_ll, s_rr, s_lr): means and centred sums of squares and products of all pairs of units.

    Over the periods that both units have, for left < right.  A tile holds the units of one block at the periods of one span
    (both picked by hash) as a dense table with holes; the sums of two tiles are products of matrices, so rows of pairs are
    made once a span and never for a period.  A unit has one value at a period: repeated ones are averaged.  Tiles grow with
    the units and periods behind a block and a span: give more of either to larger tables.
    """
    rows = data.select(F.col(unit).cast("string").alias("unit"), F.col(time).cast("string").alias("time"), F.col(value).cast("double").alias("v")).where("unit is not null and time is not null and v is not null and not isnan(v)")
    rows = rows.groupBy("unit", "time").agg(F.avg("v").alias("v"))
    # values less a rough centre of their unit, so that products keep their digits
    rows = rows.join(rows.groupBy("unit").agg(F.avg("v").alias("centre")), "unit").withColumn("v", F.col("v") - F.col("centre"))
    part = lambda c, n, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(n)).cast("int")
    rows = rows.withColumns({"block": part("unit", blocks, 1), "span": part("time", spans, 2)})
    schema = "block int, span int, units array<string>, times array<string>, centres array<double>, v binary"
    tiles = saved(rows.groupBy("block", "span").applyInPandas(_tile, schema))
    right = tiles.select(*[F.col(c).alias(f"{c}_" if c != "span" else c) for c in tiles.columns])
    pairs = tiles.join(right, "span").where("block <= block_").repartition("span", "block", "block_")
    sums = pairs.mapInPandas(_tile_products, "left string, right string, c_left double, c_right double, n double, l double, r double, ll double, rr double, lr double")
    total = sums.groupBy("left", "right").agg(*[F.max(c).alias(c) for c in ("c_left", "c_right")], *[F.sum(c).alias(c) for c in ("n", "l", "r", "ll", "rr", "lr")])
    about = lambda both, a, b: F.col(both) - F.col(a) * F.col(b) / F.col("n")
    return total.select("left", "right", F.col("n").cast("long").alias("n"), (F.col("c_left") + F.col("l") / F.col("n")).alias("m_left"), (F.col("c_right") + F.col("r") / F.col("n")).alias("m_right"), about("ll", "l", "l").alias("s_ll"), about("rr", "r", "r").alias("s_rr"), about("lr", "l", "r").alias("s_lr"))


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    units, at = np.unique(rows["unit"].to_numpy(str), return_inverse=True)
    times, when = np.unique(rows["time"].to_numpy(str), return_inverse=True)
    v = np.full((len(times), len(units)), np.nan)
    v[when, at] = rows["v"].to_numpy(float)
    centres = np.zeros(len(units))
    centres[at] = rows["centre"].to_numpy(float)
    return pd.DataFrame({"block": rows["block"].iloc[:1].to_numpy(), "span": rows["span"].iloc[:1].to_numpy(), "units": [units.tolist()], "times": [times.tolist()], "centres": [centres.tolist()], "v": [v.tobytes()]})


def _tile_products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sums of every pair of units of two tiles with a period in common, by parts of TILE_UNITS units."""
    for frame in frames:
        for r in frame.to_dict("records"):
            a = np.frombuffer(r["v"], float).reshape(len(r["times"]), -1)
            b = np.frombuffer(r["v_"], float).reshape(len(r["times_"]), -1)
            _, i, j = np.intersect1d(np.asarray(r["times"]), np.asarray(r["times_"]), return_indices=True)
            a, b = a[i], b[j]
            names, others = np.asarray(r["units"], object), np.asarray(r["units_"], object)
            for p in range(0, len(names), TILE_UNITS):
                for q in range(0, len(others), TILE_UNITS):
                    x, y = a[:, p : p + TILE_UNITS], b[:, q : q + TILE_UNITS]
                    mx, my = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
                    x, y = np.nan_to_num(x), np.nan_to_num(y)
                    sums = {"n": mx.T @ my, "l": x.T @ my, "r": mx.T @ y, "ll": (x * x).T @ my, "rr": mx.T @ (y * y), "lr": x.T @ y}
                    left, right = names[p : p + TILE_UNITS], others[q : q + TILE_UNITS]
                    u, w = np.nonzero(sums["n"])
                    swap = left[u] > right[w]
                    keep = left[u] != right[w]
                    if r["block"] == r["block_"]:  # a tile with itself has each pair twice
                        keep &= ~swap
                    out = {c: s[u, w] for c, s in sums.items()}
                    c_left, c_right = np.asarray(r["centres"])[p + u], np.asarray(r["centres_"])[q + w]
                    turn = lambda one, two: np.where(swap, two, one)  # noqa: B023, E731
                    found = {"left": turn(left[u], right[w]), "right": turn(right[w], left[u]), "c_left": turn(c_left, c_right), "c_right": turn(c_right, c_left), "n": out["n"], "l": turn(out["l"], out["r"]), "r": turn(out["r"], out["l"]), "ll": turn(out["ll"], out["rr"]), "rr": turn(out["rr"], out["ll"]), "lr": out["lr"]}
                    yield pd.DataFrame(found)[keep]


def prepare_price_pair(panel: DataFrame, first: str, second: str, clean: bool = True, value: str = "price", market: str = "market", ts: str = "date") -> DataFrame:
    """(ts, y, x) of two markets: outliers replaced, each series made stationary, aligned on dates (D3).

    The transformation of each series is the first that its unit root tests call stationary, see ``unitroot.make_stationary``.
    """
    from bazaarlens.operators import clean as cleaning, unitroot  # they build on this module's siblings

    rows = panel.where(F.col(market).isin(first, second)).select(market, ts, F.col(value).cast("double").alias(value))
    if clean:
        rows = cleaning.replace_outliers(rows, value, "median", keys=[market], order=[ts])
        rows = unitroot.make_stationary(rows, [market], [ts], value).select(market, ts, F.col("x").alias(value))
    side = lambda m: rows.where(F.col(market) == m)
    return align(side(first), side(second), [ts], value, value)


def price_ratios(panel: DataFrame, value: str = "price", market: str = "market", ts: str = "date", group_by: Sequence[str] = ()) -> DataFrame:
    """(pair_id, ts[, group], ratio): price of the first market over that of the second."""
    return market_pairs(panel, value, market, ts, group_by).select("pair_id", "ts", *group_by, F.try_divide("y", "x").alias("ratio"))


def within_distance(points: DataFrame, events: DataFrame, threshold: float, key: str = "market") -> DataFrame:
    """Pairs (point, event) at most ``threshold`` apart, by grid cells of that size and their neighbours.

    Both tables have x and y.  Each point looks into the 3 x 3 cells around it, so the join is on equal cells.
    """
    cell = lambda c: F.floor(F.col(c) / threshold)
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    p = points.select(F.col(key), F.col("x").alias("px"), F.col("y").alias("py"))
    p = p.withColumn("cx", F.explode(F.transform(around, lambda i: cell("px") + i))).withColumn("cy", F.explode(F.transform(around, lambda i: cell("py") + i)))
    e = events.withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    joined = p.join(e, ["cx", "cy"]).withColumn("distance", F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y")))
    return joined.where(F.col("distance") <= threshold).drop("cx", "cy", "px", "py")


def merge_conflict(markets: DataFrame, events: DataFrame, threshold: float = 10_000.0, conflict_weight: float = 0.5, key: str = "market", intensity: str = "intensity") -> DataFrame:
    """Each market with the weighted intensity of the events around it and that value over the largest.

    Weights are 1 / (1 + distance * conflict_weight), made to sum to one per market; a market without events has 0.
    """
    near = within_distance(markets, events, threshold, key)
    weight = 1 / (1 + F.col("distance") * conflict_weight)
    found = near.groupBy(key).agg((F.sum(weight * F.col(intensity)) / F.sum(weight)).alias("conflict_intensity"))
    out = markets.join(found, key, "left").withColumn("conflict_intensity", F.coalesce("conflict_intensity", F.lit(0.0)))
    most = out.agg(F.max("conflict_intensity").alias("_most"))  # one row
    return out.crossJoin(F.broadcast(most)).withColumn("conflict_intensity_normalized", F.coalesce(F.col("conflict_intensity") / F.when(F.col("_most") > 0, F.col("_most")), F.lit(0.0))).drop("_most")


#: Break dates of a series without keys at most: its intervals are broadcast.
MOST_BREAKS = 10_000


def regimes(series: DataFrame, breaks: DataFrame, ts: str = "date", keys: Sequence[str] = ()) -> DataFrame:
    """Rows with the regime they fall in (D5): intervals between consecutive break dates, both ends included.

    ``breaks`` (keys..., break_date) is small: a few dates per key.  A row on a border is in both regimes.
    """
    bounds = series.groupBy(*keys).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    dates = breaks.select(*keys, F.col("break_date").alias("d")).distinct()
    inner = dates.join(bounds, list(keys)).where("d > lo and d < hi").select(*keys, "d") if keys else dates.crossJoin(F.broadcast(bounds)).where("d > lo and d < hi").select("d")  # one row
    if not keys and dates.count() > MOST_BREAKS:
        raise ValueError(f"more than {MOST_BREAKS} break dates without keys")
    points = inner.unionByName(bounds.select(*keys, F.col("lo").alias("d"))).unionByName(bounds.select(*keys, F.col("hi").alias("d"))).distinct()
    order = Window.partitionBy(*keys).orderBy("d") if keys else Window.partitionBy(F.lit(0)).orderBy("d")  # dates of breaks only
    spans = points.withColumn("end", F.lead("d").over(order)).withColumn("regime", F.row_number().over(order)).where("end is not null").withColumnRenamed("d", "start")
    inside = F.col(ts).between(F.col("start"), F.col("end"))
    return (series.join(spans, list(keys)).where(inside) if keys else series.join(F.broadcast(spans), inside)).drop("start", "end")


def attach_first(series: DataFrame, spatial: DataFrame, key: str = "market", order: Sequence[str] = ()) -> DataFrame:
    """Each row with the columns of the first spatial row of its market that it lacks; rows without one go."""
    extra = [c for c in spatial.columns if c not in series.columns]
    first = spatial.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*(order or spatial.columns)))).where("_n = 1")
    return series.join(first.select(key, *extra), key)


def combine_markets(tables: dict[str, DataFrame] | Sequence[DataFrame], market: str = "market") -> DataFrame:
    """One keyed table of all markets."""
    frames = [t.withColumn(market, F.lit(name)) for name, t in tables.items()] if isinstance(tables, dict) else list(tables)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def combine_commodities(tables: dict[str, DataFrame], common: Sequence[str] | None = None) -> DataFrame:
    """The union of commodity tables on the columns that all of them have, tagged with the commodity."""
    columns = sorted(set.intersection(*[set(t.columns) for t in tables.values()]) - {"commodity"}) if common is None else list(common)
    return reduce(DataFrame.unionByName, [t.select(*columns, F.lit(name).alias("commodity")) for name, t in tables.items()])


def neighbour_prices(edges: DataFrame, prices: DataFrame, conflict: DataFrame, unit: str = "region", ts: Sequence[str] = ()) -> DataFrame:
    """(src, dst, ts..., p_src, p_dst, c_src, c_dst): neighbours that have both a price and a conflict value."""
    both = prices.join(conflict, [unit, *ts])
    side = lambda s: both.select(F.col(unit).alias(s), *ts, F.col("price").alias(f"p_{s}"), F.col("conflict").alias(f"c_{s}"))
    return edges.select("src", "dst").join(side("src"), "src").join(side("dst"), ["dst", *ts])


def with_rates(data: DataFrame, rates: DataFrame, on: str = "date") -> DataFrame:
    """Data LEFT JOIN rates by date (D10); Catalyst broadcasts the rate table while it is small."""
    return data.join(rates, on, "left")


def with_attributes(results: DataFrame, attributes: DataFrame, on: str = "unit") -> DataFrame:
    """Model results with the attributes of their unit."""
    return results.join(attributes, on)
