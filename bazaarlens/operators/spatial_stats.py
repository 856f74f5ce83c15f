"""Spatial statistics on edge tables (I12-I18); ``by`` (e.g. the date) gives one result per period."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions import dist, draws
from bazaarlens.operators import clean, describe, weights
from bazaarlens.operators.ols import grouped_ols
from bazaarlens.plans.lineage import saved


def _centred(data: DataFrame, value: str, key: str, by: Sequence[str]) -> DataFrame:
    """(by, id, v, z): complete values and their distance from the period's mean."""
    rows = data.select(*by, F.col(key).alias("id"), F.col(value).cast("double").alias("v")).dropna()
    if by:
        return rows.withColumn("z", F.col("v") - F.avg("v").over(Window.partitionBy(*by)))
    mean = rows.agg(F.avg("v").alias("m"))  # one row
    return rows.crossJoin(F.broadcast(mean)).withColumn("z", F.col("v") - F.col("m")).drop("m")


def _both(edges: DataFrame, rows: DataFrame, by: Sequence[str], columns: Sequence[str] = ("z", "v")) -> DataFrame:
    """Edges with both ends' values: those of units that are there in the period."""
    side = lambda s, n: rows.select(*by, F.col("id").alias(s), *[F.col(c).alias(f"{c}{n}") for c in columns])
    return edges.join(side("src", 1), "src").join(side("dst", 2), [*by, "dst"])


def _join(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    return a.join(b, list(by)) if by else a.crossJoin(F.broadcast(b))  # one row each without periods


def moran(edges: DataFrame, data: DataFrame, value: str, key: str = "market", by: Sequence[str] = (), permutations: int = 0, seed: int = 0) -> DataFrame:
    """(by, n, moran, expected[, p_sim, z_sim]) (I12).  Permutations order units by a hash of seed, turn and id."""
    rows = saved(_centred(data, value, key, by))
    size = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.pow("z", F.lit(2))).alias("zz"))
    cross = _both(edges, rows, by).groupBy(*by).agg(F.sum(F.col("w") * F.col("z1") * F.col("z2")).alias("c"), F.sum("w").alias("s0"))
    i = F.col("n") / F.col("s0") * F.col("c") / F.nullif(F.col("zz"), F.lit(0.0))
    out = _join(size, cross, by).select(*by, "n", i.alias("moran"), (-1.0 / (F.col("n") - 1)).alias("expected"))
    if not permutations:
        return out
    sims = _permuted(edges, rows, by, permutations, seed)
    sims = _join(sims, out, by)
    tail = sims.groupBy(*by).agg(F.count_if(F.col("sim") >= F.col("moran")).alias("up"), F.count("*").alias("r"), F.avg("sim").alias("m"), F.stddev_pop("sim").alias("s"), F.first("moran").alias("i"))
    least = F.least("up", F.col("r") - F.col("up"))
    return _join(out, tail.select(*by, ((least + 1) / (F.col("r") + 1)).alias("p_sim"), ((F.col("i") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))).alias("z_sim")), by)


#: Permutations that one task draws at once.
PERMUTATIONS = 128


def _permuted(edges: DataFrame, rows: DataFrame, by: Sequence[str], n: int, seed: int) -> DataFrame:
    """(by, sim): Moran's I of n permutations of the values among the units.

    A period's values and its edges, by place in the order of ids, are two arrays, which are sent once per PERMUTATIONS: rows
    are not multiplied by the permutations.  The arrays of a period have to fit in a task.
    """
    units = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("id", "z"))).alias("u"))
    here = _both(edges, rows, by, ["z"]).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("src", "dst", "w"))).alias("e"))
    key = F.xxhash64(*by) if by else F.lit(0).cast("long")
    both = _join(units, here, by).select(*by, key.alias("h"), F.col("u.id").alias("ids"), F.col("u.z").alias("z"), F.col("e.src").alias("src"), F.col("e.dst").alias("dst"), F.col("e.w").alias("w"))
    blocks = both.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(PERMUTATIONS)))).repartition(*by, "first")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.to_dict("records"):
                place = {x: i for i, x in enumerate(r["ids"])}
                src, dst = (np.fromiter((place[x] for x in r[c]), np.int64, len(r[c])) for c in ("src", "dst"))
                z, w = np.asarray(r["z"], float), np.asarray(r["w"], float)
                drawn = z[draws.permutations(seed, r["h"], np.arange(r["first"], min(r["first"] + PERMUTATIONS, n)), len(z))]
                scale = w.sum() * (z @ z)
                sims = len(z) * (drawn[:, src] * drawn[:, dst] * w).sum(1) / scale if scale else np.full(len(drawn), np.nan)
                yield pd.DataFrame({**{k: [r[k]] * len(sims) for k in by}, "sim": sims})

    head = "".join(f"`{c}` {t}, " for c, t in rows.select(*by).dtypes)
    return blocks.mapInPandas(run, f"{head}sim double").withColumn("sim", F.nanvl("sim", F.lit(None).cast("double")))


def geary(edges: DataFrame, data: DataFrame, value: str, key: str = "market", by: Sequence[str] = ()) -> DataFrame:
    """(by, n, geary)."""
    rows = _centred(data, value, key, by)
    size = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.pow("z", F.lit(2))).alias("zz"))
    cross = _both(edges, rows, by).groupBy(*by).agg(F.sum(F.col("w") * F.pow(F.col("v1") - F.col("v2"), 2)).alias("c"), F.sum("w").alias("s0"))
    return _join(size, cross, by).select(*by, "n", ((F.col("n") - 1) * F.col("c") / (2 * F.col("s0") * F.nullif(F.col("zz"), F.lit(0.0)))).alias("geary"))


def local_moran(edges: DataFrame, data: DataFrame, value: str, key: str = "market", by: Sequence[str] = (), permutations: int = 0, seed: int = 0) -> DataFrame:
    """(by, id, local_moran, quadrant[, p_sim]) (I14): conditional permutations draw a unit's neighbours among the others."""
    rows = saved(_centred(data, value, key, by))
    size = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.pow("z", F.lit(2))).alias("zz"))
    lag = _both(edges, rows, by).groupBy(*by, F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("z2")).alias("l"))
    out = _join(rows.join(lag, [*by, "id"]), size, by)
    scale = (F.col("n") - 1) / F.nullif(F.col("zz"), F.lit(0.0))
    up, around = F.col("z") > 0, F.col("l") > 0
    quadrant = F.when(up & around, "HH").when(~up & around, "LH").when(~up & ~around, "LL").otherwise("HL")
    out = out.select(*by, "id", "z", (F.col("z") * F.col("l") * scale).alias("local_moran"), quadrant.alias("quadrant"), "n", "zz")
    if not permutations:
        return out.drop("z", "n", "zz")
    if by:
        ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("id")) - 1).select("id", *by, "place", "z")
    else:
        ranked = rows.select("id", "z").join(clean.ranked(rows.select("id"), "id").withColumnRenamed("_rank", "place"), "id")
    present = _both(edges, rows, by).select(*by, "src", "dst", "w")
    numbered = present.withColumn("k", F.row_number().over(Window.partitionBy(*by, "src").orderBy("dst")))
    wide = numbered.join(ranked.select(*by, F.col("id").alias("src"), F.col("place").alias("own")), [*by, "src"])
    wide = _join(wide, size.select(*by, "n"), by).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    # without replacement: a start and a stride by hash, over the n - 1 others
    h = F.xxhash64(F.lit(seed), "rep", *by, "src")
    drawn = F.pmod(h + F.col("k"), F.col("n") - 1)
    wide = wide.withColumn("rank", drawn + 1)
    order = ranked.select(*by, F.col("id").alias("other"), "z").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    order = order.withColumn("place", F.row_number().over(Window.partitionBy(*by, "rep").orderBy(F.xxhash64(F.lit(seed + 1), "rep", *by, "other"), "other")) - 1)
    mine = order.select(*by, "rep", F.col("other").alias("src"), F.col("place").alias("skip"))
    wide = wide.join(mine, [*by, "rep", "src"]).withColumn("place", F.when(F.col("rank") - 1 >= F.col("skip"), F.col("rank")).otherwise(F.col("rank") - 1))
    sims = wide.join(order.select(*by, "rep", "place", "z"), [*by, "rep", "place"]).groupBy(*by, F.col("src").alias("id"), "rep").agg(F.sum(F.col("w") * F.col("z")).alias("l"))
    sims = sims.join(out.select(*by, "id", "z", "local_moran", "n", "zz"), [*by, "id"]).withColumn("sim", F.col("z") * F.col("l") * scale)
    tail = sims.groupBy(*by, "id").agg(F.count_if(F.col("sim") >= F.col("local_moran")).alias("up"), F.count("*").alias("r"))
    p = (F.least("up", F.col("r") - F.col("up")) + 1) / (F.col("r") + 1)
    return out.drop("z", "n", "zz").join(tail.select(*by, "id", p.alias("p_sim")), [*by, "id"])


def getis_ord(edges: DataFrame, data: DataFrame, value: str, key: str = "market", by: Sequence[str] = ()) -> DataFrame:
    """(by, id, g, expected, z, p): the share of a unit's neighbours in all other units' values."""
    rows = _centred(data, value, key, by)
    size = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("v").alias("t"), F.sum(F.pow("v", F.lit(2))).alias("tt"))
    lag = _both(edges, rows, by).groupBy(*by, F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("v2")).alias("l"), F.sum("w").alias("wi"), F.sum(F.pow("w", F.lit(2))).alias("w2"))
    out = _join(rows.join(lag, [*by, "id"]), size, by)
    m = F.col("n") - 1
    rest = F.col("t") - F.col("v")
    mean = rest / m
    var = (F.col("tt") - F.pow("v", F.lit(2))) / m - mean * mean
    g, e = F.col("l") / F.nullif(rest, F.lit(0.0)), F.col("wi") / m
    sd = F.sqrt((m * F.col("w2") - F.col("wi") * F.col("wi")) / (m - 1) * var / m) / F.nullif(mean, F.lit(0.0)) / F.sqrt(m)
    out = out.select(*by, "id", g.alias("g"), e.alias("expected"), ((g - e) / F.nullif(sd, F.lit(0.0))).alias("z"))
    return out.withColumn("p", dist.normal_p("z"))


def integration(edges: DataFrame, panel: DataFrame, method: str = "moran", value: str = "price", conflict: str = "conflict_intensity", key: str = "market", ts: str = "date", least: int = 3) -> DataFrame:
    """(date, n, measure, mean_conflict): per period Moran's I, 1 - Geary's C or corr(p, Wp) of prices (I16).

    Only edges between markets that are there count; periods of fewer than ``least`` markets go.
    """
    z = panel.withColumn("_z", (F.col(value) - F.avg(value).over(Window.partitionBy(ts))) / F.nullif(F.stddev_samp(value).over(Window.partitionBy(ts)), F.lit(0.0)))
    if method == "moran":
        found = moran(edges, z, "_z", key, [ts]).select(ts, "n", F.col("moran").alias("measure"))
    elif method == "geary":
        found = geary(edges, z, "_z", key, [ts]).select(ts, "n", (1 - F.col("geary")).alias("measure"))
    elif method == "correlation":
        lag = weights.spatial_lag(edges, z, "_z", key, [ts], "_l")
        found = z.join(lag, [ts, key]).groupBy(ts).agg(F.count("*").alias("n"), F.corr("_z", "_l").alias("measure"))
    else:
        raise ValueError(f"unknown method {method}")
    return found.where(F.col("n") >= least).join(panel.groupBy(ts).agg(F.avg(conflict).alias("mean_conflict")), ts)


def integration_trend(measures: DataFrame) -> DataFrame:
    """The regression of the measure on mean conflict (I16)."""
    return grouped_ols(measures, [], "measure", ["mean_conflict"])


def price_dispersion(panel: DataFrame, value: str = "price", conflict: str = "conflict_intensity", ts: str = "date") -> DataFrame:
    """The regression of the monthly coefficient of variation on mean conflict."""
    rows = describe.dispersion(panel, value, ts).join(describe.mean_by(panel, conflict, ts, "mean_conflict"), ts)
    return grouped_ols(rows, [], "cv", ["mean_conflict"])


def price_transmission(panel: DataFrame, reference: str, value: str = "price", conflict: str = "conflict_intensity", key: str = "market", ts: str = "date", least: int = 10) -> DataFrame:
    """Per market: its price on the reference price, conflict and their product; markets under ``least`` dates go."""
    ref = panel.where(F.col(key) == reference).select(ts, F.col(value).alias("p_ref"))
    rows = panel.where(F.col(key) != reference).select(key, ts, F.col(value).alias("p"), F.col(conflict).alias("conflict")).join(ref, ts)
    fits = grouped_ols(rows, [key], "p", {"p_ref": F.col("p_ref"), "conflict": F.col("conflict"), "p_ref_conflict": F.col("p_ref") * F.col("conflict")})
    return fits.where(F.col("n_obs") >= least)
