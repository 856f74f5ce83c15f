"""Spatial weights as edge tables (src, dst, w) (I1-I11).  Points have an id, x and y."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.plans.lineage import saved

KERNELS = ("gaussian", "triangular", "uniform", "quadratic", "quartic")


def _minkowski(p: float) -> Column:
    dx, dy = F.abs(F.col("x") - F.col("x2")), F.abs(F.col("y") - F.col("y2"))
    if p == math.inf:
        return F.greatest(dx, dy)
    return F.hypot(dx, dy) if p == 2 else F.pow(F.pow(dx, p) + F.pow(dy, p), 1 / p)


def _cells(points: DataFrame, size: Column | float) -> DataFrame:
    return points.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})


def band_pairs(points: DataFrame, threshold: float, key: str = "market", p: float = 2.0) -> DataFrame:
    """(src, dst, d) at most ``threshold`` apart, by an equi-join on grid cells of that size and their neighbours."""
    base = points.select(F.col(key).alias("src"), "x", "y")
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    left = _cells(base, threshold)
    left = left.withColumn("cx", F.explode(F.transform(step, lambda i: F.col("cx") + i))).withColumn("cy", F.explode(F.transform(step, lambda i: F.col("cy") + i)))
    right = _cells(base, threshold).select(F.col("src").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cx", "cy")
    return left.join(right, ["cx", "cy"]).where("src != dst").withColumn("d", _minkowski(p)).where(F.col("d") <= threshold).select("src", "dst", "d")


def nearest_pairs(points: DataFrame, k: int, key: str = "market", p: float = 2.0) -> DataFrame:
    """(src, dst, d, rank): the k nearest other points, ties to the smaller id.

    Rings of grid cells are widened round by round, and only for points whose k-th neighbour may still lie outside what
    was searched; cells hold about k points each on average, so the first round settles most.
    """
    base = saved(points.select(F.col(key).alias("src"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna())
    n, x0, x1, y0, y1 = base.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if n < 2:
        return base.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("d"), F.lit(1).alias("rank")).where("false")
    width = max(x1 - x0, y1 - y0) or 1.0
    need, size, done, todo = min(k, n - 1), width * math.sqrt((k + 1) / n), None, base
    right = None
    while True:
        cells = lambda df: df.withColumns({"cx": F.floor((F.col("x") - x0) / size), "cy": F.floor((F.col("y") - y0) / size)})  # noqa: B023, E731
        step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
        left = cells(todo)
        left = left.withColumn("cx", F.explode(F.transform(step, lambda i: F.col("cx") + i))).withColumn("cy", F.explode(F.transform(step, lambda i: F.col("cy") + i)))
        right = cells(base).select(F.col("src").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cx", "cy")
        found = left.join(right, ["cx", "cy"]).where("src != dst").withColumn("d", _minkowski(p))
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))).where(F.col("rank") <= need).select("src", "dst", "d", "rank")
        ranked = saved(ranked)
        # what is nearer than one cell was seen whole
        whole = size > width
        far = ranked.groupBy("src").agg(F.count("*").alias("c"), F.max("d").alias("m")).where((F.col("c") == need) & ((F.col("m") < size) | F.lit(whole))).select("src")
        good = ranked.join(far, "src", "left_semi")
        done = good if done is None else done.unionAll(good)
        todo = saved(todo.join(far, "src", "left_anti"))
        if whole or todo.isEmpty():
            return done
        size *= 2


def knn(points: DataFrame, k: int = 4, key: str = "market", p: float = 2.0) -> DataFrame:
    """k nearest neighbours, weight 1."""
    return nearest_pairs(points, k, key, p).select("src", "dst", F.lit(1.0).alias("w"))


def distance_band(points: DataFrame, threshold: float, alpha: float = -1.0, key: str = "market", p: float = 2.0) -> DataFrame:
    """Weight d^alpha within the threshold (I2); coincident points have no weight under a negative power."""
    edges = band_pairs(points, threshold, key, p)
    return edges.where("d > 0" if alpha < 0 else "true").select("src", "dst", F.pow("d", F.lit(alpha)).alias("w"))


def contiguity(areas: DataFrame, kind: str = "queen", key: str = "market", ring: str = "ring") -> DataFrame:
    """Areas that share a vertex (queen) or an edge (rook) of their rings (I3); points instead get 4 nearest neighbours."""
    if ring not in areas.columns:
        return knn(areas, 4, key)
    at = areas.select(F.col(key).alias("id"), F.posexplode(ring).alias("i", "v"))
    if kind == "queen":
        parts = at.select("id", F.col("v.x").alias("a"), F.col("v.y").alias("b")).distinct()
        on = ["a", "b"]
    elif kind == "rook":
        n = F.size(ring)
        sides = areas.select(F.col(key).alias("id"), F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(F.col(ring), i).alias("p"), F.get(F.col(ring), (i + 1) % n).alias("q")))).alias("s"))
        lo, hi = F.least("s.p", "s.q"), F.greatest("s.p", "s.q")
        parts = sides.where("s.p != s.q").select("id", lo["x"].alias("a"), lo["y"].alias("b"), hi["x"].alias("c"), hi["y"].alias("e")).distinct()
        on = ["a", "b", "c", "e"]
    else:
        raise ValueError(f"unknown contiguity {kind}")
    left, right = parts.withColumnRenamed("id", "src"), parts.withColumnRenamed("id", "dst")
    return left.join(right, on).where("src != dst").select("src", "dst").distinct().withColumn("w", F.lit(1.0))


def kernel(points: DataFrame, bandwidth: float | None = None, function: str = "gaussian", k: int = 4, key: str = "market") -> DataFrame:
    """K(d / h) over the points within h (I4): a fixed bandwidth, or for each point its k-th neighbour's distance."""
    edges = band_pairs(points, bandwidth, key).withColumn("h", F.lit(bandwidth)) if bandwidth is not None else nearest_pairs(points, k, key).withColumn("h", F.max("d").over(Window.partitionBy("src")))
    u = F.col("d") / F.nullif(F.col("h"), F.lit(0.0))
    made = {"gaussian": F.exp(-u * u / 2) / math.sqrt(2 * math.pi), "triangular": 1 - u, "uniform": F.lit(0.5), "quadratic": 0.75 * (1 - u * u), "quartic": 15.0 / 16 * F.pow(1 - u * u, 2)}
    if function not in made:
        raise ValueError(f"unknown kernel {function}")
    return edges.select("src", "dst", F.coalesce(made[function], F.lit(0.0)).alias("w"))


def row_normalize(edges: DataFrame) -> DataFrame:
    """Weights over their row's sum."""
    return edges.withColumn("w", F.col("w") / F.nullif(F.sum("w").over(Window.partitionBy("src")), F.lit(0.0)))


def conflict(distances: DataFrame, attribute: DataFrame, alpha: float = -1.0, normalize: bool = True, key: str = "market", value: str = "conflict_intensity") -> DataFrame:
    """d^alpha (1 - conflict of the destination) over an edge table (src, dst, d)."""
    c = attribute.select(F.col(key).alias("dst"), F.col(value).alias("c"))
    edges = distances.where("d > 0").join(c, "dst").select("src", "dst", (F.pow("d", F.lit(alpha)) * (1 - F.col("c"))).alias("w"))
    return row_normalize(edges) if normalize else edges


def conflict_adjusted(edges: DataFrame, attribute: DataFrame, conflict_weight: float = 0.5, key: str = "market", value: str = "conflict_intensity") -> DataFrame:
    """1 - conflict_weight * conflict of the destination, on the edges given."""
    c = attribute.select(F.col(key).alias("dst"), F.col(value).alias("c"))
    return edges.select("src", "dst").join(c, "dst").select("src", "dst", (1 - conflict_weight * F.col("c")).alias("w"))


def from_table(table: DataFrame, source: str = "source", target: str = "target", weight: str = "weight", normalize: bool = True) -> DataFrame:
    """Edges from a list of weights (I8): complete rows, row-normalised."""
    edges = table.select(F.col(source).alias("src"), F.col(target).alias("dst"), F.col(weight).cast("double").alias("w")).dropna()
    return row_normalize(edges) if normalize else edges


def create(points: DataFrame, kind: str = "knn", key: str = "market", normalize: bool = True, **options) -> DataFrame:
    """knn, distance, contiguity or kernel weights by name."""
    made = {"knn": knn, "distance": distance_band, "contiguity": contiguity, "queen": contiguity, "kernel": kernel}
    if kind not in made:
        raise ValueError(f"unknown weights {kind}")
    edges = made[kind](points, key=key, **options)
    return row_normalize(edges) if normalize else edges


def neighbours(edges: DataFrame, unit=None) -> DataFrame:
    """(src, neighbours map dst -> w), for one unit or all."""
    some = edges if unit is None else edges.where(F.col("src") == F.lit(unit))
    return some.groupBy("src").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dst", "w")))).alias("neighbours"))


def dense(edges: DataFrame, ids: Sequence[str], most: int = 1000) -> DataFrame:
    """src x dst as columns (I10); the edge table is the sparse form.  Refuses more than ``most`` columns."""
    if len(ids) > most:
        raise ValueError(f"{len(ids)} columns are too many for a dense matrix")
    return edges.groupBy("src").pivot("dst", list(ids)).agg(F.sum("w")).na.fill(0.0)


def spatial_lag(edges: DataFrame, data: DataFrame, value: str, key: str = "market", by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """(by, key, lag): for each unit the weighted sum over its neighbours."""
    other = data.select(*by, F.col(key).alias("dst"), F.col(value).alias("_v"))
    return edges.join(other, "dst").groupBy(*by, F.col("src").alias(key)).agg(F.sum(F.col("w") * F.col("_v")).alias(name or f"lag_{value}"))


def save(edges: DataFrame, path: str) -> None:
    """Persist an edge table."""
    edges.write.mode("overwrite").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
