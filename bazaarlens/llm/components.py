"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is hung on the least of u and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are hung on the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def contracted(edges: DataFrame, rounds: int) -> DataFrame:
    """Edges (u > v) of the same components after some rounds, each a checkpoint: most nodes have one edge left, to the least node near them."""
    now = edges.where("u > v").select("u", "v").distinct()
    for _ in range(rounds):
        now = saved(_small_star(_large_star(now).distinct()).distinct())
    return now


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node that isn't the least of its component, and that least node.

    ``edges`` has columns u and v with u > v.  The rounds end when a round changes nothing; each is a checkpoint.
    """
    now, before = saved(edges.where("u > v").select("u", "v").distinct()), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now
        before = state
        now = saved(_small_star(_large_star(now).distinct()).distinct())
