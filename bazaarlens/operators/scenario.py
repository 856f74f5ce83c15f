"""Counterfactuals: unified exchange rates (N3) and better connections (N4), and the change against the base."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.operators import spatial_reg, weights


def unify_rates(panel: DataFrame, rate_a: str = "rate_a", rate_b: str = "rate_b", target: str = "official", own: Column | None = None, value: str = "price") -> DataFrame:
    """Both rates replaced by one and prices re-expressed: price * unified / own rate.

    ``target``: official (rate_a), parallel (rate_b) or average.  ``own`` is the rate that a row's price was quoted at.
    """
    made = {"official": F.col(rate_a), "parallel": F.col(rate_b), "average": (F.col(rate_a) + F.col(rate_b)) / 2}
    if target not in made:
        raise ValueError(f"unknown target {target}")
    own = F.col(rate_b) if own is None else own
    out = panel.withColumn("unified_rate", made[target])
    return out.withColumn(value, F.try_divide(F.col(value) * F.col("unified_rate"), own)).withColumns({rate_a: F.col("unified_rate"), rate_b: F.col("unified_rate")})


def delta(base: DataFrame, scenario: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, c_base, c_scenario, c_change in percent of the base) for each column."""
    joined = base.select(*keys, *[F.col(c).alias(f"{c}_base") for c in columns]).join(scenario.select(*keys, *[F.col(c).alias(f"{c}_scenario") for c in columns]), list(keys))
    change = {f"{c}_change": 100 * (F.col(f"{c}_scenario") - F.col(f"{c}_base")) / F.nullif(F.abs(f"{c}_base"), F.lit(0.0)) for c in columns}
    return joined.withColumns(change)


def with_speed(fits: DataFrame) -> DataFrame:
    """Fits with ``speed``: the adjustment of the outer regime."""
    return fits.withColumn("speed", F.abs(F.col("rho_below")))


def reconnect(distances: DataFrame, improvement: float, kind: str = "distance", alpha: float = -1.0, bandwidth: float | None = None, base: DataFrame | None = None) -> DataFrame:
    """Edges after distances shrink by the factor 1 - improvement (N4), row-normalised.

    distance and kernel weights come from shrunk distances (src, dst, d); contiguity is extended to pairs within the base
    edges' largest distance times 1 - improvement.  Nearest neighbours don't change with scale and are refused.
    """
    shrunk = distances.withColumn("d", F.col("d") * (1 - improvement))
    if kind == "distance":
        edges = shrunk.where("d > 0").select("src", "dst", F.pow("d", F.lit(alpha)).alias("w"))
    elif kind == "kernel":
        if bandwidth is None:
            raise ValueError("kernel weights need a bandwidth")
        u = F.col("d") / F.lit(bandwidth)
        edges = shrunk.where(u <= 1).select("src", "dst", F.exp(-u * u / 2).alias("w"))
    elif kind == "contiguity":
        if base is None:
            raise ValueError("contiguity needs the base edges")
        most = base.select("src", "dst").join(distances, ["src", "dst"]).agg(F.max("d").alias("m"))  # one row
        near = distances.crossJoin(F.broadcast(most)).where(F.col("d") <= F.col("m") * (1 - improvement)).select("src", "dst")
        edges = base.select("src", "dst").union(near).distinct().withColumn("w", F.lit(1.0))
    else:
        raise ValueError(f"{kind} weights don't depend on the scale of distances")
    return weights.row_normalize(edges)


def connectivity(data: DataFrame, base: DataFrame, changed: DataFrame, y: str, xs: Sequence[str], key: str = "market") -> DataFrame:
    """(spatial_base, spatial_scenario, spatial_change): the lag model under both edge tables."""
    a, b = (spatial_reg.lag_model(data, e, y, xs, key).select("model", "spatial") for e in (base, changed))
    return delta(a, b, ["model"], ["spatial"])
