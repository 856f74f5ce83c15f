"""Thresholds from transaction costs between neighbours (K)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.operators import coint, describe, joins, threshold


def transaction_costs(edges: DataFrame, prices: DataFrame, conflict: DataFrame, conflict_weight: float = 0.5, unit: str = "region", ts: Sequence[str] = ()) -> DataFrame:
    """(src[, ts], cost): the mean over neighbours of |p_i - p_j| (1 + cw (c_i + c_j) / 2) (K1)."""
    near = joins.neighbour_prices(edges, prices, conflict, unit, ts)
    cost = F.avg(F.abs(F.col("p_src") - F.col("p_dst"))) * F.avg(1 + conflict_weight * (F.col("c_src") + F.col("c_dst")) / 2)
    return near.groupBy("src", *ts).agg(cost.alias("cost"))


def neighbour_thresholds(edges: DataFrame, panel: DataFrame, costs: DataFrame, value: str = "price", unit: str = "market", ts: str = "date", mode: str = "standard", max_lags: int = 2) -> DataFrame:
    """(src, dst, threshold, rho_below, speed, integrated): a fit per unit and neighbour at the unit's cost (K2).

    Integrated if the lower regime's adjustment is under -0.1; the speed is its size.
    """
    series = panel.select(F.col(unit).alias("u"), F.col(ts).alias("ts"), F.col(value).cast("double").alias("v"))
    side = lambda k, n: series.select(F.col("u").alias(k), "ts", F.col("v").alias(n))
    pairs = edges.select("src", "dst").join(side("src", "y"), "src").join(side("dst", "x"), ["dst", "ts"]).select("src", "dst", "ts", "y", "x")
    keys = ["src", "dst"]
    rows = threshold.prepare(coint.residuals(pairs, keys), keys, ["ts"], max_lags, "level" if mode == "standard" else "standard")
    taus = rows.select(*keys).distinct().join(costs.select("src", F.col("cost").alias("threshold")), "src")
    fits = threshold.fit_at(rows, taus, keys, max_lags, "tar" if mode == "standard" else "mtar", True)
    return fits.where("status = 'ok'").select(*keys, "threshold", "rho_below", F.abs("rho_below").alias("speed"), (F.col("rho_below") < -0.1).alias("integrated"))


def unit_rates(thresholds: DataFrame) -> DataFrame:
    """(src, n, integration_rate, mean_threshold, mean_speed) (K2)."""
    return thresholds.groupBy("src").agg(F.count("*").alias("n"), F.avg(F.col("integrated").cast("double")).alias("integration_rate"), F.avg("threshold").alias("mean_threshold"), F.avg("speed").alias("mean_speed"))


def patterns(rates: DataFrame, value: str = "integration_rate") -> DataFrame:
    """Units with a high, low or medium cluster by mean +- deviation (K3)."""
    return describe.cluster_flags(rates, value)


def estimate_with_conflict(edges: DataFrame, panel: DataFrame, value: str = "price", conflict: str = "conflict_intensity", unit: str = "market", ts: str = "date", conflict_weight: float = 0.5, mode: str = "standard", max_lags: int = 2) -> dict[str, DataFrame]:
    """Costs, thresholds, rates and patterns (K4)."""
    prices = panel.select(unit, ts, F.col(value).alias("price"))
    intensity = panel.select(unit, ts, F.col(conflict).alias("conflict"))
    costs = transaction_costs(edges, prices, intensity, conflict_weight, unit, [ts]).groupBy("src").agg(F.avg("cost").alias("cost"))
    found = neighbour_thresholds(edges, panel, costs, value, unit, ts, mode, max_lags)
    rates = unit_rates(found)
    return {"costs": costs, "thresholds": found, "rates": rates, "patterns": patterns(rates)}


def conflict_impact(rates: DataFrame, conflict: DataFrame, value: str = "integration_rate", key: str = "src", intensity: str = "conflict_intensity") -> dict[str, DataFrame]:
    """Statistics above and below the median conflict, correlation and fitted line (K5)."""
    rows = rates.join(conflict, key)
    line = rows.agg(F.corr(intensity, value).alias("corr"), F.regr_slope(value, intensity).alias("slope"), F.regr_intercept(value, intensity).alias("intercept"), F.count("*").alias("n"))
    return {"levels": describe.group_levels(rows, intensity, value), "line": line}
