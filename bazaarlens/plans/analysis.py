"""The whole analysis as lazy result tables (N1, N2): the series or pair is a key, so there is no fan-out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from bazaarlens.operators import clean, coint, joins, project, scenario, spatial_reg, threshold, unitroot
from bazaarlens.plans.lineage import saved


def run(observations: DataFrame, commodity: str | None = None, markets: Sequence[str] | None = None, modes: Sequence[str] = ("standard", "fixed", "mtar", "tvecm"), points: DataFrame | None = None, xs: Sequence[str] = ("conflict_intensity",), rates: tuple[str, str] | None = None, pair_filter: DataFrame | None = None, max_lags: int = 4) -> dict[str, DataFrame]:
    """Filter, impute, test and model a table (market, date, price, ...): one DataFrame per result.

    The panel and the pairs, which several results read, are checkpoints; nothing else runs before a result is asked for.
    """
    rows = project.ensure_market(observations)
    rows = project.filter_commodity(rows, commodity) if commodity is not None else rows
    rows = project.filter_markets(rows, markets) if markets is not None else rows
    panel = saved(clean.preprocess(rows))
    pairs = saved(joins.market_pairs(panel, pair_filter=pair_filter).select("pair_id", "ts", "y", "x"))
    out = {"quality": clean.quality_report(panel), "unit_roots": unitroot.all_tests(panel, ["market"], ["date"], max_lags=max_lags), "cointegration": coint.all_tests(pairs, max_lags=max_lags)}
    for mode in modes:
        out[f"threshold_{mode}"] = threshold.fit_pairs(pairs, mode, **({} if mode == "tvecm" else {"max_lags": max_lags}))
    if points is not None:
        out |= {f"spatial_{k}": v for k, v in spatial_reg.full_analysis(panel, points, "price", xs).items()}
    if rates is not None:
        unified = joins.market_pairs(scenario.unify_rates(panel, *rates)).select("pair_id", "ts", "y", "x")
        base, changed = (scenario.with_speed(threshold.fit_pairs(p, "standard", max_lags=max_lags)) for p in (pairs, unified))
        out["unified_rates"] = scenario.delta(base, changed, ["pair_id"], ["threshold", "speed"])
    return out
