"""Long series in ranges, break searches and strong spatial dependence, each held against SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.operators import clean, coint, describe, features, panel_reg, spatial_reg, threshold, unitroot
from bazaarlens.plans.exact_queries import ADF_ROWS, BEST, FITTED, ROWS, SPATIAL, TRIED
from bazaarlens.plans.lineage import saved
from bazaarlens.plans.model_queries import KEYS, ORDER, P, PP, pairs, panel
from bazaarlens.plans.panel import PANEL_SQL, read
from bazaarlens.plans.regression_sql import ols_sql
from bazaarlens.plans.registry import query, rounded
from bazaarlens.plans.space_queries import XS, cross, edges, table
from bazaarlens.plans.table_queries import EO, GAPPY, events, gappy

#: Rows of a range: the events are one series here, which is cut into some hundred ranges.
RANGE = 997


# One series of all events, in ranges


@query("SELECT event_id, round(lag(value, 1) OVER w, 6) AS value_lag_1, round(lag(value, 30) OVER w, 6) AS value_lag_30 FROM events WINDOW w AS (ORDER BY ts, event_id)")
def f1_lags_one_series(spark, sf_dir):
    return rounded(features.lags(events(spark, sf_dir), ["value"], [1, 30], [], EO, rows=RANGE).select("event_id", "value_lag_1", "value_lag_30"))


@query("SELECT event_id, round(avg(value) OVER w, 6) AS value_roll_50_mean, round(stddev_samp(value) OVER w, 6) AS value_roll_50_std, round(max(value) OVER w, 6) AS value_roll_50_max FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)")
def f2_rolling_one_series(spark, sf_dir):
    return rounded(features.rolling(events(spark, sf_dir), ["value"], [50], [], EO, ("mean", "std", "max"), rows=RANGE).drop("user_id", "ts", "event_type", "value"))


@query(f"WITH {GAPPY} SELECT event_id, round(coalesce(last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS value FROM g")
def f11_fill_one_series(spark, sf_dir):
    return rounded(features.fill(gappy(spark, sf_dir), "value", [], EO, rows=RANGE).select("event_id", "value"))


@query(f"""WITH {GAPPY}, i AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS i FROM g), k AS (
  SELECT event_id, value, i, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i0, last_value(value IGNORE NULLS) OVER a AS v0,
   first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i1, first_value(value IGNORE NULLS) OVER b AS v1 FROM i
  WINDOW a AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT event_id, round(CASE WHEN value IS NOT NULL THEN value WHEN v1 IS NULL THEN v0 WHEN v0 IS NULL THEN NULL ELSE v0 + (v1 - v0) * (i - i0) / (i1 - i0) END, 6) AS value FROM k""")
def c1_interpolate_one_series(spark, sf_dir):
    return rounded(clean.interpolate(gappy(spark, sf_dir), "value", [], EO, rows=RANGE).select("event_id", "value"))


# the average as a sum of scaled values within spans of 1000 rows, each of which starts from the last one's end
@query("""WITH RECURSIVE d AS (SELECT event_id, row_number() OVER w - 2 AS i, value - lag(value) OVER w AS d FROM events WINDOW w AS (ORDER BY ts, event_id)),
 x AS (SELECT *, i // 1000 AS cell, i % 1000 AS r, CASE WHEN i = 0 THEN d ELSE 0.001 * d END AS x FROM d WHERE i >= 0),
 l AS (SELECT event_id, i, cell, r, sum(x * pow(0.999, -r)) OVER (PARTITION BY cell ORDER BY r) * pow(0.999, r) AS s FROM x),
 ends AS (SELECT cell, arg_max(s, r) AS s, max(r) + 1 AS n FROM l GROUP BY 1),
 carry(cell, s) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION ALL SELECT c.cell + 1, c.s * pow(0.999, e.n) + e.s FROM carry c JOIN ends e ON e.cell = c.cell),
 m AS (SELECT l.i, l.s + c.s * pow(0.999, r + 1) AS s FROM l JOIN carry c ON l.cell = c.cell)
 SELECT d.event_id, round(s, 6) AS momentum FROM d LEFT JOIN m ON m.i = d.i - 1""")
def f15_momentum_one_series(spark, sf_dir):
    return rounded(features.momentum(events(spark, sf_dir), "value", [], EO, "exponential", alpha=0.001, rows=RANGE).select("event_id", "momentum"))


KPSS_LONG = """WITH e AS (SELECT 'all' AS series, value - avg(value) OVER () AS e, row_number() OVER (ORDER BY ts, event_id) AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL),
 t AS (SELECT *, sum(e) OVER (ORDER BY i) AS s, lag(e, 1) OVER (ORDER BY i) AS e1, lag(e, 2) OVER (ORDER BY i) AS e2, lag(e, 3) OVER (ORDER BY i) AS e3, lag(e, 4) OVER (ORDER BY i) AS e4 FROM e)
 SELECT series, round(sum(s * s) / (max(n) * max(n)) / ((sum(e * e) + 1.6 * sum(e * e1) + 1.2 * sum(e * e2) + 0.8 * sum(e * e3) + 0.4 * sum(e * e4)) / max(n)), 6) AS statistic FROM t GROUP BY 1"""


@query(KPSS_LONG)
def g3_kpss_one_series(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("series", F.lit("all"))
    return rounded(unitroot.kpss(rows, ["series"], EO, "value", rows=RANGE).select("series", "statistic"))


# Break searches


def _za_sql(trend: str) -> str:
    extra = {"c": ["du"], "t": ["dt"], "ct": ["du", "dt"]}[trend]
    rows = f"""r AS (SELECT market, date, d, z, d1, i / CAST(n_series AS DOUBLE) AS t, b AS break_at, CASE WHEN i - 1 >= b THEN 1.0 ELSE 0.0 END AS du, CASE WHEN i - 1 >= b THEN (i - b) / CAST(n_series AS DOUBLE) ELSE 0.0 END AS dt
 FROM l, unnest(range(CAST(floor(n_series * 0.15) AS BIGINT), CAST(n_series - floor(n_series * 0.15) AS BIGINT))) u(b) WHERE d1 IS NOT NULL)"""
    return f"""{ADF_ROWS}, {rows}, {ols_sql('f', 'r', ['market', 'break_at'], 'd', ['z', 't', 'd1', *extra])},
 best AS (SELECT market, b_z / se_z AS statistic, break_at, n, row_number() OVER (PARTITION BY market ORDER BY b_z / se_z, break_at) AS k FROM f)
 SELECT best.market, '{trend}' AS trend, n AS n_obs, round(statistic, 5) AS statistic, date AS break_date, statistic < {unitroot.ZA[trend][1]} AS is_stationary FROM best JOIN s ON best.market = s.market AND s.i - 1 = break_at WHERE k = 1"""


@query(" UNION ALL ".join(f"SELECT * FROM ({P.rstrip()}, {_za_sql(t)})" for t in ("c", "t", "ct")))
def g4_zivot_andrews_trends(spark, sf_dir):
    rows = panel(spark, sf_dir)
    found = reduce(DataFrame.unionAll, [unitroot.zivot_andrews(rows, KEYS, ORDER, trend=t) for t in ("c", "t", "ct")])
    return rounded(found.select("market", "trend", "n_obs", "statistic", "break_date", "is_stationary"), 5)


def _gh_sql(model: str) -> str:
    extra = {"c": [], "ct": ["t"], "cshift": ["dx"]}[model]
    fitted = "b_const + b_du * du + b_x * x" + "".join(f" + b_{c} * {c}" for c in extra)
    return f"""{PP}, s AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY pair_id) AS n_series FROM pairs),
 w AS (SELECT pair_id, ts, i, y, x, i / CAST(n_series AS DOUBLE) AS t, b AS break_at, CASE WHEN i >= b THEN 1.0 ELSE 0.0 END AS du, CASE WHEN i >= b THEN x ELSE 0.0 END AS dx
 FROM s, unnest(range(CAST(floor(n_series * 0.15) AS BIGINT), CAST(n_series - floor(n_series * 0.15) AS BIGINT))) u(b)),
 {ols_sql('f', 'w', ['pair_id', 'break_at'], 'y', ['du', 'x', *extra])},
 e AS (SELECT w.pair_id, w.break_at, i, y - ({fitted}) AS z FROM w JOIN f ON w.pair_id = f.pair_id AND w.break_at = f.break_at),
 d AS (SELECT *, lag(z) OVER (PARTITION BY pair_id, break_at ORDER BY i) AS z1, z - lag(z) OVER (PARTITION BY pair_id, break_at ORDER BY i) AS dz FROM e),
 r AS (SELECT * FROM (SELECT *, lag(dz) OVER (PARTITION BY pair_id, break_at ORDER BY i) AS d1 FROM d) WHERE d1 IS NOT NULL),
 {ols_sql('a', 'r', ['pair_id', 'break_at'], 'dz', ['z1', 'd1'], const=False)},
 best AS (SELECT pair_id, b_z1 / se_z1 AS statistic, break_at, row_number() OVER (PARTITION BY pair_id ORDER BY b_z1 / se_z1, break_at) AS k FROM a)
 SELECT best.pair_id, 'gregory_hansen_{model}' AS test, n_series AS n_obs, round(statistic, 4) AS statistic, ts AS break_date, statistic < {coint.GH[model][1]} AS is_cointegrated FROM best JOIN s ON best.pair_id = s.pair_id AND s.i = break_at WHERE k = 1"""


@query(" UNION ALL ".join(f"SELECT * FROM ({_gh_sql(m)})" for m in ("c", "ct", "cshift")))
def h3_gregory_hansen_models(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    found = reduce(DataFrame.unionAll, [coint.gregory_hansen(rows, m).select("pair_id", "test", "n_obs", "statistic", "break_date", "is_cointegrated") for m in ("c", "ct", "cshift")])
    return rounded(found, 4)


# pairs are known by name and regime here, so that the fits within regimes read like those of whole pairs
REGIMES = f"""{ROWS.replace('pairs AS (', 'all_pairs AS (', 1)}, {TRIED}{FITTED}{BEST}""".replace("all_pairs AS (", "whole_pairs AS (")


def _with_regimes(sql: str, dates: str) -> str:
    """The query with ``pairs`` cut at ``dates`` (pair_id, d): both ends of an interval belong to it, those too short for a fit go."""
    cut = f"""breaks AS ({dates}), bounds AS (SELECT pair_id, min(ts) AS lo, max(ts) AS hi FROM whole_pairs GROUP BY 1),
 points AS (SELECT b.pair_id, d FROM breaks b JOIN bounds o ON b.pair_id = o.pair_id WHERE d > lo AND d < hi UNION SELECT pair_id, lo FROM bounds UNION SELECT pair_id, hi FROM bounds),
 spans AS (SELECT * FROM (SELECT pair_id, d AS lo, lead(d) OVER (PARTITION BY pair_id ORDER BY d) AS hi, row_number() OVER (PARTITION BY pair_id ORDER BY d) AS regime FROM points) WHERE hi IS NOT NULL),
 inside AS (SELECT p.pair_id || '#' || regime AS pair_id, ts, y, x FROM whole_pairs p JOIN spans s ON p.pair_id = s.pair_id AND ts BETWEEN lo AND hi),
 pairs AS (SELECT * FROM inside WHERE pair_id IN (SELECT pair_id FROM inside GROUP BY 1 HAVING count(*) >= 15))"""
    head, tail = sql.split(", v AS (", 1)
    return f"{head}, {cut}, v AS ({tail}"


AIC = "n * (ln(2 * pi()) + ln(ssr / n) + 1) + 2 * 7"
SHOWN = f""", one AS (SELECT *, {AIC} AS aic FROM best WHERE k = 1) SELECT split_part(pair_id, '#', 1) AS pair_id, CAST(split_part(pair_id, '#', 2) AS INTEGER) AS regime, n AS n_obs, round(tau, 4) AS threshold, round(b_up, 5) AS rho_above, round(b_down, 5) AS rho_below,
 round(sum(n * aic) OVER (PARTITION BY split_part(pair_id, '#', 1)) / sum(n) OVER (PARTITION BY split_part(pair_id, '#', 1)), 3) AS weighted_aic FROM one"""


def shown_regimes(fits: DataFrame) -> DataFrame:
    return rounded(fits.where("status = 'ok'").select("pair_id", "regime", "n_obs", F.round("threshold", 4).alias("threshold"), "rho_above", "rho_below", F.round("weighted_aic", 3).alias("weighted_aic")), 5)


@query(_with_regimes(REGIMES, "SELECT DISTINCT pair_id, DATE '1998-06-01' AS d FROM whole_pairs") + SHOWN)
def h23_regime_fits(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    dates = rows.select("pair_id").distinct().withColumn("break_date", F.lit("1998-06-01").cast("date"))
    return shown_regimes(threshold.with_breaks(rows, dates))


_TWO = "u AS (SELECT pair_id || '/y' AS market, ts AS date, y AS price FROM whole_pairs UNION ALL SELECT pair_id || '/x', ts, x FROM whole_pairs)"
_DATES = f"WITH {_TWO}, {_za_sql('c').replace('FROM panel', 'FROM u')}"


@query(_with_regimes(REGIMES, f"SELECT DISTINCT left(market, length(market) - 2) AS pair_id, break_date AS d FROM ({_DATES})") + SHOWN)
def h23_detected_breaks(spark, sf_dir):
    """Regimes between the Zivot-Andrews dates of both series of a pair."""
    return shown_regimes(threshold.with_breaks(pairs(spark, sf_dir)))


# Likelihoods of spatial models: traces of powers of W, and a grid that is refined four times

_POWERS = """ids AS (SELECT market, row_number() OVER (ORDER BY market) AS i FROM r), mat AS (SELECT a.i, b.i AS j, w FROM e JOIN ids a ON src = a.market JOIN ids b ON dst = b.market),
 pw(k, i, j, v) AS (SELECT 1, i, j, w FROM mat UNION ALL SELECT k + 1, p.i, m.j, sum(p.v * m.w) FROM pw p JOIN mat m ON p.j = m.i WHERE k < 300 GROUP BY k, p.i, m.j),
 tr AS (SELECT k, coalesce(sum(v) FILTER (WHERE i = j), 0) AS t FROM pw GROUP BY 1)"""


#: Where the series converges quickly.
BOUNDS = (-0.93, 0.93)


def _likeliest(value: str, source: str) -> str:
    """CTEs that end in ``top`` (rho, ll): the rho of the largest ``value`` of ``source`` (one row for each rho)."""
    out, centre = [], None
    for level, (step, count) in enumerate(((0.01, 93), (1e-4, 100), (1e-6, 100), (1e-8, 100))):
        grid = f"SELECT x * {step} AS rho FROM range(-{count}, {count + 1}) t(x)" if centre is None else f"SELECT rho + x * {step} AS rho FROM {centre}, range(-{count}, {count + 1}) t(x)"
        out.append(f"grid{level} AS (SELECT * FROM ({grid}) WHERE rho BETWEEN {BOUNDS[0]} AND {BOUNDS[1]})")
        out.append(f"det{level} AS (SELECT rho, -sum(pow(rho, k) * t / k) AS logdet FROM grid{level}, tr GROUP BY 1)")
        out.append(f"like{level} AS (SELECT rho, logdet + ({value}) AS ll FROM ({source.replace('GRID', f'det{level}')}))")
        out.append(f"best{level} AS (SELECT arg_max(rho, ll) AS rho, max(ll) AS ll FROM like{level})")
        centre = f"best{level}"
    return ", ".join(out) + f", top AS (SELECT * FROM {centre})"


_LL = "-n / 2.0 * (ln(2 * pi()) + ln(s2) + 1)"
_LAG_SUMS = """sums AS (SELECT count(*) AS n, count(*) * (var_pop(p) - covar_pop(p, x) ** 2 / var_pop(x)) AS e00, count(*) * (covar_pop(p, wp) - covar_pop(p, x) * covar_pop(wp, x) / var_pop(x)) AS e0l,
 count(*) * (var_pop(wp) - covar_pop(wp, x) ** 2 / var_pop(x)) AS ell, covar_pop(p, x) / var_pop(x) AS bp, covar_pop(wp, x) / var_pop(x) AS bw FROM r)"""
LAG_ML = f"{SPATIAL.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_POWERS}, {_LAG_SUMS}, {_likeliest(_LL, 'SELECT rho, logdet, n, (e00 - 2 * rho * e0l + rho * rho * ell) / n AS s2 FROM GRID, sums')}"


@query(f"{LAG_ML} SELECT n AS n_obs, round(rho, 4) AS rho, round(ll, 4) AS log_lik, round((bp - rho * bw) / 1000, 3) AS b_x FROM top, sums")
def j2_lag_likelihood(spark, sf_dir):
    fit = spatial_reg.lag_model(cross(spark, sf_dir), edges(spark, sf_dir), "price", ["conflict_intensity"], method="ml", bounds=BOUNDS)
    return rounded(fit.select("n_obs", F.col("spatial").alias("rho"), "log_lik", F.round(F.element_at("coef", "conflict_intensity") / 1000, 3).alias("b_x")), 4)


@query(f"{LAG_ML}, s AS (SELECT rho, 1 + sum(pow(rho, k) * t) / max(n) AS share FROM top, tr, sums GROUP BY rho) SELECT 'conflict_intensity' AS variable, round(share * (1 - rho), 4) AS direct_share, round(1 / (1 - rho), 4) AS multiplier FROM s")
def j5_effect_shares(spark, sf_dir):
    """The part of the total effect that is direct, and the total effect of a unit change over its coefficient."""
    c, e = cross(spark, sf_dir), edges(spark, sf_dir)
    model = saved(spatial_reg.lag_model(c, e, "price", ["conflict_intensity"], method="ml", bounds=BOUNDS))
    found = spatial_reg.impacts(model, e, c, ["conflict_intensity"])
    coef = model.select(F.element_at("coef", "conflict_intensity").alias("b"))
    return rounded(found.crossJoin(F.broadcast(coef)).select("variable", (F.col("direct") / F.col("total")).alias("direct_share"), (F.col("total") / F.col("b")).alias("multiplier")), 4)


_ERROR_ROWS = """SELECT rho, any_value(logdet) AS logdet, count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_, sum(y * y) AS yy
 FROM (SELECT rho, logdet, 1 - rho * w1 AS a, x - rho * wx AS b, p - rho * wp AS y FROM GRID, r1) GROUP BY rho"""
_ERROR_S2 = f"SELECT rho, logdet, n, (yy - (bb * ay * ay - 2 * ab * ay * by_ + aa * by_ * by_) / (aa * bb - ab * ab)) / n AS s2 FROM ({_ERROR_ROWS})"
ERROR_ML = f"{SPATIAL.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_POWERS}, r1 AS (SELECT r.*, coalesce(w1, 0) AS w1 FROM r LEFT JOIN (SELECT src, sum(w) AS w1 FROM e WHERE dst IN (SELECT market FROM r) GROUP BY 1) o ON o.src = r.market), {_likeliest(_LL, _ERROR_S2)}"


@query(f"{ERROR_ML} SELECT round(rho, 4) AS lambda, round(ll, 4) AS log_lik FROM top")
def j3_error_likelihood(spark, sf_dir):
    fit = spatial_reg.error_model(cross(spark, sf_dir), edges(spark, sf_dir), "price", ["conflict_intensity"], method="ml", bounds=BOUNDS)
    return rounded(fit.select(F.col("spatial").alias("lambda"), "log_lik"), 4)


# Aggregates by an order, and the covariance of periods


@query("SELECT l_returnflag, l_linestatus, arg_min(l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS l_quantity_first, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS l_quantity_last FROM lineitem GROUP BY 1, 2")
def e1_first_last(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_shipdate", "l_orderkey", "l_linenumber")
    return describe.aggregate(items, ["l_returnflag", "l_linestatus"], {"l_quantity": ["first", "last"]}, ["l_shipdate", "l_orderkey", "l_linenumber"])


_KERNEL_LAGS = ", ".join(f"coalesce(lag({c}, {j}) OVER (ORDER BY date), 0) AS {c}{j}" for c in ("sa", "sb") for j in range(1, 6))
_KERNEL_SUM = lambda p, q: f"sum({p} * {q} + " + " + ".join(f"greatest(0, 1 - {j} / (l + 1.0)) * ({p} * {q}{j} + {p}{j} * {q})" for j in range(1, 6)) + ")"


@query(f"""WITH {PANEL_SQL}, w AS (SELECT market, date, price - avg(price) OVER m AS y, conflict_intensity - avg(conflict_intensity) OVER m AS a, rate_a - avg(rate_a) OVER m AS b FROM panel WINDOW m AS (PARTITION BY market)),
 {ols_sql('f', 'w', [], 'y', ['a', 'b'], const=False)},
 u AS (SELECT date, sum(a * (y - b_a * a - b_b * b)) AS sa, sum(b * (y - b_a * a - b_b * b)) AS sb FROM w, f GROUP BY 1), g AS (SELECT *, {_KERNEL_LAGS} FROM u),
 t AS (SELECT floor(4 * pow(count(*) / 100.0, 2 / 9.0)) AS l FROM u), m AS (SELECT {_KERNEL_SUM('sa', 'sa')} AS aa, {_KERNEL_SUM('sa', 'sb')} AS ab, {_KERNEL_SUM('sb', 'sb')} AS bb FROM g, t),
 d AS (SELECT v_a_a * df / ssr AS iaa, v_a_b * df / ssr AS iab, v_b_b * df / ssr AS ibb, n / CAST(df - (SELECT count(DISTINCT market) FROM panel) AS DOUBLE) AS scale FROM f)
 SELECT 'kernel' AS cov_type, round(sqrt((iaa * iaa * aa + 2 * iaa * iab * ab + iab * iab * bb) * scale), 4) AS se1, round(sqrt((iab * iab * aa + 2 * iab * ibb * ab + ibb * ibb * bb) * scale), 4) AS se2 FROM m, d""")
def l7_kernel(spark, sf_dir):
    fit = panel_reg.fixed(table(spark, sf_dir), "price", XS, cov_type="kernel")
    return rounded(fit.select("cov_type", F.element_at("se", XS[0]).alias("se1"), F.element_at("se", XS[1]).alias("se2")), 4)


@query("SELECT CAST(r AS INT) AS rep, (SELECT count(*) FROM events WHERE value IS NOT NULL) AS n FROM range(1000) t(r)")
def e11_bootstrap_counts(spark, sf_dir):
    """Each of the 1000 resamples of the whole table has as many draws as the table has rows, over all its parts."""
    rows = events(spark, sf_dir).where("value is not null")
    return describe.resampled(rows, "value", 1000, [], EO, part_rows=RANGE).groupBy("rep").agg(F.sum("n").alias("n"))


_SWEEP = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY market) AS {c}" for c in ("y", "a", "b"))
_SWEPT = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY date) AS {c}" for c in ("y", "a", "b"))


@query(f"""WITH RECURSIVE {PANEL_SQL}, s(k, market, date, y, a, b) AS (SELECT 0, market, date, price, conflict_intensity, rate_a FROM panel
 UNION ALL SELECT k + 1, market, date, {_SWEPT} FROM (SELECT k, market, date, {_SWEEP} FROM s WHERE k < 100)), r AS (SELECT * FROM s WHERE k = 100),
 {ols_sql('f', 'r', [], 'y', ['a', 'b'], const=False)} SELECT n AS n_obs, round(b_a, 4) AS b_a, round(b_b, 3) AS b_b, round(ssr / 1e6, 4) AS ssr FROM f""")
def l3_two_way_unbalanced(spark, sf_dir):
    """Both effects on all rows of the panel, of which some markets lack months: SQL sweeps a hundred times."""
    fit = panel_reg.fixed(table(spark, sf_dir), "price", XS, True, True)
    return rounded(fit.select("n_obs", F.element_at("coef", XS[0]).alias("b_a"), F.round(F.element_at("coef", XS[1]), 3).alias("b_b"), (F.col("ssr") / 1e6).alias("ssr")), 4)
