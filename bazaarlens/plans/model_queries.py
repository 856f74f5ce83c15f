"""Queries of unit roots, cointegration, error correction and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlens.operators import coint, joins, threshold, unitroot
from bazaarlens.plans.lineage import saved
from bazaarlens.plans.panel import PAIRS_SQL, PANEL_SQL, market_panel, markets
from bazaarlens.plans.registry import query, rounded

P = f"WITH {PANEL_SQL} "
PP = f"WITH {PANEL_SQL}, {PAIRS_SQL}"
KEYS, ORDER = ["market"], ["date"]
FLAT = ["crit", "coef", "se", "t", "p", "cov"]


def pairs(spark, sf_dir):
    """All market pairs, once computed for the several passes of a model."""
    return saved(joins.market_pairs(market_panel(spark, sf_dir)).select("pair_id", "ts", "y", "x"))


def panel(spark, sf_dir):
    return saved(market_panel(spark, sf_dir))


def flat(df, digits=4):
    """Without maps, whose order isn't part of a result."""
    kinds = dict(df.dtypes)
    return rounded(df.select(*[c for c in df.columns if not kinds[c].startswith(("map", "array"))]), digits)


# Choice of transformations


@query()
def f6_make_stationary(spark, sf_dir):
    return rounded(unitroot.make_stationary(panel(spark, sf_dir), KEYS, ORDER))


@query()
def f7_verdicts(spark, sf_dir):
    return rounded(unitroot.verdicts(panel(spark, sf_dir), KEYS, ORDER))


@query()
def f8_recommend(spark, sf_dir):
    return rounded(unitroot.recommend(panel(spark, sf_dir), KEYS, ORDER))


@query()
def f8_apply_recommended(spark, sf_dir):
    rows = panel(spark, sf_dir)
    return rounded(unitroot.apply_recommended(rows, unitroot.recommend(rows, KEYS, ORDER), KEYS, ORDER))


# G: unit roots


@query()
def g1_adf(spark, sf_dir):
    return flat(unitroot.adf(panel(spark, sf_dir), KEYS, ORDER))


PP_SQL = P + """, r AS (SELECT market, date, row_number() OVER w AS i, count(*) OVER (PARTITION BY market) AS n, price AS x, lag(price) OVER w AS z FROM panel WINDOW w AS (PARTITION BY market ORDER BY date)),
 f AS (SELECT market, regr_slope(x, z) AS b, regr_intercept(x, z) AS a, regr_sxx(x, z) AS sxx, count(z) AS m, any_value(n) AS n FROM r WHERE z IS NOT NULL GROUP BY 1),
 e AS (SELECT r.market, date, x - a - b * z AS e, row_number() OVER (PARTITION BY r.market ORDER BY date) AS k FROM r JOIN f ON r.market = f.market WHERE z IS NOT NULL),
 s AS (SELECT market, sum(e * e) AS s0 FROM e GROUP BY 1),
 c AS (SELECT p.market, q.k - p.k AS j, sum(p.e * q.e) AS s FROM e p JOIN e q ON p.market = q.market AND q.k > p.k GROUP BY 1, 2),
 v AS (SELECT f.market, m, b, s0 / m AS g0, sqrt(s0 / (m - 2)) AS sg, sqrt(s0 / (m - 2) / sxx) AS se, ceil(12 * pow((n - 1) / 100.0, 0.25)) AS l FROM f JOIN s ON f.market = s.market),
 w AS (SELECT v.market, (any_value(g0) * any_value(m) + sum(CASE WHEN j <= l THEN 2 * (1 - j / (l + 1)) * s ELSE 0 END)) / any_value(m) AS lrv FROM v JOIN c ON v.market = c.market GROUP BY 1)
 SELECT v.market, round(sqrt(g0 / lrv) * (b - 1) / se - 0.5 * (lrv - g0) / sqrt(lrv) * m * se / sg, 4) AS statistic FROM v JOIN w ON v.market = w.market"""


@query(PP_SQL)
def g2_phillips_perron(spark, sf_dir):
    return rounded(unitroot.phillips_perron(panel(spark, sf_dir), KEYS, ORDER).select("market", "statistic"), 4)


KPSS_SQL = P + """, e AS (SELECT market, date, price - avg(price) OVER (PARTITION BY market) AS e, row_number() OVER w AS i, count(*) OVER (PARTITION BY market) AS n FROM panel WINDOW w AS (PARTITION BY market ORDER BY date)),
 t AS (SELECT market, i, n, e, sum(e) OVER (PARTITION BY market ORDER BY i) AS s FROM e), q AS (SELECT market, sum(s * s) AS ss, sum(e * e) AS s0, any_value(n) AS n FROM t GROUP BY 1),
 c AS (SELECT a.market, b.i - a.i AS j, sum(a.e * b.e) AS s FROM e a JOIN e b ON a.market = b.market AND b.i - a.i BETWEEN 1 AND 4 GROUP BY 1, 2),
 l AS (SELECT q.market, any_value(ss) AS ss, any_value(n) AS n, (any_value(s0) + sum(CASE WHEN j <= least(floor(12 * pow(n / 100.0, 0.25)), 4) THEN 2 * (1 - j / (least(floor(12 * pow(n / 100.0, 0.25)), 4) + 1)) * s ELSE 0 END)) / any_value(n) AS v FROM q JOIN c ON q.market = c.market GROUP BY 1)
 SELECT market, round(ss / (n * n) / v, 6) AS statistic, ss / (n * n) / v <= 0.463 AS is_stationary FROM l"""


@query(KPSS_SQL)
def g3_kpss(spark, sf_dir):
    return rounded(unitroot.kpss(panel(spark, sf_dir), KEYS, ORDER).select("market", "statistic", "is_stationary"))


@query()
def g4_zivot_andrews(spark, sf_dir):
    return flat(unitroot.zivot_andrews(panel(spark, sf_dir), KEYS, ORDER))


@query()
def g5_dfgls(spark, sf_dir):
    return flat(unitroot.dfgls(panel(spark, sf_dir), KEYS, ORDER))


@query()
def g6_all_tests(spark, sf_dir):
    return flat(unitroot.all_tests(panel(spark, sf_dir), KEYS, ORDER))


@query()
def g7_order_of_integration(spark, sf_dir):
    return unitroot.order_of_integration(panel(spark, sf_dir), KEYS, ORDER)


@query()
def g8_residual_stationarity(spark, sf_dir):
    return flat(unitroot.adf(coint.residuals(pairs(spark, sf_dir)), ["pair_id"], ["ts"], "z", "c", 10))


# H: cointegration and error correction


@query(PP + " SELECT pair_id, round(regr_intercept(y, x), 4) AS const, round(regr_slope(y, x), 6) AS slope, regr_count(y, x) AS n_obs, round(regr_r2(y, x), 6) AS r2 FROM pairs GROUP BY 1")
def h1_pair_vectors(spark, sf_dir):
    return rounded(coint.panel_vectors(market_panel(spark, sf_dir)).withColumn("const", F.round("const", 4)))


@query()
def h1_engle_granger(spark, sf_dir):
    return flat(coint.engle_granger(pairs(spark, sf_dir)))


@query()
def h2_johansen(spark, sf_dir):
    found = coint.johansen(pairs(spark, sf_dir))
    return rounded(found.select("pair_id", F.col("trace")[0].alias("trace_0"), F.col("trace")[1].alias("trace_1"), F.col("max_eigen")[0].alias("max_eigen_0"), "rank", "is_cointegrated", "n_obs", "status"), 4)


@query()
def h3_gregory_hansen(spark, sf_dir):
    return flat(coint.gregory_hansen(pairs(spark, sf_dir)))


@query()
def h4_all_tests(spark, sf_dir):
    return coint.all_tests(pairs(spark, sf_dir))


Z = PP + """, v AS (SELECT pair_id, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM pairs GROUP BY 1), z AS (SELECT p.pair_id, ts, y, x, y - a - b * x AS z FROM pairs p JOIN v ON p.pair_id = v.pair_id),
 d AS (SELECT pair_id, ts, y - lag(y) OVER w AS dy, x - lag(x) OVER w AS dx, lag(z) OVER w AS z1, z - lag(z) OVER w AS dz FROM z WINDOW w AS (PARTITION BY pair_id ORDER BY ts))"""


@query(Z + """, s AS (SELECT pair_id, count(*) AS n, covar_pop(dx, dx) AS s11, covar_pop(z1, z1) AS s22, covar_pop(dx, z1) AS s12, covar_pop(dx, dy) AS t1, covar_pop(z1, dy) AS t2, covar_pop(dy, dy) AS tt FROM d WHERE dy IS NOT NULL GROUP BY 1),
 c AS (SELECT *, (s22 * t1 - s12 * t2) / (s11 * s22 - s12 * s12) AS b1, (s11 * t2 - s12 * t1) / (s11 * s22 - s12 * s12) AS b2 FROM s)
 SELECT pair_id, n AS n_obs, round(b1, 6) AS b_dx, round(b2, 6) AS b_z, round((b1 * t1 + b2 * t2) / tt, 6) AS r2, round(b2 / sqrt((tt - b1 * t1 - b2 * t2) * n / (n - 3) / n * s11 / (s11 * s22 - s12 * s12)), 4) AS t_z FROM c""")
def h5_error_correction(spark, sf_dir):
    fits = coint.error_correction(pairs(spark, sf_dir))
    return rounded(fits.select("pair_id", "n_obs", F.element_at("coef", "dx").alias("b_dx"), F.element_at("coef", "z").alias("b_z"), "r2", F.round(F.element_at("t", "z"), 4).alias("t_z")))


@query()
def h6_asymmetric_ecm(spark, sf_dir):
    return flat(coint.asymmetric_error_correction(pairs(spark, sf_dir)))


@query(Z + """, i AS (SELECT pair_id, dz, CASE WHEN z1 >= 0 THEN z1 ELSE 0 END AS u, CASE WHEN z1 >= 0 THEN 0 ELSE z1 END AS w FROM d WHERE dz IS NOT NULL),
 s AS (SELECT pair_id, count(*) AS n, covar_pop(u, u) AS s11, covar_pop(w, w) AS s22, covar_pop(u, w) AS s12, covar_pop(u, dz) AS t1, covar_pop(w, dz) AS t2, covar_pop(dz, dz) AS tt FROM i GROUP BY 1),
 c AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * t1 - s12 * t2) / (s11 * s22 - s12 * s12) AS b1, (s11 * t2 - s12 * t1) / (s11 * s22 - s12 * s12) AS b2 FROM s)
 SELECT pair_id, n AS n_obs, round(b1, 6) AS rho_above, round(b2, 6) AS rho_below, round((b1 - b2) ** 2 / ((tt - b1 * t1 - b2 * t2) * n / (n - 3) / n * (s22 + s11 + 2 * s12) / det), 4) AS f FROM c""")
def h7_tar_fixed(spark, sf_dir):
    fits = threshold.fit_pairs(pairs(spark, sf_dir), "fixed", max_lags=0)
    return rounded(fits.select("pair_id", "n_obs", "rho_above", "rho_below", F.round("f", 4).alias("f")))


@query()
def h8_tar(spark, sf_dir):
    return flat(threshold.fit_pairs(pairs(spark, sf_dir), "standard", n_grid=300))


@query()
def h9_tar_hansen_seo(spark, sf_dir):
    return flat(threshold.fit_pairs(pairs(spark, sf_dir), "standard", method="hansen_seo"))


@query()
def h12_bootstrap(spark, sf_dir):
    z = saved(coint.residuals(pairs(spark, sf_dir)))
    return flat(threshold.bootstrap(z, saved(threshold.fit(z)), 1000))


@query()
def h13_bootstrap_wild(spark, sf_dir):
    z = saved(coint.residuals(pairs(spark, sf_dir)))
    return flat(threshold.bootstrap(z, saved(threshold.fit(z)), 1000, kind="wild", base="threshold"))


@query()
def h14_sup_lm(spark, sf_dir):
    return flat(threshold.sup_lm(saved(coint.residuals(pairs(spark, sf_dir))), 1000))


@query()
def h15_wald(spark, sf_dir):
    return flat(threshold.wald(threshold.fit_pairs(pairs(spark, sf_dir))).select("pair_id", "wald", "df1", "df2", "p_wald"))


@query()
def h16_likelihood_ratio(spark, sf_dir):
    z = saved(coint.residuals(pairs(spark, sf_dir)))
    return flat(threshold.likelihood_ratio(z, threshold.fit(z)))


@query()
def h17_mtar(spark, sf_dir):
    return flat(threshold.fit_pairs(pairs(spark, sf_dir), "mtar"))


@query()
def h18_asymmetry(spark, sf_dir):
    return flat(threshold.asymmetry(saved(threshold.fit_pairs(pairs(spark, sf_dir), "mtar")), n_boot=1000))


@query()
def h19_tvecm(spark, sf_dir):
    return flat(threshold.tvecm(pairs(spark, sf_dir)))


@query()
def h20_tvecm_bootstrap(spark, sf_dir):
    return flat(threshold.tvecm_bootstrap(pairs(spark, sf_dir), 1000))


@query()
def h22_compare(spark, sf_dir):
    return flat(threshold.compare(pairs(spark, sf_dir)))


@query()
def h23_with_breaks(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    dates = rows.select("pair_id").distinct().withColumn("break_date", F.lit("1998-06-01").cast("date"))
    return flat(threshold.with_breaks(rows, dates))


@query(Z + ", t AS (SELECT * FROM d WHERE z1 IS NOT NULL) SELECT t.pair_id, t.ts, round(z.z, 4) AS z, round(z1, 4) AS q, CASE WHEN z1 >= 0 THEN 'above' ELSE 'below' END AS regime FROM t JOIN z ON t.pair_id = z.pair_id AND t.ts = z.ts")
def h25_regime_table(spark, sf_dir):
    z = saved(coint.residuals(pairs(spark, sf_dir)))
    return rounded(threshold.regime_table(z, threshold.fit(z, "fixed", max_lags=0), max_lags=0), 4)


@query()
def h26_granger(spark, sf_dir):
    return flat(coint.granger(pairs(spark, sf_dir)))


@query()
def h27_network(spark, sf_dir):
    return coint.integration_network(coint.engle_granger(pairs(spark, sf_dir)), markets(spark, sf_dir))


