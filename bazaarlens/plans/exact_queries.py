"""Models without p-values, each held against least squares in SQL; entries that the other modules only use inside."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.operators import coint, joins, panel_reg, spatial_reg, spatial_stats, spatial_threshold, threshold, unitroot, weights
from bazaarlens.plans import analysis
from bazaarlens.plans.lineage import saved
from bazaarlens.plans.model_queries import KEYS, ORDER, Z, P, PP, pairs, panel
from bazaarlens.plans.panel import PANEL_SQL, market_panel, markets
from bazaarlens.plans.registry import query, rounded
from bazaarlens.plans.regression_sql import ols_sql
from bazaarlens.plans.space_queries import CROSS, PANEL, cross, edges, folder
from bazaarlens.sources import io


def at(name: str, part: str = "coef"):
    return F.element_at(part, name)


# G: unit roots with one lag

ADF_ROWS = """s AS (SELECT market, date, price AS v, row_number() OVER w AS i, count(*) OVER (PARTITION BY market) AS n_series, lag(price) OVER w AS z FROM panel WINDOW w AS (PARTITION BY market ORDER BY date)),
 l AS (SELECT *, v - z AS d, lag(v - z) OVER (PARTITION BY market ORDER BY date) AS d1 FROM s)"""


@query(f"{P.rstrip()}, {ADF_ROWS}, r AS (SELECT * FROM l WHERE d1 IS NOT NULL), {ols_sql('f', 'r', ['market'], 'd', ['z', 'd1'])} SELECT market, n AS n_obs, round(b_z / se_z, 6) AS statistic FROM f")
def g1_adf_one_lag(spark, sf_dir):
    return rounded(unitroot.adf_statistics(market_panel(spark, sf_dir), KEYS, ORDER, "price", "c", 1, choose=False).select("market", "n_obs", "statistic"))


ZA = f"""{P.rstrip()}, {ADF_ROWS}, r AS (SELECT market, date, i, d, z, d1, CAST(i AS DOUBLE) AS t, b AS break_at, CASE WHEN i - 1 >= b THEN 1.0 ELSE 0.0 END AS du
 FROM l, unnest(range(CAST(floor(n_series * 0.15) AS BIGINT), CAST(n_series - floor(n_series * 0.15) AS BIGINT))) u(b) WHERE d1 IS NOT NULL),
 {ols_sql('f', 'r', ['market', 'break_at'], 'd', ['z', 't', 'd1', 'du'])}, best AS (SELECT market, b_z / se_z AS statistic, break_at, n, row_number() OVER (PARTITION BY market ORDER BY b_z / se_z, break_at) AS k FROM f)"""


@query(ZA + " SELECT best.market, n AS n_obs, round(statistic, 6) AS statistic, date AS break_date FROM best JOIN s ON best.market = s.market AND s.i - 1 = break_at WHERE k = 1")
def g4_break_statistic(spark, sf_dir):
    return rounded(unitroot.zivot_andrews(panel(spark, sf_dir), KEYS, ORDER).select("market", "n_obs", "statistic", "break_date"))


# H: pairs

LAGGED = ", ".join(f"lag(dz, {j}) OVER w AS d{j}" for j in range(1, 5))
#: dz, z1 and four lagged differences, complete; q is the last residual.
ROWS = f"{Z}, g AS (SELECT pair_id, ts, dz, z1, {LAGGED} FROM d WINDOW w AS (PARTITION BY pair_id ORDER BY ts)), r AS (SELECT *, z1 AS q FROM g WHERE d4 IS NOT NULL)"
LAGS = ["d1", "d2", "d3", "d4"]


@query(f"{ROWS}, {ols_sql('f', 'r', ['pair_id'], 'dz', ['z1', *LAGS], const=False)} SELECT pair_id, n AS n_used, round(b_z1 / se_z1, 6) AS statistic FROM f")
def h1_residual_statistic(spark, sf_dir):
    found = unitroot.adf_statistics(coint.residuals(pairs(spark, sf_dir)), ["pair_id"], ["ts"], "z", "n", 4, choose=False)
    return rounded(found.select("pair_id", F.col("n_obs").alias("n_used"), "statistic"))


@query(f"{Z}, r AS (SELECT pair_id, dy, dx, greatest(z1, 0.0) AS z_pos, least(z1, 0.0) AS z_neg FROM d WHERE dy IS NOT NULL), {ols_sql('f', 'r', ['pair_id'], 'dy', ['dx', 'z_pos', 'z_neg'])} SELECT pair_id, n AS n_obs, round(b_z_pos, 6) AS b_pos, round(b_z_neg, 6) AS b_neg, round(b_dx, 6) AS b_dx, round((b_z_pos - b_z_neg) ** 2 / (v_z_pos_z_pos + v_z_neg_z_neg - 2 * v_z_pos_z_neg), 6) AS f_asym FROM f")
def h6_asymmetric_f(spark, sf_dir):
    fits = coint.asymmetric_error_correction(pairs(spark, sf_dir))
    return rounded(fits.select("pair_id", "n_obs", at("z_pos").alias("b_pos"), at("z_neg").alias("b_neg"), at("dx").alias("b_dx"), "f_asym"))


#: One fit per candidate threshold: distinct values of q at sorted places in [15 %, 85 %).
TRIED = """o AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY q, ts) - 1 AS i, count(*) OVER (PARTITION BY pair_id) AS n_rows, lag(q) OVER (PARTITION BY pair_id ORDER BY q, ts) AS before FROM r),
 c AS (SELECT pair_id, q AS tau FROM o WHERE (before IS NULL OR before <> q) AND i >= floor(n_rows * 0.15) AND i < floor(n_rows * 0.85)),
 x AS (SELECT r.pair_id, tau, dz, CASE WHEN q >= tau THEN z1 ELSE 0 END AS up, CASE WHEN q >= tau THEN 0 ELSE z1 END AS down, d1, d2, d3, d4 FROM r JOIN c ON r.pair_id = c.pair_id),
 """
FITTED = ols_sql("f", "x", ["pair_id", "tau"], "dz", ["up", "down", *LAGS])
BEST = ", best AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY ssr, tau) AS k FROM f)"
SHOWN = " SELECT pair_id, n AS n_obs, round(tau, 4) AS threshold, round(b_up, 6) AS rho_above, round(b_down, 6) AS rho_below, round((b_up - b_down) ** 2 / (v_up_up + v_down_down - 2 * v_up_down), 4) AS f FROM best WHERE k = 1"


def shown(fits: DataFrame) -> DataFrame:
    return rounded(fits.where("status = 'ok'").select("pair_id", "n_obs", F.round("threshold", 4).alias("threshold"), "rho_above", "rho_below", F.round("f", 4).alias("f")))


@query(f"{ROWS}, {TRIED}{FITTED}{BEST}{SHOWN}")
def h8_tar_search(spark, sf_dir):
    return shown(threshold.fit_pairs(pairs(spark, sf_dir), "standard", n_grid=300))


@query(f"{ROWS}, {TRIED}{FITTED}{BEST}{SHOWN}")
def h10_adaptive(spark, sf_dir):
    return shown(threshold.fit_pairs(pairs(spark, sf_dir), "standard", method="adaptive"))


@query(f"{ROWS}, {TRIED}{FITTED}{BEST}, m AS (SELECT * FROM (VALUES ('adaptive'), ('grid'), ('hansen_seo')) t(method)) SELECT method, pair_id, round(tau, 4) AS threshold FROM best, m WHERE k = 1")
def h11_estimate_threshold(spark, sf_dir):
    """Each method of the dispatcher by its name."""
    z = saved(coint.residuals(pairs(spark, sf_dir)))
    parts = [threshold.fit(z, method=m).where("status = 'ok'").select(F.lit(m).alias("method"), "pair_id", F.round("threshold", 4).alias("threshold")) for m in threshold.METHODS]
    return rounded(reduce(DataFrame.unionAll, parts))


@query(f"{ROWS.replace('z1 AS q', 'd1 AS q')}, {TRIED}{FITTED}{BEST}{SHOWN}")
def h17_mtar_search(spark, sf_dir):
    return shown(threshold.fit_pairs(pairs(spark, sf_dir), "mtar"))


FIXED = f"{ROWS}, x AS (SELECT *, CASE WHEN q >= 0 THEN z1 ELSE 0 END AS up, CASE WHEN q >= 0 THEN 0 ELSE z1 END AS down FROM r), {ols_sql('f', 'x', ['pair_id'], 'dz', ['up', 'down', *LAGS])}"


@query(f"{FIXED} SELECT pair_id, round((b_up - b_down) ** 2 / (v_up_up + v_down_down - 2 * v_up_down), 4) AS wald, 1 AS df1, df AS df2 FROM f")
def h15_wald_fixed(spark, sf_dir):
    found = threshold.wald(threshold.fit_pairs(pairs(spark, sf_dir), "fixed"))
    return rounded(found.select("pair_id", "wald", "df1", "df2"), 4)


@query(f"{FIXED}, {ols_sql('p', 'r', ['pair_id'], 'dz', ['z1', *LAGS])} SELECT f.pair_id, round(f.n * ln(p.ssr / f.ssr), 5) AS lr FROM f JOIN p ON f.pair_id = p.pair_id")
def h16_lr_fixed(spark, sf_dir):
    z = saved(coint.residuals(pairs(spark, sf_dir)))
    return rounded(threshold.likelihood_ratio(z, threshold.fit(z, "fixed")).select("pair_id", "lr"), 5)


@query(f"{FIXED} SELECT pair_id, round((b_up - b_down) / sqrt(se_up ** 2 + se_down ** 2), 5) AS z, round(((b_up / se_up) ** 2 + (b_down / se_down) ** 2) / 2, 5) AS joint FROM f")
def h18_asymmetry_fixed(spark, sf_dir):
    return rounded(threshold.asymmetry(threshold.fit_pairs(pairs(spark, sf_dir), "fixed")).select("pair_id", "z", "joint"), 5)


GH_ROWS = f"""{PP}, s AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY pair_id) AS n_series FROM pairs),
 w AS (SELECT pair_id, ts, i, y, x, b AS break_at, CASE WHEN i >= b THEN 1.0 ELSE 0.0 END AS du FROM s, unnest(range(CAST(floor(n_series * 0.15) AS BIGINT), CAST(n_series - floor(n_series * 0.15) AS BIGINT))) u(b)),
 {ols_sql('f', 'w', ['pair_id', 'break_at'], 'y', ['du', 'x'])},
 e AS (SELECT w.pair_id, w.break_at, i, y - b_const - b_du * du - b_x * x AS z FROM w JOIN f ON w.pair_id = f.pair_id AND w.break_at = f.break_at),
 d AS (SELECT *, lag(z) OVER (PARTITION BY pair_id, break_at ORDER BY i) AS z1, z - lag(z) OVER (PARTITION BY pair_id, break_at ORDER BY i) AS dz FROM e),
 r AS (SELECT * FROM (SELECT *, lag(dz) OVER (PARTITION BY pair_id, break_at ORDER BY i) AS d1 FROM d) WHERE d1 IS NOT NULL),
 {ols_sql('a', 'r', ['pair_id', 'break_at'], 'dz', ['z1', 'd1'], const=False)}"""


@query(GH_ROWS + " SELECT pair_id, round(min(b_z1 / se_z1), 5) AS statistic FROM a GROUP BY 1")
def h3_gregory_hansen_statistic(spark, sf_dir):
    return rounded(coint.gregory_hansen(pairs(spark, sf_dir)).select("pair_id", "statistic"), 5)


def _granger_sql(lags: int) -> str:
    own, both = [f"y{j}" for j in range(1, lags + 1)], [f"{c}{j}" for c in "yx" for j in range(1, lags + 1)]
    made = ", ".join(f"lag({c}, {j}) OVER w AS {c}{j}" for c in "yx" for j in range(1, lags + 1))
    return f"""l{lags} AS (SELECT * FROM (SELECT pair_id, y, x, {made} FROM pairs WINDOW w AS (PARTITION BY pair_id ORDER BY ts)) WHERE y{lags} IS NOT NULL AND x{lags} IS NOT NULL),
 {ols_sql(f'n{lags}', f'l{lags}', ['pair_id'], 'y', own)}, {ols_sql(f'w{lags}', f'l{lags}', ['pair_id'], 'y', both)}"""


@query(f"{PP}, {', '.join(_granger_sql(p) for p in (1, 2, 3))} " + " UNION ALL ".join(f"SELECT n{p}.pair_id, {p} AS lag, round((n{p}.ssr - w{p}.ssr) / {p} / (w{p}.ssr / w{p}.df), 4) AS f FROM n{p} JOIN w{p} ON n{p}.pair_id = w{p}.pair_id" for p in (1, 2, 3)))
def h26_granger_f(spark, sf_dir):
    return rounded(coint.granger(pairs(spark, sf_dir), 3).select("pair_id", "lag", "f"), 4)


@query(f"{ROWS}, {TRIED}{FITTED}{BEST}, x0 AS (SELECT r.pair_id, dz, CASE WHEN q >= 0 THEN z1 ELSE 0 END AS up, CASE WHEN q >= 0 THEN 0 ELSE z1 END AS down, d1, d2, d3, d4 FROM r), {ols_sql('f0', 'x0', ['pair_id'], 'dz', ['up', 'down', *LAGS])} SELECT 'standard' AS mode, pair_id, n AS n_obs, round(tau, 4) AS threshold, round(b_up, 6) AS rho_above, round(b_down, 6) AS rho_below FROM best WHERE k = 1 UNION ALL SELECT 'fixed', pair_id, n, 0.0, round(b_up, 6), round(b_down, 6) FROM f0")
def h21_full_analysis(spark, sf_dir):
    """One table of the modes of the threshold model."""
    rows = pairs(spark, sf_dir)
    parts = [threshold.fit_pairs(rows, m).where("status = 'ok'").select(F.lit(m).alias("mode"), "pair_id", "n_obs", F.round("threshold", 4).alias("threshold"), "rho_above", "rho_below") for m in ("standard", "fixed")]
    return rounded(reduce(DataFrame.unionAll, parts))


@query(f"{ROWS}, {TRIED}{FITTED}{BEST} SELECT best.pair_id, round(v.a, 4) AS const, round(v.b, 6) AS slope, round(tau, 4) AS threshold, round(b_up, 6) AS rho_above, round(b_down, 6) AS rho_below FROM best JOIN v ON best.pair_id = v.pair_id WHERE k = 1")
def h24_threshold_cointegration(spark, sf_dir):
    """The cointegrating vector and the threshold adjustment of each pair."""
    rows = pairs(spark, sf_dir)
    fits = threshold.fit_pairs(rows).where("status = 'ok'").select("pair_id", F.round("threshold", 4).alias("threshold"), "rho_above", "rho_below")
    return rounded(coint.cointegrating_vectors(rows).select("pair_id", F.round("const", 4).alias("const"), "slope").join(fits, "pair_id"))


@query(f"{ROWS}, {ols_sql('f', 'r', ['pair_id'], 'dz', ['z1', *LAGS], const=False)}, t AS (SELECT pair_id FROM f WHERE b_z1 / se_z1 < -3.4), m AS (SELECT n_name AS market, CAST(n_nationkey % 5 AS DOUBLE) AS mx, floor(n_nationkey / 5) AS my FROM nation) SELECT p.pair_id, market_y, market_x, a.mx AS x_from, a.my AS y_from, b.mx AS x_to, b.my AS y_to FROM (SELECT DISTINCT pair_id, market_y, market_x FROM pairs) p JOIN t ON p.pair_id = t.pair_id JOIN m a ON a.market = market_y JOIN m b ON b.market = market_x")
def h27_network_by_statistic(spark, sf_dir):
    """The network of the pairs whose residual statistic is under -3.4."""
    found = coint.engle_granger(pairs(spark, sf_dir)).withColumn("is_cointegrated", F.col("statistic") < -3.4)
    return coint.integration_network(found, markets(spark, sf_dir)).select("pair_id", "market_y", "market_x", "x_from", "y_from", "x_to", "y_to")


# I, J, K: space


@query(f"WITH {PANEL_SQL}, r AS (SELECT a.market, a.price AS p, b.price AS p_ref, a.conflict_intensity AS c, b.price * a.conflict_intensity AS pc FROM panel a JOIN panel b ON a.date = b.date AND b.market = 'NATION_1' WHERE a.market <> 'NATION_1'), {ols_sql('f', 'r', ['market'], 'p', ['p_ref', 'c', 'pc'])} SELECT market, n AS n_obs, round(b_p_ref, 5) AS b_ref, round(b_pc, 5) AS b_both, round(b_p_ref / se_p_ref, 4) AS t_ref FROM f WHERE n >= 10")
def i18_transmission_lines(spark, sf_dir):
    found = spatial_stats.price_transmission(panel(spark, sf_dir), "NATION_1")
    return rounded(found.select("market", "n_obs", at("p_ref").alias("b_ref"), at("p_ref_conflict").alias("b_both"), F.round(at("p_ref", "t"), 4).alias("t_ref")), 5)


#: Price and conflict of each market and their spatial lags.
SPATIAL = f"""{PANEL}, c AS (SELECT market, avg(price) AS p, avg(conflict_intensity) AS x FROM panel GROUP BY 1),
 l AS (SELECT src AS market, sum(w * c.p) AS wp, sum(w * c.x) AS wx FROM e JOIN c ON dst = c.market WHERE src IN (SELECT market FROM c) GROUP BY 1),
 l2 AS (SELECT src AS market, sum(w * l.wx) AS wwx FROM e JOIN l ON dst = l.market GROUP BY 1),
 r AS (SELECT c.market, p, x, coalesce(wp, 0) AS wp, coalesce(wx, 0) AS wx, coalesce(wwx, 0) AS wwx FROM c LEFT JOIN l ON c.market = l.market LEFT JOIN l2 ON c.market = l2.market)"""
DEPENDENCE = f"""{SPATIAL}, {ols_sql('f', 'r', [], 'p', ['x'])}, u AS (SELECT r.*, p - b_const - b_x * x AS e, b_const + b_x * x AS fit FROM r, f),
 v AS (SELECT src AS market, sum(w * u.e) AS we, sum(w * u.fit) AS wfit FROM e JOIN u ON dst = u.market GROUP BY 1),
 q AS (SELECT u.*, we, wfit FROM u JOIN v ON u.market = v.market), {ols_sql('j', 'q', [], 'wfit', ['x'])},
 t AS (SELECT sum(a.w * a.w) + coalesce((SELECT sum(a.w * b.w) FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src), 0) AS t FROM e a),
 sums AS (SELECT t, sum(e * e) / count(*) AS s2, sum(e * we) / (sum(e * e) / count(*)) AS ew, sum(e * wp) / (sum(e * e) / count(*)) AS el FROM q, t GROUP BY t),
 stats AS (SELECT sums.*, t + j.ssr / s2 AS nj FROM sums, j)"""


@query(DEPENDENCE + """ SELECT 'lm_error' AS test, round(ew ** 2 / t, 5) AS statistic FROM stats UNION ALL SELECT 'lm_lag', round(el ** 2 / nj, 5) FROM stats
 UNION ALL SELECT 'robust_lm_error', round((ew - t / nj * el) ** 2 / (t * (1 - t / nj)), 5) FROM stats UNION ALL SELECT 'robust_lm_lag', round((el - ew) ** 2 / (nj - t), 5) FROM stats""")
def i19_lm_statistics(spark, sf_dir):
    found = spatial_reg.dependence(cross(spark, sf_dir), edges(spark, sf_dir), "price", ["conflict_intensity"])
    return rounded(found.where("test != 'moran_residuals'").select("test", "statistic"), 5)


@query(f"WITH {PANEL_SQL}, m AS (SELECT n_name AS market, CAST(n_nationkey % 5 AS DOUBLE) AS x, floor(n_nationkey / 5) AS y FROM nation), c AS (SELECT market, avg(conflict_intensity) AS c FROM panel GROUP BY 1), d AS (SELECT a.market AS src, b.market AS dst, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM m a JOIN m b ON a.market <> b.market), w AS (SELECT src, dst, 1 / d * (1 - c) AS w FROM d JOIN c ON dst = market WHERE d <= 3.0) SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS w FROM w")
def i20_conflict_weights(spark, sf_dir):
    return rounded(weights.conflict(weights.band_pairs(markets(spark, sf_dir), 3.0), cross(spark, sf_dir)))


#: Two stages: the lag of price on x, Wx and WWx, then price on x and the fitted lag.
LAG_IV = f"{SPATIAL}, {ols_sql('s', 'r', [], 'wp', ['x', 'wx', 'wwx'])}, h AS (SELECT r.*, b_const + b_x * x + b_wx * wx + b_wwx * wwx AS fitted FROM r, s), {ols_sql('b', 'h', [], 'p', ['x', 'fitted'])}"


@query(LAG_IV + " SELECT n AS n_obs, round(b_fitted, 5) AS rho, round(b_x, 2) AS b_x, round(b_const, 2) AS b_const FROM b")
def j2_lag_two_stages(spark, sf_dir):
    fit = spatial_reg.lag_model(cross(spark, sf_dir), edges(spark, sf_dir), "price", ["conflict_intensity"])
    return rounded(fit.select("n_obs", F.round("spatial", 5).alias("rho"), at("conflict_intensity").alias("b_x"), at("const").alias("b_const")).withColumns({c: F.round(c, 2) for c in ("b_x", "b_const")}), 5)


def _thresholds_sql(last: str) -> str:
    lags = ["d1", "d2"]
    made = ", ".join(f"lag(dz, {j}) OVER w AS d{j}" for j in (1, 2))
    return f"""{PANEL}, t AS (SELECT src, a.date, avg(abs(a.price - b.price)) * avg(1 + 0.5 * (a.conflict_intensity + b.conflict_intensity) / 2) AS cost FROM e JOIN panel a ON src = a.market JOIN panel b ON dst = b.market AND a.date = b.date GROUP BY src, a.date),
 costs AS (SELECT src, avg(cost) AS tau FROM t GROUP BY 1), p AS (SELECT src, dst, a.date AS ts, a.price AS y, b.price AS x FROM e JOIN panel a ON src = a.market JOIN panel b ON dst = b.market AND a.date = b.date),
 v AS (SELECT src, dst, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM p GROUP BY 1, 2), z AS (SELECT p.src, p.dst, ts, y - a - b * x AS z FROM p JOIN v ON p.src = v.src AND p.dst = v.dst),
 g AS (SELECT src, dst, ts, lag(z) OVER w AS z1, z - lag(z) OVER w AS dz FROM z WINDOW w AS (PARTITION BY src, dst ORDER BY ts)), h AS (SELECT *, {made} FROM g WINDOW w AS (PARTITION BY src, dst ORDER BY ts)),
 r AS (SELECT h.src, dst, dz, d1, d2, CASE WHEN z1 >= tau THEN z1 ELSE 0 END AS up, CASE WHEN z1 >= tau THEN 0 ELSE z1 END AS down FROM h JOIN costs ON h.src = costs.src WHERE d2 IS NOT NULL),
 {ols_sql('f', 'r', ['src', 'dst'], 'dz', ['up', 'down', *lags])}, fits AS (SELECT f.src, dst, tau, b_down FROM f JOIN costs ON f.src = costs.src WHERE isfinite(b_down)),
 rates AS (SELECT src, count(*) AS n, avg(CASE WHEN b_down < -0.1 THEN 1.0 ELSE 0.0 END) AS integration_rate, avg(abs(b_down)) AS mean_speed FROM fits GROUP BY 1){last}"""


@query(_thresholds_sql(" SELECT src, dst, round(tau, 4) AS threshold, round(b_down, 5) AS rho_below, b_down < -0.1 AS integrated FROM fits"))
def k2_threshold_fits(spark, sf_dir):
    found = spatial_threshold.estimate_with_conflict(edges(spark, sf_dir), panel(spark, sf_dir))["thresholds"]
    return rounded(found.select("src", "dst", F.round("threshold", 4).alias("threshold"), "rho_below", "integrated"), 5)


@query(_thresholds_sql(", m AS (SELECT avg(mean_speed) AS a, stddev_samp(mean_speed) AS s FROM rates) SELECT src, n, round(mean_speed, 5) AS mean_speed, CASE WHEN mean_speed > a + s THEN 'high' WHEN mean_speed < a - s THEN 'low' ELSE 'medium' END AS cluster FROM rates, m"))
def k3_patterns(spark, sf_dir):
    rates = spatial_threshold.estimate_with_conflict(edges(spark, sf_dir), panel(spark, sf_dir))["rates"]
    return rounded(spatial_threshold.patterns(rates, "mean_speed").select("src", "n", "mean_speed", "cluster"), 5)


# L: two ways, by two sweeps of dummies' means on a panel that need not be balanced: here months that all markets have

WHOLE = f"WITH {PANEL_SQL}, full_months AS (SELECT date FROM panel GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT market) FROM panel)), q AS (SELECT market, date, price AS y, conflict_intensity AS a, rate_a AS b FROM panel WHERE date IN (SELECT date FROM full_months))"
TWO_WAY = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY market) - avg({c}) OVER (PARTITION BY date) + avg({c}) OVER () AS {c}" for c in ("y", "a", "b"))


@query(f"{WHOLE}, r AS (SELECT {TWO_WAY} FROM q), {ols_sql('f', 'r', [], 'y', ['a', 'b'], const=False)} SELECT n AS n_obs, round(b_a, 3) AS b_a, round(b_b, 2) AS b_b FROM f")
def l3_two_way_line(spark, sf_dir):
    rows = market_panel(spark, sf_dir)
    months = rows.groupBy("date").agg(F.count("*").alias("m")).join(F.broadcast(rows.agg(F.count_distinct("market").alias("m"))), "m").select("date")
    table = saved(panel_reg.prepare(rows.join(months, "date", "left_semi"), "price", ["conflict_intensity", "rate_a"]))
    fit = panel_reg.fixed(table, "price", ["conflict_intensity", "rate_a"], True, True)
    return rounded(fit.select("n_obs", F.round(at("conflict_intensity"), 3).alias("b_a"), F.round(at("rate_a"), 2).alias("b_b")))


# A, D, N: entries


@query(f"WITH {PANEL_SQL} SELECT market, count(*) AS n, round(sum(price), 4) AS total FROM panel GROUP BY 1")
def a4_save_by_market(spark, sf_dir):
    """What the market folders hold, by the folder's name."""
    path = f"{folder(spark)}/processed"
    io.save_by_market(market_panel(spark, sf_dir).select("market", "date", "price"), path, kind="parquet")
    return rounded(spark.read.parquet(path).withColumn("market", F.col("market").cast("string")).groupBy("market").agg(F.count("*").alias("n"), F.sum("price").alias("total")), 4)


@query(f"WITH {PANEL_SQL} SELECT 'market=' || market AS folder, count(*) AS n FROM panel GROUP BY 1")
def a7_market_files(spark, sf_dir):
    """A listing of what is stored, and the rows of each folder by the files it found."""
    path = f"{folder(spark)}/listed"
    io.save_by_market(market_panel(spark, sf_dir).select("market", "date", "price"), path, kind="parquet")
    listed = io.files(spark, path, "*.parquet", recursive=True).select(F.regexp_extract("path", r"(market=[^/]+)/[^/]+$", 1).alias("folder")).distinct()
    rows = spark.read.parquet(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"(market=[^/]+)/[^/]+$", 1).alias("folder"))
    return listed.join(rows.groupBy("folder").agg(F.count("*").alias("n")), "folder")


@query("SELECT event_id, round(value, 6) AS value, event_type AS commodity FROM events WHERE event_type IS NOT NULL")
def d8_all_commodities(spark, sf_dir):
    """Every event type is a commodity's table; every second one has a column more."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = [r[0] for r in e.where("event_type is not null").select("event_type").distinct().orderBy("event_type").collect()]  # a handful of types
    return rounded(joins.combine_commodities({k: e.where(F.col("event_type") == k).select("event_id", "value", *(["ts"] if i % 2 else [])) for i, k in enumerate(kinds)}))


@query()
def d3_price_pair(spark, sf_dir):
    rows = panel(spark, sf_dir)
    return rounded(joins.prepare_price_pair(rows, "NATION_0", "NATION_1"))


@query(f"WITH {PANEL_SQL} SELECT a.date, round(a.price, 6) AS y, round(b.price, 6) AS x FROM panel a JOIN panel b ON a.date = b.date WHERE a.market = 'NATION_0' AND b.market = 'NATION_1'")
def d3_raw_pair(spark, sf_dir):
    return rounded(joins.prepare_price_pair(market_panel(spark, sf_dir), "NATION_0", "NATION_1", clean=False))


@query(f"{ROWS}, {TRIED}{FITTED}{BEST} SELECT pair_id, round(tau, 4) AS threshold FROM best WHERE k = 1")
def n2_fan_out(spark, sf_dir):
    """The analysis of every pair in one job."""
    found = analysis.run(market_panel(spark, sf_dir), modes=("standard",))["threshold_standard"]
    return rounded(found.where("status = 'ok'").select("pair_id", F.round("threshold", 4).alias("threshold")))


@query(LAG_IV + " SELECT market, round(b_const + b_x * x + b_fitted * wp, 2) AS predicted FROM r, b")
def j4_predicted_prices(spark, sf_dir):
    c, e = cross(spark, sf_dir), edges(spark, sf_dir)
    return rounded(spatial_reg.predict(spatial_reg.lag_model(c, e, "price", ["conflict_intensity"]), c, ["conflict_intensity"], e, "price"), 2)
