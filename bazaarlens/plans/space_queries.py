"""Queries of weights, spatial statistics and models, panels, diagnostics, scenarios, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bazaarlens.operators import custom, diagnostics, joins, ols, panel_reg, results, scenario, spatial_reg, spatial_stats, spatial_threshold, threshold, unitroot, weights
from bazaarlens.plans import analysis
from bazaarlens.plans.lineage import saved
from bazaarlens.plans.model_queries import flat, pairs, panel
from bazaarlens.plans.panel import MARKETS_SQL, PANEL_SQL, market_panel, markets, read
from bazaarlens.plans.registry import query, rounded
from bazaarlens.plans.regression_sql import ols_sql
from bazaarlens.sources import io

M = f"WITH {MARKETS_SQL}"
DIST = ", d AS (SELECT a.market AS src, b.market AS dst, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM markets a JOIN markets b ON a.market <> b.market)"
KNN = ", k AS (SELECT src, dst, d, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS r FROM d), e AS (SELECT src, dst, 1.0 / 4 AS w FROM k WHERE r <= 4)"
PANEL = f"WITH {PANEL_SQL}, {MARKETS_SQL}{DIST}{KNN}"
CROSS = PANEL + ", c AS (SELECT market, avg(price) AS v FROM panel GROUP BY 1), z AS (SELECT market, v, v - (SELECT avg(v) FROM c) AS z FROM c)"


def edges(spark, sf_dir):
    return saved(weights.row_normalize(weights.knn(markets(spark, sf_dir))))


def cross(spark, sf_dir):
    return saved(market_panel(spark, sf_dir).groupBy("market").agg(*[F.avg(c).alias(c) for c in ("price", "conflict_intensity", "rate_a", "rate_b")]))


# I: weights


@query(M + DIST + ", k AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS r FROM d) SELECT src, dst, CAST(1.0 AS DOUBLE) AS w FROM k WHERE r <= 4")
def i1_knn(spark, sf_dir):
    return weights.knn(markets(spark, sf_dir))


@query(M + DIST + " SELECT src, dst, round(1 / d, 6) AS w FROM d WHERE d <= 1.5")
def i2_distance_band(spark, sf_dir):
    return rounded(weights.distance_band(markets(spark, sf_dir), 1.5))


@query(M + " SELECT a.market AS src, b.market AS dst, CAST(1.0 AS DOUBLE) AS w FROM markets a JOIN markets b ON a.market <> b.market AND abs(a.x - b.x) + abs(a.y - b.y) = 1")
def i3_rook(spark, sf_dir):
    return weights.contiguity(squares(spark, sf_dir), "rook")


def squares(spark, sf_dir):
    """The unit square of each market's grid point."""
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    return markets(spark, sf_dir).select("market", F.array(corner(0.0, 0.0), corner(1.0, 0.0), corner(1.0, 1.0), corner(0.0, 1.0)).alias("ring"))


@query(M + " SELECT a.market AS src, b.market AS dst, CAST(1.0 AS DOUBLE) AS w FROM markets a JOIN markets b ON a.market <> b.market AND greatest(abs(a.x - b.x), abs(a.y - b.y)) = 1")
def i3_queen(spark, sf_dir):
    return weights.contiguity(squares(spark, sf_dir))


@query(M + DIST + " SELECT src, dst, round(1 - d / 2.5, 6) AS w FROM d WHERE d <= 2.5")
def i4_kernel(spark, sf_dir):
    return rounded(weights.kernel(markets(spark, sf_dir), 2.5, "triangular"))


@query(M + DIST + ", k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS r FROM d), h AS (SELECT *, max(d) OVER (PARTITION BY src) AS h FROM k WHERE r <= 4) SELECT src, dst, round(exp(-((d / h) ** 2) / 2) / sqrt(2 * pi()), 6) AS w FROM h")
def i4_kernel_adaptive(spark, sf_dir):
    return rounded(weights.kernel(markets(spark, sf_dir)))


C = f"WITH {PANEL_SQL}, {MARKETS_SQL}{DIST}, c AS (SELECT market, avg(conflict_intensity) AS c FROM panel GROUP BY 1)"


@query(C + ", w AS (SELECT src, dst, 1 / d * (1 - c) AS w FROM d JOIN c ON dst = market WHERE d <= 2.5) SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS w FROM w")
def i5_conflict_weights(spark, sf_dir):
    return rounded(weights.conflict(weights.band_pairs(markets(spark, sf_dir), 2.5), cross(spark, sf_dir)))


@query(C + " SELECT src, dst, round(1 - 0.5 * c, 6) AS w FROM d JOIN c ON dst = market WHERE d <= 1.0")
def i5_conflict_adjusted(spark, sf_dir):
    return rounded(weights.conflict_adjusted(weights.distance_band(markets(spark, sf_dir), 1.0), cross(spark, sf_dir)))


@query(M + DIST + " SELECT src, dst, round(1 / d / sum(1 / d) OVER (PARTITION BY src), 6) AS w FROM d WHERE d <= 1.5")
def i6_create(spark, sf_dir):
    return rounded(weights.create(markets(spark, sf_dir), "distance", threshold=1.5))


@query(M + DIST + KNN + " SELECT src, dst, round(CAST(w AS DOUBLE), 6) AS w FROM e")
def i7_row_normalize(spark, sf_dir):
    return rounded(edges(spark, sf_dir))


@query("WITH t AS (SELECT n_name AS s, r_name AS t, CAST(n_nationkey % 3 + 1 AS DOUBLE) AS w FROM nation JOIN region ON n_regionkey <> r_regionkey) SELECT s AS src, t AS dst, round(w / sum(w) OVER (PARTITION BY s), 6) AS w FROM t")
def i8_from_table(spark, sf_dir):
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    table = n.join(r, F.col("n_regionkey") != F.col("r_regionkey")).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"), (F.col("n_nationkey") % 3 + 1).alias("weight"))
    return rounded(weights.from_table(table))


@query(M + DIST + KNN + " SELECT src, count(*) AS n, min(dst) AS first_neighbour FROM e GROUP BY 1")
def i9_neighbours(spark, sf_dir):
    found = weights.neighbours(edges(spark, sf_dir))
    return found.select("src", F.size("neighbours").cast("long").alias("n"), F.array_min(F.map_keys("neighbours")).alias("first_neighbour"))


@query(M + DIST + KNN + " SELECT src, round(CAST(sum(CASE WHEN dst = 'NATION_0' THEN w ELSE 0 END) AS DOUBLE), 6) AS NATION_0, round(CAST(sum(CASE WHEN dst = 'NATION_1' THEN w ELSE 0 END) AS DOUBLE), 6) AS NATION_1 FROM e GROUP BY 1")
def i10_dense(spark, sf_dir):
    return rounded(weights.dense(edges(spark, sf_dir), ["NATION_0", "NATION_1"]))


@query(PANEL + " SELECT src AS market, date, round(sum(w * price), 6) AS lag_price FROM e JOIN panel ON dst = market GROUP BY 1, 2")
def i11_spatial_lag(spark, sf_dir):
    return rounded(weights.spatial_lag(edges(spark, sf_dir), market_panel(spark, sf_dir), "price", by=["date"]))


@query(CROSS + ", s AS (SELECT sum(w * a.z * b.z) AS c, sum(w) AS s0 FROM e JOIN z a ON src = a.market JOIN z b ON dst = b.market) SELECT count(*) AS n, round(any_value(count(*)) OVER () / any_value(s0) * any_value(c) / sum(z * z), 6) AS moran, round(-1.0 / (count(*) - 1), 6) AS expected FROM z, s".replace("any_value(count(*)) OVER ()", "count(*)"))
def i12_moran(spark, sf_dir):
    return rounded(spatial_stats.moran(edges(spark, sf_dir), cross(spark, sf_dir), "price"))


@query()
def i12_moran_permutations(spark, sf_dir):
    return rounded(spatial_stats.moran(edges(spark, sf_dir), panel(spark, sf_dir), "price", by=["date"], permutations=999))


@query(CROSS + ", s AS (SELECT sum(w * (a.v - b.v) ** 2) AS c, sum(w) AS s0 FROM e JOIN z a ON src = a.market JOIN z b ON dst = b.market) SELECT count(*) AS n, round((count(*) - 1) * any_value(c) / (2 * any_value(s0) * sum(z * z)), 6) AS geary FROM z, s")
def i13_geary(spark, sf_dir):
    return rounded(spatial_stats.geary(edges(spark, sf_dir), cross(spark, sf_dir), "price"))


@query(CROSS + ", l AS (SELECT src, sum(w * z) AS l FROM e JOIN z ON dst = market WHERE src IN (SELECT market FROM z) GROUP BY 1) SELECT market AS id, round(z * l * ((SELECT count(*) FROM z) - 1) / (SELECT sum(z * z) FROM z), 6) AS local_moran, CASE WHEN z > 0 AND l > 0 THEN 'HH' WHEN z <= 0 AND l > 0 THEN 'LH' WHEN z <= 0 THEN 'LL' ELSE 'HL' END AS quadrant FROM z JOIN l ON src = market")
def i14_local_moran(spark, sf_dir):
    return rounded(spatial_stats.local_moran(edges(spark, sf_dir), cross(spark, sf_dir), "price"))


@query()
def i14_local_moran_permutations(spark, sf_dir):
    return rounded(spatial_stats.local_moran(edges(spark, sf_dir), cross(spark, sf_dir), "price", permutations=999))


@query(CROSS + ", l AS (SELECT src, sum(w * v) AS l, sum(w) AS wi FROM e JOIN z ON dst = market GROUP BY 1) SELECT market AS id, round(l / ((SELECT sum(v) FROM z) - v), 6) AS g, round(wi / ((SELECT count(*) FROM z) - 1), 6) AS expected FROM z JOIN l ON src = market")
def i15_getis_ord(spark, sf_dir):
    return rounded(spatial_stats.getis_ord(edges(spark, sf_dir), cross(spark, sf_dir), "price").select("id", "g", "expected"))


@query(PANEL + """, z AS (SELECT market, date, price - avg(price) OVER (PARTITION BY date) AS z FROM panel), n AS (SELECT date, count(*) AS n, sum(z * z) AS zz FROM z GROUP BY 1),
  s AS (SELECT a.date, sum(w * a.z * b.z) AS c, sum(w) AS s0 FROM e JOIN z a ON src = a.market JOIN z b ON dst = b.market AND a.date = b.date GROUP BY 1), m AS (SELECT date, avg(conflict_intensity) AS m FROM panel GROUP BY 1)
  SELECT n.date, n, round(n / s0 * c / zz, 6) AS measure, round(m, 6) AS mean_conflict FROM n JOIN s ON n.date = s.date JOIN m ON n.date = m.date WHERE n >= 3""")
def i16_integration(spark, sf_dir):
    return rounded(spatial_stats.integration(edges(spark, sf_dir), panel(spark, sf_dir)))


@query(f"WITH {PANEL_SQL}, m AS (SELECT date, stddev_samp(price) / avg(price) AS cv, avg(conflict_intensity) AS c FROM panel GROUP BY 1) SELECT count(*) AS n_obs, round(regr_intercept(cv, c), 6) AS const, round(regr_slope(cv, c), 6) AS slope, round(regr_r2(cv, c), 6) AS r2 FROM m")
def i17_price_dispersion(spark, sf_dir):
    fit = spatial_stats.price_dispersion(market_panel(spark, sf_dir))
    return rounded(fit.select("n_obs", F.element_at("coef", "const").alias("const"), F.element_at("coef", "mean_conflict").alias("slope"), "r2"))


@query()
def i18_price_transmission(spark, sf_dir):
    return flat(spatial_stats.price_transmission(panel(spark, sf_dir), "NATION_1"))


@query()
def i19_dependence(spark, sf_dir):
    return rounded(spatial_reg.dependence(cross(spark, sf_dir), edges(spark, sf_dir), "price", ["conflict_intensity"]))


# J: spatial regression


@query(f"WITH {PANEL_SQL}, c AS (SELECT market, avg(price) AS p, avg(conflict_intensity) AS x FROM panel GROUP BY 1) SELECT count(*) AS n_obs, round(regr_slope(p, x), 4) AS slope, round(regr_intercept(p, x), 4) AS const, round(regr_r2(p, x), 6) AS r2 FROM c")
def j1_ols(spark, sf_dir):
    fit = spatial_reg.ols(cross(spark, sf_dir), "price", ["conflict_intensity"])
    return rounded(fit.select("n_obs", F.round(F.element_at("coef", "conflict_intensity"), 4).alias("slope"), F.round(F.element_at("coef", "const"), 4).alias("const"), "r2"))


@query()
def j2_lag_iv(spark, sf_dir):
    return flat(spatial_reg.lag_model(cross(spark, sf_dir), edges(spark, sf_dir), "price", ["conflict_intensity"]))


@query()
def j2_lag_ml(spark, sf_dir):
    return flat(spatial_reg.lag_model(cross(spark, sf_dir), edges(spark, sf_dir), "price", ["conflict_intensity"], method="ml"))


@query()
def j3_error_gm(spark, sf_dir):
    return flat(spatial_reg.error_model(cross(spark, sf_dir), edges(spark, sf_dir), "price", ["conflict_intensity"]))


@query()
def j3_error_ml(spark, sf_dir):
    return flat(spatial_reg.error_model(cross(spark, sf_dir), edges(spark, sf_dir), "price", ["conflict_intensity"], method="ml"))


@query()
def j4_predict(spark, sf_dir):
    c, e = cross(spark, sf_dir), edges(spark, sf_dir)
    return rounded(spatial_reg.predict(spatial_reg.lag_model(c, e, "price", ["conflict_intensity"]), c, ["conflict_intensity"], e, "price"), 4)


@query()
def j5_impacts(spark, sf_dir):
    c, e = cross(spark, sf_dir), edges(spark, sf_dir)
    return rounded(spatial_reg.impacts(spatial_reg.lag_model(c, e, "price", ["conflict_intensity"], method="ml"), e, c, ["conflict_intensity"]), 4)


@query()
def j6_estimate(spark, sf_dir):
    return flat(spatial_reg.estimate(cross(spark, sf_dir), edges(spark, sf_dir), "price", ["conflict_intensity"]))


@query()
def j7_full_analysis(spark, sf_dir):
    found = spatial_reg.full_analysis(panel(spark, sf_dir), markets(spark, sf_dir), "price", ["conflict_intensity"])
    return flat(found["lag"].unionByName(found["error"]))


# K: conflict thresholds

COSTS = PANEL + """, t AS (SELECT src, a.date, avg(abs(a.price - b.price)) * avg(1 + 0.5 * (a.conflict_intensity + b.conflict_intensity) / 2) AS cost FROM e JOIN panel a ON src = a.market JOIN panel b ON dst = b.market AND a.date = b.date GROUP BY 1, 2)"""


@query(COSTS + " SELECT src, date, round(cost, 6) AS cost FROM t")
def k1_transaction_costs(spark, sf_dir):
    p = market_panel(spark, sf_dir)
    prices, conflict = p.select("market", "date", "price"), p.select("market", "date", F.col("conflict_intensity").alias("conflict"))
    return rounded(spatial_threshold.transaction_costs(edges(spark, sf_dir), prices, conflict, unit="market", ts=["date"]))


@query(PANEL + " SELECT src, dst, a.date, round(a.price, 6) AS p_src, round(b.price, 6) AS p_dst, round(a.conflict_intensity, 6) AS c_src, round(b.conflict_intensity, 6) AS c_dst FROM e JOIN panel a ON src = a.market JOIN panel b ON dst = b.market AND a.date = b.date")
def d9_neighbour_prices(spark, sf_dir):
    p = market_panel(spark, sf_dir)
    prices, conflict = p.select("market", "date", "price"), p.select("market", "date", F.col("conflict_intensity").alias("conflict"))
    return rounded(joins.neighbour_prices(edges(spark, sf_dir), prices, conflict, "market", ["date"]))


@query()
def k2_neighbour_thresholds(spark, sf_dir):
    return rounded(spatial_threshold.estimate_with_conflict(edges(spark, sf_dir), panel(spark, sf_dir))["thresholds"], 4)


@query()
def k4_estimate_with_conflict(spark, sf_dir):
    return rounded(spatial_threshold.estimate_with_conflict(edges(spark, sf_dir), panel(spark, sf_dir))["patterns"], 4)


@query(f"WITH {PANEL_SQL}, c AS (SELECT market, avg(price) AS p, avg(conflict_intensity) AS x FROM panel GROUP BY 1) SELECT round(corr(x, p), 6) AS corr, round(regr_slope(p, x), 4) AS slope, round(regr_intercept(p, x), 4) AS intercept, count(*) AS n FROM c")
def k5_conflict_impact(spark, sf_dir):
    c = cross(spark, sf_dir)
    line = spatial_threshold.conflict_impact(c.select("market", "price"), c.select("market", "conflict_intensity"), "price", "market")["line"]
    return rounded(line.withColumns({k: F.round(k, 4) for k in ("slope", "intercept")}))


# L: panels


def table(spark, sf_dir):
    return saved(panel_reg.prepare(market_panel(spark, sf_dir), "price", ["conflict_intensity", "rate_a"]))


XS = ["conflict_intensity", "rate_a"]


def slopes(fit):
    return rounded(fit.select(F.col("n_obs"), F.element_at("coef", XS[0]).alias("b1"), F.element_at("coef", XS[1]).alias("b2")), 3)


def _two(y: str, a: str, b: str, source: str, const: bool = True) -> str:
    s = (lambda p, q: f"covar_pop({p}, {q})") if const else (lambda p, q: f"avg({p} * {q})")
    return f"""SELECT n AS n_obs, round((s22 * t1 - s12 * t2) / (s11 * s22 - s12 * s12), 3) AS b1, round((s11 * t2 - s12 * t1) / (s11 * s22 - s12 * s12), 3) AS b2
    FROM (SELECT count(*) AS n, {s(a, a)} AS s11, {s(b, b)} AS s22, {s(a, b)} AS s12, {s(a, y)} AS t1, {s(b, y)} AS t2 FROM {source})"""


L = f"WITH {PANEL_SQL}"


@query(f"WITH {PANEL_SQL}, m AS (SELECT avg(price) AS a, stddev_samp(price) AS b FROM panel) SELECT market AS entity, date AS time, round((price - a) / b, 6) AS price FROM panel, m")
def l1_prepare(spark, sf_dir):
    return rounded(panel_reg.prepare(market_panel(spark, sf_dir), "price", [], standardize=True))


@query(f"{L} " + _two("price", *XS, "panel"))
def l2_pooled(spark, sf_dir):
    return slopes(panel_reg.pooled(table(spark, sf_dir), "price", XS))


@query(f"{L}, w AS (SELECT price - avg(price) OVER m AS y, conflict_intensity - avg(conflict_intensity) OVER m AS a, rate_a - avg(rate_a) OVER m AS b FROM panel WINDOW m AS (PARTITION BY market)) " + _two("y", "a", "b", "w", False))
def l3_fixed(spark, sf_dir):
    return slopes(panel_reg.fixed(table(spark, sf_dir), "price", XS))


@query()
def l3_two_way(spark, sf_dir):
    return slopes(panel_reg.fixed(table(spark, sf_dir), "price", XS, True, True))


#: Swamy-Arora: variances of the within and the between fit, then least squares of quasi-demeaned rows.
RANDOM = f"""{L}, w AS (SELECT price - avg(price) OVER m AS y, conflict_intensity - avg(conflict_intensity) OVER m AS a, rate_a - avg(rate_a) OVER m AS b FROM panel WINDOW m AS (PARTITION BY market)),
 means AS (SELECT market, count(*) AS t, avg(price) AS y, avg(conflict_intensity) AS a, avg(rate_a) AS b FROM panel GROUP BY 1), {ols_sql('fw', 'w', [], 'y', ['a', 'b'], const=False)}, {ols_sql('fb', 'means', [], 'y', ['a', 'b'])},
 k AS (SELECT count(*) AS k, count(*) / sum(1.0 / t) AS h FROM means), v AS (SELECT fw.ssr / (fw.n - k - 2) AS s_e, greatest(0, fb.ssr / (k - 3) - fw.ssr / (fw.n - k - 2) / h) AS s_u FROM fw, fb, k),
 th AS (SELECT means.*, 1 - sqrt(s_e / (s_e + t * s_u)) AS theta FROM means, v),
 q AS (SELECT price - theta * y AS y, conflict_intensity - theta * a AS a, rate_a - theta * b AS b, 1 - theta AS one FROM panel JOIN th ON panel.market = th.market), {ols_sql('fr', 'q', [], 'y', ['one', 'a', 'b'], const=False)}"""


@query(f"{RANDOM} SELECT n AS n_obs, round(b_a, 3) AS b1, round(b_b, 3) AS b2 FROM fr")
def l4_random(spark, sf_dir):
    return slopes(panel_reg.random_effects(table(spark, sf_dir), "price", XS))


@query(f"{L}, w AS (SELECT avg(price) AS y, avg(conflict_intensity) AS a, avg(rate_a) AS b, 0 AS z FROM panel GROUP BY market) SELECT (SELECT count(*) FROM panel) AS n_obs, b1, b2 FROM (" + _two("y", "a", "b", "w") + ")")
def l5_between(spark, sf_dir):
    return slopes(panel_reg.between_effects(table(spark, sf_dir), "price", XS))


@query(f"{L}, w AS (SELECT price - lag(price) OVER m AS y, conflict_intensity - lag(conflict_intensity) OVER m AS a, rate_a - lag(rate_a) OVER m AS b FROM panel WINDOW m AS (PARTITION BY market ORDER BY date)), x AS (SELECT * FROM w WHERE y IS NOT NULL) SELECT (SELECT count(*) FROM panel) AS n_obs, b1, b2 FROM (" + _two("y", "a", "b", "x", False) + ")")
def l6_first_difference(spark, sf_dir):
    return slopes(panel_reg.first_difference(table(spark, sf_dir), "price", XS))


@query()
def l7_clustered(spark, sf_dir):
    fit = panel_reg.fixed(table(spark, sf_dir), "price", XS, cov_type="clustered")
    return rounded(fit.select("cov_type", F.element_at("se", XS[0]).alias("se1"), F.element_at("se", XS[1]).alias("se2")), 4)


@query(f"""{RANDOM}, d AS (SELECT fw.b_a - fr.b_a AS da, fw.b_b - fr.b_b AS db, fw.v_a_a * (fw.n - 2) / (fw.n - 2 - k) - fr.v_a_a AS vaa, fw.v_a_b * (fw.n - 2) / (fw.n - 2 - k) - fr.v_a_b AS vab, fw.v_b_b * (fw.n - 2) / (fw.n - 2 - k) - fr.v_b_b AS vbb FROM fw, fr, k),
 s AS (SELECT (vbb * da * da - 2 * vab * da * db + vaa * db * db) / (vaa * vbb - vab * vab) AS s FROM d)
 SELECT round(s, 4) AS statistic, CAST(2 AS INT) AS df, round(exp(-greatest(s, 0) / 2), 4) AS p, CASE WHEN exp(-greatest(s, 0) / 2) < 0.05 THEN 'fixed' ELSE 'random' END AS prefer FROM s""")
def l8_hausman(spark, sf_dir):
    return rounded(panel_reg.hausman(table(spark, sf_dir), "price", XS), 4)


F9 = f"""{L}, w AS (SELECT price - avg(price) OVER m AS y, conflict_intensity - avg(conflict_intensity) OVER m AS x, price, conflict_intensity AS c FROM panel WINDOW m AS (PARTITION BY market)),
 s AS (SELECT count(*) AS n, regr_syy(price, c) - regr_sxy(price, c) ** 2 / regr_sxx(price, c) AS s0, sum(y * y) - sum(x * y) ** 2 / sum(x * x) AS s1 FROM w), k AS (SELECT count(DISTINCT market) AS k FROM panel)"""


@query(F9 + " SELECT round((s0 - s1) / (k - 1) / (s1 / (n - k - 1)), 4) AS f, CAST(k - 1 AS INT) AS df1, CAST(n - k - 1 AS INT) AS df2 FROM s, k")
def l9_f_fixed_effects(spark, sf_dir):
    return rounded(panel_reg.f_fixed_effects(table(spark, sf_dir), "price", ["conflict_intensity"]).drop("p"), 4)


RES = f"{L}, f AS (SELECT regr_slope(price, conflict_intensity) AS b, regr_intercept(price, conflict_intensity) AS a FROM panel), r AS (SELECT market, date, price - a - b * conflict_intensity AS e FROM panel, f)"


@query(RES + ", g AS (SELECT market, sum(e) AS s, sum(e * e) AS q, count(*) AS t FROM r GROUP BY 1) SELECT round(sum(t) ** 2 / (2 * (sum(t * t) - sum(t))) * (sum(s * s) / sum(q) - 1) ** 2, 4) AS lm FROM g")
def l10_breusch_pagan_lm(spark, sf_dir):
    return rounded(panel_reg.breusch_pagan_lm(table(spark, sf_dir), "price", ["conflict_intensity"]).drop("p"), 4)


RHO = RES + ", c AS (SELECT corr(a.e, b.e) AS r, count(*) AS t FROM r a JOIN r b ON a.date = b.date AND a.market < b.market GROUP BY a.market, b.market)"


@query(RHO + " SELECT round(sum(sqrt(t) * r) / sqrt(count(*)), 4) AS statistic, count(*) AS n_pairs FROM c")
def l11_pesaran_cd(spark, sf_dir):
    return rounded(panel_reg.cross_section_dependence(table(spark, sf_dir), "price", ["conflict_intensity"]).drop("p"), 4)


@query(RHO + " SELECT round(sum(t * r * r), 4) AS statistic, count(*) AS n_pairs FROM c")
def l11_lm(spark, sf_dir):
    return rounded(panel_reg.cross_section_dependence(table(spark, sf_dir), "price", ["conflict_intensity"], "lm").drop("p"), 4)


@query(f"{L}, w AS (SELECT market, price - avg(price) OVER m AS y, conflict_intensity - avg(conflict_intensity) OVER m AS x FROM panel WINDOW m AS (PARTITION BY market)), b AS (SELECT sum(x * y) / sum(x * x) AS b FROM w) SELECT market AS entity, round(avg(price) - avg(conflict_intensity) * any_value(b), 4) AS effect FROM panel, b GROUP BY 1")
def l12_effects(spark, sf_dir):
    t = table(spark, sf_dir)
    return rounded(panel_reg.effects(t, panel_reg.fixed(t, "price", ["conflict_intensity"]), "price", ["conflict_intensity"]), 4)


# M: diagnostics


def residual_panel(spark, sf_dir):
    p = market_panel(spark, sf_dir)
    fits = ols.grouped_ols(p, ["market"], "price", ["conflict_intensity"])
    return saved(ols.with_residuals(p, fits, ["market"], "price", ["conflict_intensity"]))


R = f"WITH {PANEL_SQL}, f AS (SELECT market, regr_slope(price, conflict_intensity) AS b, regr_intercept(price, conflict_intensity) AS a FROM panel GROUP BY 1), r AS (SELECT p.market, date, conflict_intensity AS x, price - a - b * conflict_intensity AS e FROM panel p JOIN f ON p.market = f.market)"
KEYS, ORDER = ["market"], ["date"]


@query(R + " SELECT market, round(count(*) * regr_r2(e * e, x), 4) AS lm, round(regr_r2(e * e, x) / ((1 - regr_r2(e * e, x)) / (count(*) - 2)), 4) AS f FROM r GROUP BY 1")
def m1_breusch_pagan(spark, sf_dir):
    return rounded(diagnostics.breusch_pagan(residual_panel(spark, sf_dir), "residual", ["conflict_intensity"], KEYS).select("market", "lm", "f"), 4)


@query(R + """, s AS (SELECT market, count(*) AS n, covar_pop(x, x) AS s11, covar_pop(x * x, x * x) AS s22, covar_pop(x, x * x) AS s12, covar_pop(x, e * e) AS t1, covar_pop(x * x, e * e) AS t2, var_pop(e * e) AS tt FROM r GROUP BY 1)
  SELECT market, round(n * ((s22 * t1 - s12 * t2) * t1 + (s11 * t2 - s12 * t1) * t2) / (s11 * s22 - s12 * s12) / tt, 3) AS lm FROM s""")
def m2_white(spark, sf_dir):
    return rounded(diagnostics.white(residual_panel(spark, sf_dir), "residual", ["conflict_intensity"], KEYS).select("market", "lm"), 3)


@query(R + """, i AS (SELECT market, e, row_number() OVER (PARTITION BY market ORDER BY x, date) AS i, count(*) OVER (PARTITION BY market) AS n FROM r), h AS (SELECT *, floor((n - floor(n * 0.2)) / 2) AS h FROM i)
  SELECT market, round(var_pop(e) FILTER (WHERE i > n - h) / var_pop(e) FILTER (WHERE i <= h), 4) AS f FROM h GROUP BY 1""")
def m3_goldfeld_quandt(spark, sf_dir):
    return rounded(diagnostics.goldfeld_quandt(residual_panel(spark, sf_dir), "residual", "conflict_intensity", KEYS, ORDER).select("market", "f"), 4)


@query(R + """, l AS (SELECT market, e, lag(e) OVER w AS a, lag(e, 2) OVER w AS b FROM r WINDOW w AS (PARTITION BY market ORDER BY date)),
  s AS (SELECT market, count(*) AS n, covar_pop(a, a) AS s11, covar_pop(b, b) AS s22, covar_pop(a, b) AS s12, covar_pop(a, e) AS t1, covar_pop(b, e) AS t2, var_pop(e) AS tt FROM l WHERE b IS NOT NULL GROUP BY 1)
  SELECT market, round(n * ((s22 * t1 - s12 * t2) * t1 + (s11 * t2 - s12 * t1) * t2) / (s11 * s22 - s12 * s12) / tt, 4) AS lm FROM s""")
def m4_breusch_godfrey(spark, sf_dir):
    return rounded(diagnostics.breusch_godfrey(residual_panel(spark, sf_dir), "residual", KEYS, ORDER, 2).select("market", "lm"), 4)


@query(R + """, c AS (SELECT market, date, e - avg(e) OVER (PARTITION BY market) AS e, row_number() OVER (PARTITION BY market ORDER BY date) AS i FROM r), s AS (SELECT market, sum(e * e) AS s, count(*) AS n FROM c GROUP BY 1),
  a AS (SELECT a.market, b.i - a.i AS k, sum(a.e * b.e) AS p FROM c a JOIN c b ON a.market = b.market AND b.i - a.i BETWEEN 1 AND 10 GROUP BY 1, 2)
  SELECT a.market, CAST(k AS INT) AS lag, round(n * (n + 2) * sum((p / s) ** 2 / (n - k)) OVER (PARTITION BY a.market ORDER BY k), 4) AS q FROM a JOIN s ON a.market = s.market""")
def m5_ljung_box(spark, sf_dir):
    return rounded(diagnostics.ljung_box(residual_panel(spark, sf_dir), "residual", KEYS, ORDER).select("market", F.col("lag").cast("int").alias("lag"), "q"), 4)


@query(R + ", d AS (SELECT market, e, e - lag(e) OVER (PARTITION BY market ORDER BY date) AS d FROM r) SELECT market, round(sum(d * d) / sum(e * e), 6) AS dw, sum(d * d) / sum(e * e) < 1.5 OR sum(d * d) / sum(e * e) > 2.5 AS autocorrelated FROM d GROUP BY 1")
def m6_durbin_watson(spark, sf_dir):
    return rounded(diagnostics.durbin_watson(residual_panel(spark, sf_dir), "residual", KEYS, ORDER).drop("p"))


@query(R + """, m AS (SELECT market, avg(e) AS m FROM r GROUP BY 1), s AS (SELECT r.market, count(*) AS n, avg((e - m) ** 3) / avg((e - m) ** 2) ** 1.5 AS s, avg((e - m) ** 4) / avg((e - m) ** 2) ** 2 AS k FROM r JOIN m ON r.market = m.market GROUP BY 1)
  SELECT market, round(n / 6.0 * (s * s + (k - 3) ** 2 / 4), 4) AS jb, round(s, 4) AS skew, round(k, 4) AS kurtosis FROM s""")
def m7_jarque_bera(spark, sf_dir):
    return rounded(diagnostics.jarque_bera(residual_panel(spark, sf_dir), "residual", KEYS).select("market", "jb", "skew", "kurtosis"), 4)


@query()
def m8_shapiro_wilk(spark, sf_dir):
    return rounded(diagnostics.shapiro_wilk(residual_panel(spark, sf_dir), "residual", KEYS))


@query()
def m9_anderson_darling(spark, sf_dir):
    return rounded(diagnostics.anderson_darling(residual_panel(spark, sf_dir), "residual", KEYS))


@query()
def m10_kolmogorov_smirnov(spark, sf_dir):
    return rounded(diagnostics.kolmogorov_smirnov(residual_panel(spark, sf_dir), "residual", KEYS))


@query()
def m11_sensitivity(spark, sf_dir):
    rows = panel(spark, sf_dir)
    return rounded(diagnostics.sensitivity(lambda df, max_lags: unitroot.adf(df, KEYS, ORDER, max_lags=max_lags).select("market", "statistic", "n_lags"), rows, {"max_lags": [1, 2, 4]}), 4)


@query()
def m12_all_diagnostics(spark, sf_dir):
    return diagnostics.all_diagnostics(residual_panel(spark, sf_dir), "residual", ["conflict_intensity"], KEYS, ORDER)


# N: pipeline and scenarios


@query()
def n1_analysis(spark, sf_dir):
    found = analysis.run(market_panel(spark, sf_dir), modes=("standard",))
    return found["cointegration"].join(found["threshold_standard"].select("pair_id", F.round("threshold", 4).alias("threshold"), "status"), "pair_id")


@query(f"WITH {PANEL_SQL} SELECT market, date, round(price * (rate_a + rate_b) / 2 / rate_b, 6) AS price, round((rate_a + rate_b) / 2, 9) AS unified_rate FROM panel")
def n3_unify_rates(spark, sf_dir):
    out = scenario.unify_rates(market_panel(spark, sf_dir), target="average").select("market", "date", F.round("price", 6).alias("price"), "unified_rate")
    return rounded(out, 9)


@query()
def n3_unified_thresholds(spark, sf_dir):
    unified = joins.market_pairs(scenario.unify_rates(market_panel(spark, sf_dir))).select("pair_id", "ts", "y", "x")
    base, changed = (scenario.with_speed(threshold.fit_pairs(p, "standard")) for p in (pairs(spark, sf_dir), saved(unified)))
    return rounded(scenario.delta(base, changed, ["pair_id"], ["threshold", "speed"]), 4)


@query(M + DIST + ", s AS (SELECT src, dst, 1 / (d * 0.8) AS w FROM d WHERE d <= 2.5) SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS w FROM s")
def n4_reconnect(spark, sf_dir):
    return rounded(scenario.reconnect(weights.band_pairs(markets(spark, sf_dir), 2.5), 0.2))


@query()
def n4_connectivity(spark, sf_dir):
    d = weights.band_pairs(markets(spark, sf_dir), 2.5)
    base = weights.row_normalize(weights.distance_band(markets(spark, sf_dir), 1.0))
    changed = scenario.reconnect(d, 0.1, "contiguity", base=base.join(d, ["src", "dst"]).select("src", "dst"))
    return rounded(scenario.connectivity(cross(spark, sf_dir), base, changed, "price", ["conflict_intensity"]), 4)


@query(f"WITH {PANEL_SQL} SELECT market, round(max(price) - min(price), 6) AS spread FROM panel GROUP BY 1")
def n5_per_group(spark, sf_dir):
    import pandas as pd

    spread = lambda frame: pd.DataFrame({"market": [frame["market"].iloc[0]], "spread": [frame["price"].max() - frame["price"].min()]})
    return rounded(custom.per_group(market_panel(spark, sf_dir).select("market", "price"), ["market"], spread, "market string, spread double"))


# A: sources and sinks, through a folder of the session's shared store


def folder(spark) -> str:
    saved(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/io-{uuid.uuid4().hex}"


ROUND = f"WITH {PANEL_SQL}, {MARKETS_SQL}"


@query(ROUND + " SELECT market, x, y, 'Point' AS geometry FROM markets")
def a1_geojson(spark, sf_dir):
    path = f"{folder(spark)}/points.geojson"
    io.save(markets(spark, sf_dir), path)
    return io.read_geojson(spark, path, lines=True).select("market", "x", "y", "geometry")


@query(ROUND + " SELECT market, date, round(price, 6) AS price FROM panel")
def a2_csv(spark, sf_dir):
    path = f"{folder(spark)}/panel.csv"
    io.save(market_panel(spark, sf_dir).select("market", "date", "price"), path)
    return rounded(io.load(spark, path, schema="market string, date date, price double"))


@query(ROUND + " SELECT market, date, round(price, 6) AS price FROM panel")
def a3_json(spark, sf_dir):
    path = f"{folder(spark)}/panel.json"
    io.save(market_panel(spark, sf_dir).select("market", "date", "price"), path)
    return rounded(io.load(spark, path, schema="market string, date date, price double"))


@query(ROUND + " SELECT market, date, round(price, 6) AS price FROM panel")
def a5_by_market(spark, sf_dir):
    path = f"{folder(spark)}/by_market"
    io.save_by_market(market_panel(spark, sf_dir).select("market", "date", "price"), path)
    return rounded(io.load_by_market(spark, path).select("market", "date", "price"))


@query("SELECT n_nationkey AS k, n_name, s_name FROM nation FULL JOIN (SELECT s_nationkey AS k, min(s_name) AS s_name FROM supplier GROUP BY 1) s ON n_nationkey = k")
def a6_merge(spark, sf_dir):
    a = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    b = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_name").alias("s_name"))
    return io.merge([a, b], ["k"])


@query("SELECT 'orders.parquet' AS name UNION ALL SELECT 'region.parquet'")
def a7_files(spark, sf_dir):
    found = io.files(spark, sf_dir, "{orders,region}.parquet")
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))


@query(f"WITH {PANEL_SQL} SELECT date, round(avg(rate_a), 6) AS rate_a, round(avg(rate_b), 6) AS rate_b FROM panel GROUP BY 1")
def a8_rates(spark, sf_dir):
    path = f"{folder(spark)}/rates.parquet"
    io.save(market_panel(spark, sf_dir).groupBy("date").agg(F.avg("rate_a").alias("rate_a"), F.avg("rate_b").alias("rate_b")), path)
    return rounded(io.load_rates(spark, path))


@query(M + DIST + KNN + " SELECT src, dst, round(CAST(w AS DOUBLE), 6) AS w FROM e")
def a9_weights_store(spark, sf_dir):
    path = f"{folder(spark)}/weights"
    weights.save(edges(spark, sf_dir), path)
    return rounded(weights.load(spark, path))


@query()
def a10_results(spark, sf_dir):
    rows = panel(spark, sf_dir)
    found = {"adf": unitroot.adf(rows, KEYS, ORDER), "kpss": unitroot.kpss(rows, KEYS, ORDER)}
    path = f"{folder(spark)}/results"
    results.tidy(found, "market", verdict="is_stationary").write.parquet(path)
    return rounded(results.wide(spark.read.parquet(path), "market", ["adf", "kpss"]))


