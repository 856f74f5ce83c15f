"""Queries of the operators on tables: sources, projections, cleaning, joins, aggregates, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlens.operators import clean, describe, features, joins, project
from bazaarlens.plans.panel import COMMODITY_SQL, MARKETS_SQL, PAIRS_SQL, PANEL_SQL, market_panel, markets, read
from bazaarlens.plans.registry import query, rounded

P = f"WITH {PANEL_SQL} "
PP = f"WITH {PANEL_SQL}, {PAIRS_SQL} "
KEYS, ORDER = ["market"], ["date"]
EK, EO = ["user_id"], ["ts", "event_id"]


def events(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")


def gappy(spark, sf_dir):
    """Events with every third value missing."""
    return events(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))


GAPPY = "g AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events)"


# B: filters and projections


@query(f"WITH {COMMODITY_SQL} SELECT market, date, round(price, 6) AS price FROM goods WHERE commodity = 'Brand#12'")
def b1_filter_commodity(spark, sf_dir):
    return rounded(project.filter_commodity(market_panel(spark, sf_dir, "p_brand"), "Brand#12").select("market", "date", "price"))


@query(P + "SELECT market, date, round(price, 6) AS price FROM panel WHERE market IN ('FRANCE', 'NATION_3', 'NATION_7', 'CHINA')")
def b2_filter_markets(spark, sf_dir):
    return rounded(project.filter_markets(market_panel(spark, sf_dir), ["FRANCE", "NATION_3", "NATION_7", "CHINA"]).select("market", "date", "price"))


@query("SELECT v AS market FROM (VALUES ('NOWHERE'), ('ELSEWHERE')) t(v) UNION SELECT 'FRANCE' WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'FRANCE')")
def b2_missing_markets(spark, sf_dir):
    return project.missing_markets(market_panel(spark, sf_dir), ["NOWHERE", "FRANCE", "ELSEWHERE"])


@query("SELECT c_mktsegment AS admin1, c_mktsegment AS market, c_custkey FROM customer")
def b3_market_fallback(spark, sf_dir):
    return project.ensure_market(read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("admin1"), "c_custkey"))


@query(P + "SELECT market, date, round(price, 6) AS price FROM panel WHERE date BETWEEN DATE '1995-01-01' AND DATE '1996-06-01'")
def b4_period(spark, sf_dir):
    return rounded(project.filter_period(market_panel(spark, sf_dir), "1995-01-01", "1996-06-01").select("market", "date", "price"))


@query(f"WITH {GAPPY} SELECT event_id, round(value, 6) AS value FROM g WHERE value IS NOT NULL")
def b5_complete_cases(spark, sf_dir):
    return rounded(project.complete_cases(gappy(spark, sf_dir), ["value"]).select("event_id", "value"))


@query(P + "SELECT date, round(price, 6) AS price_y FROM panel")
def b6_series_frame(spark, sf_dir):
    return rounded(project.series_frame(market_panel(spark, sf_dir), "price", "price_y"))


@query(P + "SELECT market, date, round(price / rate_a, 6) AS price_adjusted FROM panel")
def b7_rate_adjusted(spark, sf_dir):
    return rounded(project.rate_adjusted(market_panel(spark, sf_dir), rate="rate_a").select("market", "date", "price_adjusted"))


@query(P + "SELECT market, date, round(price * (1 + conflict_intensity), 6) AS price_conflict_adj FROM panel")
def b8_conflict_adjusted(spark, sf_dir):
    return rounded(project.conflict_adjusted(market_panel(spark, sf_dir)).select("market", "date", "price_conflict_adj"))


@query("SELECT l_orderkey, l_linenumber, round(l_tax * l_discount, 6) AS l_tax_mul_l_discount, round(l_tax / nullif(l_discount, 0), 6) AS l_tax_div_l_discount, round(l_tax + l_discount, 6) AS l_tax_add_l_discount, round(l_tax - l_discount, 6) + 0.0 AS l_tax_sub_l_discount FROM lineitem")
def b9_interactions(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount")
    return rounded(project.interactions(items, [("l_tax", "l_discount")], ["mul", "div", "add", "sub"]).drop("l_tax", "l_discount"))


@query("""SELECT DISTINCT d AS date, CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month, CAST(day(d) AS INT) AS day, CAST(isodow(d) - 1 AS INT) AS day_of_week, CAST(quarter(d) AS INT) AS quarter,
  CAST(day(d) = 1 AS INT) AS is_month_start, CAST(d = last_day(d) AS INT) AS is_month_end, CAST(d = date_trunc('quarter', d) AS INT) AS is_quarter_start,
  CAST(month(d + INTERVAL 1 DAY) IN (1, 4, 7, 10) AND day(d + INTERVAL 1 DAY) = 1 AS INT) AS is_quarter_end, CAST(dayofyear(d) = 1 AS INT) AS is_year_start, CAST(month(d) = 12 AND day(d) = 31 AS INT) AS is_year_end
  FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem)""")
def b10_time_features(spark, sf_dir):
    return project.time_features(read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct())


@query("SELECT c_custkey, CAST(c_mktsegment = s2.v AS INT) AS hit FROM customer, (SELECT c_mktsegment AS v FROM customer GROUP BY 1 ORDER BY 1 LIMIT 1 OFFSET 1) s2")
def b11_one_hot(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    coded = project.one_hot(customers, "c_mktsegment")
    return coded.select("c_custkey", F.col(f"`{coded.columns[1]}`").alias("hit"))


@query("SELECT c_custkey, c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS c_mktsegment_code FROM customer")
def b12_label_encode(spark, sf_dir):
    return project.label_encode(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.01 THEN '***' WHEN l_discount < 0.05 THEN '**' WHEN l_discount < 0.1 THEN '*' ELSE '' END AS stars FROM lineitem")
def b13_stars(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", project.stars(F.col("l_discount")).alias("stars"))


@query(P + """, m AS (SELECT market, avg(price) AS a FROM panel GROUP BY 1), c AS (
  SELECT market, avg((price - a) ** 3) / avg((price - a) ** 2) ** 1.5 AS s, avg((price - a) ** 4) / avg((price - a) ** 2) ** 2 - 3 AS k FROM panel JOIN m USING (market) GROUP BY 1)
  SELECT market, concat(CASE WHEN abs(s) < 0.5 THEN 'approximately symmetric' WHEN s >= 0.5 AND s < 1 THEN 'moderately right-skewed' WHEN s >= 1 THEN 'highly right-skewed' WHEN s <= -0.5 AND s > -1 THEN 'moderately left-skewed' ELSE 'highly left-skewed' END, ', ',
   CASE WHEN abs(k) < 0.5 THEN 'normal tails' WHEN k >= 0.5 AND k < 1 THEN 'slightly heavy tails' WHEN k >= 1 THEN 'heavy tails' WHEN k <= -0.5 AND k > -1 THEN 'slightly light tails' ELSE 'light tails' END) AS label FROM c""")
def b14_shape_label(spark, sf_dir):
    shape = market_panel(spark, sf_dir).groupBy("market").agg(F.skewness("price").alias("s"), F.kurtosis("price").alias("k"))
    return shape.select("market", project.shape_label(F.col("s"), F.col("k")).alias("label"))


# C: cleaning


@query(f"""WITH {GAPPY}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM g), k AS (
  SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i0, last_value(value IGNORE NULLS) OVER a AS v0,
   first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i1, first_value(value IGNORE NULLS) OVER b AS v1 FROM i
  WINDOW a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT event_id, round(CASE WHEN value IS NOT NULL THEN value WHEN v1 IS NULL THEN v0 WHEN v0 IS NULL THEN NULL ELSE v0 + (v1 - v0) * (i - i0) / (i1 - i0) END, 6) AS value FROM k""")
def c1_interpolate(spark, sf_dir):
    return rounded(clean.interpolate(gappy(spark, sf_dir), "value", EK, EO).select("event_id", "value"))


@query(f"WITH {GAPPY} SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM g)), 6) AS value FROM g")
def c2_fill_median(spark, sf_dir):
    return rounded(clean.fill_median(gappy(spark, sf_dir), ["value"]).select("event_id", "value"))


@query("""WITH g AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_type END AS event_type FROM events)
  SELECT event_id, coalesce(event_type, (SELECT event_type FROM g WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS event_type FROM g""")
def c3_fill_mode(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("event_type"))
    return clean.fill_mode(rows, ["event_type"])


@query(P + """, h AS (SELECT market, date, CASE WHEN month(date) <> 3 THEN price END AS price, CASE WHEN month(date) <> 5 THEN rate_a END AS rate_a FROM panel),
  i AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY date) AS i FROM h), k AS (
  SELECT *, last_value(CASE WHEN price IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i0, last_value(price IGNORE NULLS) OVER a AS v0,
   first_value(CASE WHEN price IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i1, first_value(price IGNORE NULLS) OVER b AS v1 FROM i
  WINDOW a AS (PARTITION BY market ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY market ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT market, date, round(CASE WHEN price IS NOT NULL THEN price WHEN v1 IS NULL THEN v0 WHEN v0 IS NULL THEN NULL ELSE v0 + (v1 - v0) * (i - i0) / (i1 - i0) END, 5) AS price,
   round(coalesce(rate_a, (SELECT quantile_cont(rate_a, 0.5) FROM h)), 9) AS rate_a FROM k""")
def c4_preprocess(spark, sf_dir):
    panel = market_panel(spark, sf_dir).select("market", "date", F.when(F.month("date") != 3, F.col("price")).alias("price"), F.when(F.month("date") != 5, F.col("rate_a")).alias("rate_a"))
    return rounded(clean.preprocess(panel).withColumn("price", F.round("price", 5)), 9)


@query("SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE abs(l_extendedprice - m) / s > 2) AS n_out FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem) GROUP BY 1")
def c5_outliers_zscore(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    flagged = clean.outlier_flags(items, "l_extendedprice", "zscore", 2.0)
    return flagged.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if("is_outlier").alias("n_out"))


@query("""WITH q AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem GROUP BY 1)
  SELECT l_suppkey, count(*) FILTER (WHERE l_extendedprice < a - 0.6 * (b - a) OR l_extendedprice > b + 0.6 * (b - a)) AS n_out FROM lineitem JOIN q USING (l_suppkey) GROUP BY 1""")
def c5_outliers_iqr(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice")
    return clean.outlier_flags(items, "l_extendedprice", "iqr", 0.6, ["l_suppkey"]).groupBy("l_suppkey").agg(F.count_if("is_outlier").alias("n_out"))


@query("""WITH q AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.5) AS m FROM lineitem GROUP BY 1), d AS (SELECT l_suppkey, abs(l_extendedprice - m) AS d FROM lineitem JOIN q USING (l_suppkey)),
  s AS (SELECT l_suppkey, quantile_cont(d, 0.5) AS s FROM d GROUP BY 1) SELECT l_suppkey, count(*) FILTER (WHERE 0.6745 * d / s > 1.5) AS n_out FROM d JOIN s USING (l_suppkey) GROUP BY 1""")
def c5_outliers_modified(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice")
    return clean.outlier_flags(items, "l_extendedprice", "modified_zscore", 1.5, ["l_suppkey"]).groupBy("l_suppkey").agg(F.count_if("is_outlier").alias("n_out"))


@query("""WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS s, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM events)
  SELECT event_id, round(CASE WHEN abs(value - m) / s > 1.5 THEN greatest(least(value, b), a) ELSE value END, 6) AS value FROM events, s""")
def c6_winsorize(spark, sf_dir):
    return rounded(clean.handle_outliers(events(spark, sf_dir), "value", "winsorize", "zscore", 1.5).select("event_id", "value"))


@query("""WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events), o AS (SELECT event_id, value, abs(value - m) / s > 1.5 AS o FROM events, s)
  SELECT event_id, round(CASE WHEN o THEN (SELECT avg(value) FROM o WHERE NOT o) ELSE value END, 6) AS value FROM o""")
def c6_mean(spark, sf_dir):
    return rounded(clean.handle_outliers(events(spark, sf_dir), "value", "mean", "zscore", 1.5).select("event_id", "value"))


@query("WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) SELECT event_id, round(CASE WHEN NOT abs(value - m) / s > 1.5 THEN value END, 6) AS value FROM events, s")
def c6_trim(spark, sf_dir):
    return rounded(clean.handle_outliers(events(spark, sf_dir), "value", "trim", "zscore", 1.5).select("event_id", "value"))


@query(P + """, g AS (SELECT market, count(DISTINCT gap) AS n FROM (SELECT market, date - lag(date) OVER (PARTITION BY market ORDER BY date) AS gap FROM panel) GROUP BY 1)
  SELECT "check", severity, CAST(n_bad AS BIGINT) AS n_bad FROM (
  SELECT 'empty_table' AS "check", 'error' AS severity, (SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM panel) AS n_bad
  UNION ALL SELECT 'null_market', 'warning', (SELECT count(*) FROM panel WHERE market IS NULL) UNION ALL SELECT 'null_date', 'warning', (SELECT count(*) FROM panel WHERE date IS NULL)
  UNION ALL SELECT 'null_price', 'warning', (SELECT count(*) FROM panel WHERE price IS NULL) UNION ALL SELECT 'negative_price', 'warning', (SELECT count(*) FROM panel WHERE price < 0)
  UNION ALL SELECT 'missing_commodity', 'warning', 1 UNION ALL SELECT 'missing_geometry', 'warning', 1
  UNION ALL SELECT 'duplicate_dates', 'warning', 0 UNION ALL SELECT 'irregular_spacing', 'warning', (SELECT count(*) FROM g WHERE n > 1))""")
def c7_quality_report(spark, sf_dir):
    return clean.quality_report(market_panel(spark, sf_dir).select("market", "date", "price"))


C8 = P + """, s AS (SELECT market, avg(price) AS m, stddev_pop(price) AS s FROM panel GROUP BY 1), o AS (SELECT p.market, date, price, abs(price - m) / s > 1.5 AS o,
  CASE WHEN NOT abs(price - m) / s > 1.5 THEN price END AS v, row_number() OVER (PARTITION BY p.market ORDER BY date) AS i FROM panel p JOIN s USING (market))"""


@query(C8 + ", q AS (SELECT market, quantile_cont(v, 0.5) AS q FROM o GROUP BY 1) SELECT market, date, round(CASE WHEN o THEN q ELSE price END, 6) AS price FROM o JOIN q USING (market)")
def c8_replace_median(spark, sf_dir):
    return rounded(clean.replace_outliers(market_panel(spark, sf_dir).select("market", "date", "price"), "price", "median", threshold=1.5))


@query(C8 + """, k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i0, last_value(v IGNORE NULLS) OVER a AS v0, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i1, first_value(v IGNORE NULLS) OVER b AS v1 FROM o
  WINDOW a AS (PARTITION BY market ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY market ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT market, date, round(CASE WHEN NOT o THEN price WHEN v1 IS NULL OR i - i0 <= i1 - i THEN v0 ELSE v1 END, 6) AS price FROM k""")
def c8_replace_nearest(spark, sf_dir):
    return rounded(clean.replace_outliers(market_panel(spark, sf_dir).select("market", "date", "price"), "price", "nearest", threshold=1.5))


def _c9_sql() -> str:
    # the series have 81 to 83 rows, so the frame is 20 rows wide: 10 before, 9 after
    w = lambda a, b: f"(PARTITION BY market ORDER BY date ROWS BETWEEN {a} AND {b})"
    frame, down, up = w("10 PRECEDING", "9 FOLLOWING"), w("CURRENT ROW", "UNBOUNDED FOLLOWING"), w("UNBOUNDED PRECEDING", "CURRENT ROW")
    return P + f""", a AS (SELECT *, CASE WHEN count(price) OVER {frame} >= 3 THEN quantile_cont(price, 0.5) OVER {frame} END AS m0 FROM panel),
    b AS (SELECT *, coalesce(first_value(m0 IGNORE NULLS) OVER {down}, last_value(m0 IGNORE NULLS) OVER {up}) AS m FROM a), c AS (SELECT *, abs(price - m) AS d FROM b),
    e AS (SELECT *, CASE WHEN count(d) OVER {frame} >= 3 THEN quantile_cont(d, 0.5) OVER {frame} END AS s0 FROM c), f AS (SELECT *, coalesce(first_value(s0 IGNORE NULLS) OVER {down}, last_value(s0 IGNORE NULLS) OVER {up}) AS s FROM e)
    SELECT market, date, 0.6745 * d / (s + 1e-8) > 1.5 * (1 + conflict_intensity) AS is_outlier FROM f"""


@query(_c9_sql())
def c9_conflict_outliers(spark, sf_dir):
    return clean.conflict_outliers(market_panel(spark, sf_dir), threshold=1.5).select("market", "date", "is_outlier")


def _lowess_sql(points: str, key: str, value: str, rounds: int = 3) -> str:
    """CTEs up to ``f{rounds}`` (key, i, fit): every point joined with its neighbours, once for each round."""
    fit = lambda t: f"""f{t} AS (SELECT {key}, i, CASE WHEN s * sxx - sx * sx > 1e-12 THEN (sxx * sy - sx * sxy) / (s * sxx - sx * sx) ELSE sy / nullif(s, 0) END AS fit FROM (
      SELECT p.{key}, p.i, sum(w * r) AS s, sum(w * r * x) AS sx, sum(w * r * x * x) AS sxx, sum(w * r * y) AS sy, sum(w * r * x * y) AS sxy
      FROM near p JOIN r{t} v ON p.{key} = v.{key} AND p.j = v.i GROUP BY 1, 2))"""  # noqa: E731
    weigh = lambda t: f"""e{t} AS (SELECT v.{key}, v.i, v.y, abs(v.y - f.fit) AS e FROM r{t} v JOIN f{t} f ON v.{key} = f.{key} AND v.i = f.i),
    r{t + 1} AS (SELECT {key}, i, y, CASE WHEN six = 0 THEN 1.0 WHEN e < six THEN (1 - (e / six) * (e / six)) * (1 - (e / six) * (e / six)) ELSE 0.0 END AS r
      FROM (SELECT *, 6 * quantile_cont(e, 0.5) OVER (PARTITION BY {key}) AS six FROM e{t}))"""  # noqa: E731
    steps = [f"""n AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n FROM {points} WHERE {value} IS NOT NULL),
    k AS (SELECT *, CAST(least(greatest(ceil(n * 0.2), 2), n) AS BIGINT) AS k FROM n),
    a AS (SELECT *, greatest(0, least(i - (k - 1) // 2, n - k)) AS a FROM k),
    near AS (SELECT a.{key}, a.i, b.i AS j, b.i - a.i AS x, pow(1 - pow(abs(b.i - a.i) / greatest(a.i - a.a, a.a + a.k - 1 - a.i, 1), 3), 3) AS w
      FROM a JOIN a b ON a.{key} = b.{key} AND b.i BETWEEN a.a AND a.a + a.k - 1),
    r0 AS (SELECT {key}, i, {value} AS y, 1.0 AS r FROM a)"""]  # fmt: skip
    for t in range(rounds + 1):
        steps += [fit(t)] + ([weigh(t)] if t < rounds else [])
    return ", ".join(steps)


@query(P + ", " + _lowess_sql("panel", "market", "price") + """,
  o AS (SELECT a.market, a.date, f.fit AS trend, a.price - f.fit AS e FROM a JOIN f3 f ON a.market = f.market AND a.i = f.i),
  d AS (SELECT *, abs(e - quantile_cont(e, 0.5) OVER (PARTITION BY market)) AS d FROM o)
  SELECT market, date, round(trend, 6) AS trend, coalesce(0.6745 * d / nullif(quantile_cont(d, 0.5) OVER (PARTITION BY market), 0) > 2.0, false) AS is_outlier FROM d""")
def c10_trend_outliers(spark, sf_dir):
    return rounded(clean.trend_outliers(market_panel(spark, sf_dir), threshold=2.0).select("market", "date", "trend", "is_outlier"))


@query("SELECT event_id, round((value - (SELECT min(value) FROM events)) / ((SELECT max(value) FROM events) - (SELECT min(value) FROM events)), 6) AS value FROM events")
def c11_minmax(spark, sf_dir):
    return rounded(clean.minmax(events(spark, sf_dir), "value").select("event_id", "value"))


@query(P + ", q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.5) AS m, quantile_cont(price, 0.75) AS b FROM panel) SELECT market, date, round((price - m) / CASE WHEN b > a THEN b - a ELSE 1 END, 6) AS z FROM panel, q")
def c12_robust(spark, sf_dir):
    return rounded(clean.conflict_transform(market_panel(spark, sf_dir), "price", "robust_scaling", name="z").select("market", "date", "z"))


@query(P + """, s AS (SELECT *, CASE WHEN conflict_intensity <= 0.3 THEN 'low' WHEN conflict_intensity <= 0.7 THEN 'medium' ELSE 'high' END AS band FROM panel),
  q AS (SELECT band, quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.5) AS m, quantile_cont(price, 0.75) AS b FROM s GROUP BY 1)
  SELECT market, date, round((price - m) / CASE WHEN b > a THEN b - a ELSE 1 END, 6) AS z FROM s JOIN q USING (band)""")
def c12_segmented(spark, sf_dir):
    return rounded(clean.conflict_transform(market_panel(spark, sf_dir), "price", "segmented_scaling", name="z").select("market", "date", "z"))


@query(P + """, r AS (SELECT price AS x, row_number() OVER (ORDER BY price) - 1 AS k FROM panel), n AS (SELECT count(*) AS n FROM panel),
  l AS (SELECT market, date, price, (0.01 + 0.04 * conflict_intensity) * (n - 1) AS a, (1 - (0.01 + 0.04 * conflict_intensity)) * (n - 1) AS b FROM panel, n),
  w AS (SELECT market, date, greatest(least(price, r3.x + (r4.x - r3.x) * (b - floor(b))), r1.x + (r2.x - r1.x) * (a - floor(a))) AS w
   FROM l JOIN r r1 ON r1.k = floor(a) JOIN r r2 ON r2.k = ceil(a) JOIN r r3 ON r3.k = floor(b) JOIN r r4 ON r4.k = ceil(b))
  SELECT market, date, round((w - (SELECT avg(w) FROM w)) / (SELECT stddev_samp(w) FROM w), 6) AS z FROM w""")
def c12_winsorized(spark, sf_dir):
    return rounded(clean.conflict_transform(market_panel(spark, sf_dir), "price", "winsorized_scaling", name="z").select("market", "date", "z"))


@query(P + "SELECT market, date, round(ln(price + CASE WHEN (SELECT min(price) FROM panel) <= 0 THEN abs((SELECT min(price) FROM panel)) + 1 ELSE 1 END), 6) AS z FROM panel")
def c12_log(spark, sf_dir):
    return rounded(clean.conflict_transform(market_panel(spark, sf_dir), "price", "log_transform", name="z").select("market", "date", "z"))


@query()
def c13_profile(spark, sf_dir):
    return clean.profile_columns(read(spark, sf_dir, "lineitem"))


_FITS = "CASE WHEN lo >= -128 AND hi <= 127 THEN 'tinyint' WHEN lo >= -32768 AND hi <= 32767 THEN 'smallint' WHEN lo >= -2147483648 AND hi <= 2147483647 THEN 'int' ELSE 'bigint' END"


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS n, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, {f"(SELECT {_FITS} FROM (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem))" if whole else "'float'"} AS suggested FROM lineitem""" for c, whole in (("l_orderkey", True), ("l_partkey", True), ("l_suppkey", True), ("l_linenumber", True), ("l_quantity", False), ("l_extendedprice", False), ("l_discount", False), ("l_tax", False))))
def c13_numbers(spark, sf_dir):
    """What the profile says of numbers, without the approximate counts."""
    return clean.profile_columns(read(spark, sf_dir, "lineitem")).where("lo is not null").select("column", "n", "lo", "hi", "suggested")


# D: joins


@query(PP + "SELECT pair_id, ts, round(y, 6) AS y, round(x, 6) AS x FROM pairs")
def d1_market_pairs(spark, sf_dir):
    return rounded(joins.market_pairs(market_panel(spark, sf_dir)).select("pair_id", "ts", "y", "x"))


@query(P + "SELECT a.market, a.date, round(a.price, 6) AS y, round(b.price, 6) AS x FROM panel a JOIN panel b ON a.date = b.date WHERE b.market = (SELECT min(market) FROM panel)")
def d2_align(spark, sf_dir):
    panel = market_panel(spark, sf_dir)
    least = panel.agg(F.min("market").alias("m"))
    reference = panel.join(F.broadcast(least), F.col("market") == F.col("m")).select("date", "price")
    return rounded(panel.select("market", "date", F.col("price").alias("y")).join(joins.align(reference, reference).select("date", "x"), "date").select("market", "date", "y", "x"))


def conflict_points(spark, sf_dir):
    """Events of customers, placed at their nation's grid point and a little off."""
    c = read(spark, sf_dir, "customer")
    return c.select((F.col("c_nationkey") % 5 + F.col("c_custkey") % 7 / 10.0).alias("x"), (F.floor(F.col("c_nationkey") / 5) + F.col("c_custkey") % 3 / 10.0).alias("y"), F.abs("c_acctbal").alias("intensity"))


POINTS = "e AS (SELECT c_nationkey % 5 + c_custkey % 7 / 10.0 AS x, floor(c_nationkey / 5) + c_custkey % 3 / 10.0 AS y, abs(c_acctbal) AS intensity FROM customer)"


@query(f"""WITH {MARKETS_SQL}, {POINTS}, n AS (SELECT market, 1 / (1 + sqrt((m.x - e.x) ** 2 + (m.y - e.y) ** 2) * 0.5) AS w, intensity FROM markets m JOIN e ON sqrt((m.x - e.x) ** 2 + (m.y - e.y) ** 2) <= 0.75),
  s AS (SELECT market, sum(w * intensity) / sum(w) AS v FROM n GROUP BY 1), a AS (SELECT m.market, coalesce(v, 0) AS v FROM markets m LEFT JOIN s USING (market))
  SELECT market, round(v, 6) AS conflict_intensity, round(v / (SELECT max(v) FROM a), 6) AS conflict_intensity_normalized FROM a""")
def d4_merge_conflict(spark, sf_dir):
    out = joins.merge_conflict(markets(spark, sf_dir), conflict_points(spark, sf_dir), 0.75)
    return rounded(out.select("market", "conflict_intensity", "conflict_intensity_normalized"))


D5 = """, e AS (SELECT market, min(date) AS lo, max(date) AS hi FROM panel GROUP BY 1), b AS (SELECT DISTINCT market, d FROM (SELECT market, min(date) AS d FROM panel GROUP BY 1 UNION ALL SELECT market, max(date) FROM panel GROUP BY 1 UNION ALL SELECT market, d FROM e, (VALUES (DATE '1997-06-01'), (DATE '1999-01-01')) t(d) WHERE d > lo AND d < hi)),
  s AS (SELECT market, d AS a, lead(d) OVER (PARTITION BY market ORDER BY d) AS z, row_number() OVER (PARTITION BY market ORDER BY d) AS regime FROM b)"""


@query(P + D5 + " SELECT p.market, date, CAST(regime AS INT) AS regime FROM panel p JOIN s ON p.market = s.market AND date BETWEEN a AND z")
def d5_regimes(spark, sf_dir):
    panel = market_panel(spark, sf_dir)
    breaks = panel.select("market").distinct().withColumn("break_date", F.explode(F.array(F.lit("1997-06-01").cast("date"), F.lit("1999-01-01").cast("date"))))
    return joins.regimes(panel.select("market", "date"), breaks, "date", ["market"])


@query(P + f", {MARKETS_SQL} SELECT market, date, round(price, 6) AS price, x, y FROM panel JOIN markets USING (market)")
def d6_attach_first(spark, sf_dir):
    return rounded(joins.attach_first(market_panel(spark, sf_dir).select("market", "date", "price"), markets(spark, sf_dir), order=["x", "y"]))


@query("SELECT event_id, 'a' AS market, round(value, 6) AS value, CAST(NULL AS VARCHAR) AS event_type FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'b', round(value, 6), event_type FROM events WHERE event_id % 2 = 1")
def d7_combine_markets(spark, sf_dir):
    e = events(spark, sf_dir)
    return rounded(joins.combine_markets({"a": e.where("event_id % 2 = 0").select("event_id", "value"), "b": e.where("event_id % 2 = 1").select("event_id", "value", "event_type")}))


@query("SELECT event_id, round(value, 6) AS value, event_type AS commodity FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def d8_combine_commodities(spark, sf_dir):
    e = events(spark, sf_dir)
    tables = {k: e.where(F.col("event_type") == k).select("event_id", "value", *(["ts"] if i % 2 else [])) for i, k in enumerate(("click", "view", "purchase"))}
    return rounded(joins.combine_commodities(tables))


@query(P + "SELECT p.market, date, round(price, 6) AS price, round(o.t, 6) AS total FROM panel p LEFT JOIN (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(o_totalprice) AS t FROM orders WHERE month(o_orderdate) <> 4 GROUP BY 1) o USING (date)")
def d10_with_rates(spark, sf_dir):
    rates = read(spark, sf_dir, "orders").where(F.month("o_orderdate") != 4).groupBy(F.trunc("o_orderdate", "month").alias("date")).agg(F.avg("o_totalprice").alias("total"))
    return rounded(joins.with_rates(market_panel(spark, sf_dir).select("market", "date", "price"), rates))


@query(P + f", {MARKETS_SQL} SELECT market, x, y, round(avg(price), 6) AS price FROM panel JOIN markets USING (market) GROUP BY 1, 2, 3")
def d11_with_attributes(spark, sf_dir):
    means = market_panel(spark, sf_dir).groupBy("market").agg(F.avg("price").alias("price"))
    return rounded(joins.with_attributes(means, markets(spark, sf_dir), "market"))


@query(PP + "SELECT pair_id, ts, round(y / x, 6) AS ratio FROM pairs")
def d12_price_ratios(spark, sf_dir):
    return rounded(joins.price_ratios(market_panel(spark, sf_dir)))


# E: aggregates


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS l_quantity_sum, round(avg(l_quantity), 6) AS l_quantity_mean, round(max(l_tax), 6) AS l_tax_max, round(stddev_samp(l_discount), 6) AS l_discount_std FROM lineitem GROUP BY 1, 2")
def e1_aggregate(spark, sf_dir):
    return rounded(describe.aggregate(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], {"l_quantity": ["sum", "mean"], "l_tax": "max", "l_discount": ["std"]}))


@query("""SELECT * FROM (SELECT 'l_extendedprice' AS "column", count(l_extendedprice) AS count, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, round(min(l_extendedprice), 4) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, round(max(l_extendedprice), 4) AS max, round(skewness(l_extendedprice), 4) AS skew, round(kurtosis(l_extendedprice), 4) AS kurtosis, round(var_samp(l_extendedprice), 2) AS var, round(stddev_samp(l_extendedprice) / sqrt(count(l_extendedprice)), 4) AS se, round(stddev_samp(l_extendedprice) / avg(l_extendedprice), 4) AS cv FROM lineitem)
 UNION ALL SELECT 'l_quantity', count(l_quantity), round(avg(l_quantity), 4), round(stddev_samp(l_quantity), 4), round(min(l_quantity), 4), round(quantile_cont(l_quantity, 0.25), 4), round(quantile_cont(l_quantity, 0.5), 4), round(quantile_cont(l_quantity, 0.75), 4), round(max(l_quantity), 4), round(skewness(l_quantity), 4) + 0.0, round(kurtosis(l_quantity), 4), round(var_samp(l_quantity), 2), round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 4), round(stddev_samp(l_quantity) / avg(l_quantity), 4) FROM lineitem""")
def e2_describe(spark, sf_dir):
    out = describe.describe(read(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"])
    return rounded(out.withColumn("var", F.round("var", 2)), 4)


PAIR_NAMES = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]
NAMES = ["l_quantity", "l_extendedprice", "l_discount"]


def _corr_sql(expr) -> str:
    half = [f"SELECT '{x}' AS a, '{y}' AS b, {expr(a, b)} AS corr" for a, b in PAIR_NAMES for x, y in ((a, b), (b, a))]
    return " UNION ALL ".join([*half, *[f"SELECT '{c}', '{c}', 1.0" for c in NAMES]])


@query(_corr_sql(lambda a, b: f"(SELECT round(corr({a}, {b}), 6) FROM lineitem)"))
def e3_pearson(spark, sf_dir):
    return rounded(describe.correlation(read(spark, sf_dir, "lineitem").select(*NAMES), NAMES))


@query(_corr_sql(lambda a, b: f"(SELECT round(corr(x, y), 6) FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS x, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS y FROM lineitem))"))
def e4_spearman(spark, sf_dir):
    return rounded(describe.correlation(read(spark, sf_dir, "lineitem").select(*NAMES), NAMES, "spearman"))


@query(P + """, p AS (SELECT price AS a, conflict_intensity AS b FROM panel), c AS (SELECT sum(sign(x.a - y.a) * sign(x.b - y.b)) / 2 AS s FROM p x, p y), n AS (SELECT count(*) * (count(*) - 1) / 2.0 AS n FROM p),
  t1 AS (SELECT sum(c * (c - 1) / 2.0) AS t FROM (SELECT count(*) AS c FROM p GROUP BY a)), t2 AS (SELECT sum(c * (c - 1) / 2.0) AS t FROM (SELECT count(*) AS c FROM p GROUP BY b))
  SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE (SELECT round(c.s / sqrt((n.n - t1.t) * (n.n - t2.t)), 6) FROM c, n, t1, t2) END AS corr FROM (VALUES ('price'), ('conflict_intensity')) l(a), (VALUES ('price'), ('conflict_intensity')) r(b)""")
def e5_kendall(spark, sf_dir):
    panel = market_panel(spark, sf_dir)
    return rounded(describe.correlation(panel.select("price", "conflict_intensity"), ["price", "conflict_intensity"], "kendall"))


@query(P + "SELECT date, round(avg(price), 6) AS mean, round(stddev_samp(price), 6) AS std, round(stddev_samp(price) / avg(price), 6) AS cv FROM panel GROUP BY 1")
def e6_dispersion(spark, sf_dir):
    return rounded(describe.dispersion(market_panel(spark, sf_dir)))


@query(P + "SELECT date, round(avg(conflict_intensity), 6) AS mean_conflict_intensity FROM panel GROUP BY 1")
def e7_mean_conflict(spark, sf_dir):
    return rounded(describe.mean_by(market_panel(spark, sf_dir), "conflict_intensity"))


@query(PP + "SELECT market_y, market_x, round(corr(y, x), 6) AS corr, count(*) AS n FROM pairs GROUP BY 1, 2")
def e8_market_correlation(spark, sf_dir):
    return rounded(describe.market_correlations(market_panel(spark, sf_dir)))


@query(P + ", m AS (SELECT quantile_cont(conflict_intensity, 0.5) AS m FROM panel) SELECT CASE WHEN conflict_intensity > m THEN 'high' ELSE 'low' END AS level, round(avg(price), 6) AS mean, round(stddev_samp(price), 6) AS std, count(price) AS n FROM panel, m GROUP BY 1")
def e9_group_levels(spark, sf_dir):
    return rounded(describe.group_levels(market_panel(spark, sf_dir), "conflict_intensity", "price"))


@query(P + ", s AS (SELECT avg(price) AS m, stddev_samp(price) AS s FROM panel) SELECT market, date, CASE WHEN price > m + s THEN 'high' WHEN price < m - s THEN 'low' ELSE 'medium' END AS cluster FROM panel, s")
def e10_cluster_flags(spark, sf_dir):
    return describe.cluster_flags(market_panel(spark, sf_dir), "price").select("market", "date", "cluster")


@query()
def e11_bootstrap(spark, sf_dir):
    return rounded(describe.bootstrap(market_panel(spark, sf_dir), "price", "mean", 1000, keys=KEYS, order=ORDER))


@query("""WITH s AS (SELECT min(value) AS a, max(value) AS b FROM events) SELECT CAST(k AS INT) AS bin, round(a + (k - 1) * (b - a) / 20, 6) AS lo, round(a + k * (b - a) / 20, 6) AS hi, count(*) AS n
  FROM (SELECT least(floor((value - a) / ((b - a) / 20)) + 1, 20) AS k, a, b FROM events, s) GROUP BY k, a, b""")
def e12_histogram(spark, sf_dir):
    return rounded(describe.histogram(events(spark, sf_dir), "value", 20))


# F: features

W = "(PARTITION BY user_id ORDER BY ts, event_id)"
WR = lambda a, b="CURRENT ROW": f"(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {a} AND {b})"


@query(f"SELECT event_id, round(lag(value, 1) OVER {W}, 6) AS value_lag_1, round(lag(value, 3) OVER {W}, 6) AS value_lag_3 FROM events")
def f1_lags(spark, sf_dir):
    return rounded(features.lags(events(spark, sf_dir), ["value"], [1, 3], EK, EO).select("event_id", "value_lag_1", "value_lag_3"))


@query("SELECT event_id, " + ", ".join(f"round({g}(value) OVER {WR(f'{n - 1} PRECEDING')}, 6) AS value_roll_{n}_{f}" for n in (3, 7) for f, g in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))) + " FROM events")
def f2_rolling(spark, sf_dir):
    return rounded(features.rolling(events(spark, sf_dir), ["value"], [3, 7], EK, EO).drop("user_id", "ts", "event_type", "value"))


@query(P + "SELECT market, date, round(price - lag(price) OVER w, 6) AS price_diff_1, round(price - lag(price, 2) OVER w, 6) AS price_diff_2, round(price - lag(price, 12) OVER w, 6) AS price_sdiff_12, round(price - lag(price, 12) OVER w - (lag(price) OVER w - lag(price, 13) OVER w), 6) AS price_diff1_sdiff_12 FROM panel WINDOW w AS (PARTITION BY market ORDER BY date)")
def f3_differences(spark, sf_dir):
    out = features.differences(market_panel(spark, sf_dir).select("market", "date", "price"), ["price"], KEYS, ORDER, [1, 2], 12)
    return rounded(out.drop("price"))


@query(f"WITH {GAPPY}, p AS (SELECT event_id, user_id, ts, last_value(value IGNORE NULLS) OVER {WR('UNBOUNDED PRECEDING')} AS v FROM g) SELECT event_id, round(v / nullif(lag(v) OVER {W}, 0) - 1, 4) + 0.0 AS value_pct_1 FROM p")
def f4_pct_changes(spark, sf_dir):
    return rounded(features.pct_changes(gappy(spark, sf_dir), ["value"], EK, EO).select("event_id", "value_pct_1"), 4)


@query("WITH m AS (SELECT user_id, min(value - 50) AS m FROM events GROUP BY 1) SELECT event_id, round(ln(value - 50 + CASE WHEN m <= 0 THEN abs(m) + 1 ELSE 0 END + 0.01), 6) AS v_log FROM events JOIN m USING (user_id)")
def f5_log(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("v", F.col("value") - 50)
    return rounded(features.log_transform(rows, ["v"], 0.01, EK).select("event_id", "v_log"))


@query("SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS value_norm FROM events")
def f9_scale(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rounded(features.scale(rows, features.scale_parameters(rows, ["value"]), ["value"]).select("event_id", "value_norm"))


@query(P + ", q AS (SELECT market, quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.5) AS m, quantile_cont(price, 0.75) AS b FROM panel GROUP BY 1) SELECT market, date, round((price - m) / (b - a), 6) AS price_norm FROM panel JOIN q USING (market)")
def f10_normalize(spark, sf_dir):
    return rounded(features.normalize(market_panel(spark, sf_dir), ["price"], "robust", KEYS).select("market", "date", "price_norm"))


@query(f"WITH {GAPPY} SELECT event_id, round(coalesce(last_value(value IGNORE NULLS) OVER {WR('UNBOUNDED PRECEDING')}, first_value(value IGNORE NULLS) OVER {WR('CURRENT ROW', 'UNBOUNDED FOLLOWING')}), 6) AS value FROM g")
def f11_fill(spark, sf_dir):
    return rounded(features.fill(gappy(spark, sf_dir), "value", EK, EO).select("event_id", "value"))


@query(P + "SELECT market, date, round(price / CASE WHEN month(date) % 2 = 0 THEN rate_a ELSE rate_b END, 6) AS price_adj FROM panel")
def f12_regime_rates(spark, sf_dir):
    panel = market_panel(spark, sf_dir).withColumn("regime", F.month("date") % 2)
    return rounded(features.regime_rates(panel, "regime", ["rate_a", "rate_b"]).select("market", "date", "price_adj"))


@query(P + """, r AS (SELECT *, rate_a / rate_b AS r FROM panel), z AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY market ORDER BY date) > 1 AND abs(r - avg(r) OVER w) / (stddev_samp(r) OVER w + 1e-8) > 1.5 THEN 1 ELSE 0 END AS t FROM r
  WINDOW w AS (PARTITION BY market ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)), g AS (SELECT *, CAST(sum(t) OVER (PARTITION BY market ORDER BY date) % 2 AS INT) AS regime FROM z)
  SELECT market, date, regime, round(price / CASE WHEN regime = 0 THEN rate_a ELSE rate_b END, 6) AS price_adj FROM g""")
def f13_inferred_regimes(spark, sf_dir):
    return rounded(features.inferred_regimes(market_panel(spark, sf_dir), "rate_a", "rate_b", KEYS, ORDER, threshold=1.5).select("market", "date", "regime", "price_adj"))


@query(P + """, c AS (SELECT *, 1 + conflict_intensity AS rate_c FROM panel), v AS (SELECT *, stddev_samp(rate_a) OVER w / avg(rate_a) OVER w AS a, stddev_samp(rate_b) OVER w / avg(rate_b) OVER w AS b, stddev_samp(rate_c) OVER w / avg(rate_c) OVER w AS c FROM c
  WINDOW w AS (PARTITION BY market ORDER BY date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)), g AS (SELECT *, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS regime FROM v)
  SELECT market, date, regime, round(price / CASE regime WHEN 0 THEN rate_a WHEN 1 THEN rate_b ELSE rate_c END, 6) AS price_adj FROM g""")
def f14_steadiest_rate(spark, sf_dir):
    panel = market_panel(spark, sf_dir).withColumn("rate_c", 1 + F.col("conflict_intensity"))
    return rounded(features.steadiest_rate(panel, ["rate_a", "rate_b", "rate_c"], KEYS, ORDER).select("market", "date", "regime", "price_adj"))


@query(P + """, d AS (SELECT market, date, price - lag(price) OVER (PARTITION BY market ORDER BY date) AS d, row_number() OVER (PARTITION BY market ORDER BY date) AS i FROM panel),
  e AS (SELECT a.market, a.date, sum(CASE WHEN b.i = 2 THEN pow(0.5, a.i - 3) ELSE pow(0.5, a.i - b.i) END * b.d) AS x FROM d a JOIN d b ON a.market = b.market AND b.i < a.i AND b.i >= 2 GROUP BY 1, 2)
  SELECT d.market, d.date, round(lag(d, 1) OVER w, 6) AS standard, CASE WHEN i > 3 THEN round(avg(d) OVER (PARTITION BY d.market ORDER BY d.date ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 6) END AS moving_average, round(x, 6) AS exponential
  FROM d LEFT JOIN e ON d.market = e.market AND d.date = e.date WINDOW w AS (PARTITION BY d.market ORDER BY d.date)""")
def f15_momentum(spark, sf_dir):
    out = market_panel(spark, sf_dir)
    for kind in ("standard", "moving_average", "exponential"):
        out = features.momentum(out, "price", KEYS, ORDER, kind, name=kind)
    return rounded(out.select("market", "date", "standard", "moving_average", "exponential"))


@query(P + "SELECT market, date, CAST(CASE WHEN conflict_intensity >= 0.5 THEN 1 ELSE 0 END AS DOUBLE) AS above, round(price * CASE WHEN conflict_intensity >= 0.5 THEN 1 ELSE 0 END, 6) AS price_above, round(price * CASE WHEN conflict_intensity >= 0.5 THEN 0 ELSE 1 END, 6) AS price_below FROM panel")
def f16_heaviside(spark, sf_dir):
    return rounded(features.heaviside(market_panel(spark, sf_dir), "price", "conflict_intensity", 0.5).select("market", "date", "above", "price_above", "price_below"))


@query(P + """, w AS (SELECT market, date, price, row_number() OVER o AS i, CASE WHEN count(price) OVER (PARTITION BY market ORDER BY date ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN
  (sum(price) OVER (PARTITION BY market ORDER BY date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + (lag(price, 6) OVER o + lead(price, 6) OVER o) / 2) / 12 END AS trend FROM panel WINDOW o AS (PARTITION BY market ORDER BY date)),
  s AS (SELECT market, (i - 1) % 12 AS ph, avg(price - trend) AS s FROM w GROUP BY 1, 2), m AS (SELECT market, avg(s) AS m FROM s GROUP BY 1)
  SELECT w.market, date, round(trend, 6) AS trend, round(s - m, 6) AS seasonal, round(price - trend - (s - m), 6) AS resid FROM w JOIN s ON w.market = s.market AND (i - 1) % 12 = ph JOIN m ON w.market = m.market""")
def f17_decompose(spark, sf_dir):
    return rounded(features.decompose(market_panel(spark, sf_dir), "price", KEYS, ORDER).select("market", "date", "trend", "seasonal", "resid"))


@query(P + """, e AS (SELECT market, date, price - avg(price) OVER (PARTITION BY market) AS e, row_number() OVER (PARTITION BY market ORDER BY date) AS i FROM panel), s AS (SELECT market, sum(e * e) AS s FROM e GROUP BY 1)
  SELECT a.market, CAST(b.i - a.i AS INT) AS lag, round(sum(a.e * b.e) / any_value(s), 6) AS acf FROM e a JOIN e b ON a.market = b.market AND b.i - a.i BETWEEN 0 AND 40 JOIN s ON a.market = s.market GROUP BY 1, 2""")
def f18_acf(spark, sf_dir):
    return rounded(features.acf(market_panel(spark, sf_dir), "price", KEYS, ORDER).withColumn("lag", F.col("lag").cast("int")))


@query()
def f18_pacf(spark, sf_dir):
    return rounded(features.pacf(features.acf(market_panel(spark, sf_dir), "price", KEYS, ORDER, 20), KEYS))


@query()
def f19_qq(spark, sf_dir):
    return rounded(features.qq(market_panel(spark, sf_dir), "price", KEYS, ORDER))
