"""The market panel that queries start from, and market pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKET, DATE, PRICE = "market", "date", "price"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def market_panel(spark: SparkSession, sf_dir: str, commodity: str | None = None) -> DataFrame:
    """market, date (month), price, conflict_intensity, rate_a, rate_b; optionally by a column of part."""
    items = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    items = items.join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    keys = [F.col("n_name").alias("market"), F.trunc("l_shipdate", "month").alias("date")]
    if commodity:
        items = items.join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        keys.append(F.col(commodity).alias("commodity"))
    return items.groupBy(*keys).agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("conflict_intensity"),
        (1 + F.avg("l_tax")).alias("rate_a"),
        (1 + F.avg("l_discount")).alias("rate_b"),
    )


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of the markets on a grid."""
    key = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("market"), (key % 5).cast("double").alias("x"), F.floor(key / 5).cast("double").alias("y"))


#: The same panel for DuckDB.
PANEL_SQL = """panel AS (
  SELECT n_name AS market, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         avg(l_extendedprice / l_quantity) AS price,
         avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS conflict_intensity,
         1 + avg(l_tax) AS rate_a, 1 + avg(l_discount) AS rate_b
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2
)"""
COMMODITY_SQL = PANEL_SQL.replace("panel AS", "goods AS").replace("AS DATE) AS date,", "AS DATE) AS date, p_brand AS commodity,").replace("JOIN nation ON s_nationkey = n_nationkey", "JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey").replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3")
MARKETS_SQL = "markets AS (SELECT n_name AS market, CAST(n_nationkey % 5 AS DOUBLE) AS x, floor(n_nationkey / 5) AS y FROM nation)"
PAIRS_SQL = """pairs AS (
  SELECT a.market || '|' || b.market AS pair_id, a.market AS market_y, b.market AS market_x, a.date AS ts, a.price AS y, b.price AS x
  FROM panel a JOIN panel b ON a.date = b.date AND a.market < b.market
)"""
