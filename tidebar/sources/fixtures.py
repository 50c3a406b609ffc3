"""The test tables as ticks, daily tables and details, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as trades: user is the symbol, value the price, k the volume."""
    k = F.get_json_object("props", "$.k").cast("long")
    code = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "signup", 14).otherwise(0)
    late = F.make_dt_interval(secs=F.pmod(k, F.lit(6)).cast("decimal(18,6)"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), k.alias("volume"), F.array(code).alias("conditions"), (F.col("ts") - late).alias("exchange_ts"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a market table: supplier is the symbol, the month the date. Money is summed exactly."""
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    price, n = F.col("l_extendedprice"), F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").withColumn("at", at).withColumn("date", F.trunc(F.to_date("l_shipdate"), "month"))
    return rows.groupBy(F.col("l_suppkey").alias("symbol"), "date").agg(
        F.min_by(price, "at").alias("open"), F.max_by(price, "at").alias("close"), F.max(price).alias("high"), F.min(price).alias("low"),
        (F.sum((price * n).cast("decimal(20,2)")).cast("double") / F.sum(n)).alias("vwap"), F.sum(n).cast("long").alias("volume"),
    )


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as symbols: nation is the industry, region the sector; a third have another type, Africa no sector."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "etf").otherwise("cs").alias("type"), F.when(F.col("r_name") == "AFRICA", "").otherwise(F.col("r_name")).alias("sector"), F.col("n_name").alias("industry"))


SQL_TICKS = """ticks AS (SELECT user_id AS symbol, ts, event_id AS seq, value AS price, k AS volume,
  CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 14 ELSE 0 END AS cond, ts - to_seconds(k % 6) AS exchange_ts
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""

SQL_DAILY = """daily AS (SELECT l_suppkey AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
  first(l_extendedprice ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS open,
  last(l_extendedprice ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS close,
  max(l_extendedprice) AS high, min(l_extendedprice) AS low, CAST(sum(CAST(l_extendedprice * l_quantity AS DECIMAL(20, 2))) AS DOUBLE) / sum(l_quantity) AS vwap,
  CAST(sum(l_quantity) AS BIGINT) AS volume FROM lineitem GROUP BY ALL)"""

SQL_DETAILS = """details AS (SELECT s_suppkey AS symbol, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'etf' ELSE 'cs' END AS type,
  CASE WHEN r_name = 'AFRICA' THEN '' ELSE r_name END AS sector, n_name AS industry
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
