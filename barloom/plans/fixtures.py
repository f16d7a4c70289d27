"""Bar series and record tables derived from the given parquet tables.

Each fixture is a Spark function plus the same derivation as SQL text, used as a
common table expression by the comparison queries.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import checkpoint_folder, pin_utc

TIE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, price"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, label: str) -> str:
    """A fresh place in the shared folder."""
    return f"{checkpoint_folder(spark)}/{label}-{uuid.uuid4().hex}"


def bars_from_lineitem(spark: SparkSession, sf_dir: str, symbol: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col(symbol).cast("string").alias("symbol"),
        F.date_trunc("day", F.col("l_shipdate").cast("timestamp")).alias("timestamp"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        "l_quantity", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey"),
    )
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price")
    daily = lines.groupBy("symbol", "timestamp").agg(
        F.min(order)["price"].alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max(order)["price"].alias("close"),
        F.sum("l_quantity").alias("volume"),
    )
    return as_bars(daily, "1d", "lineitem")


def as_bars(df: DataFrame, interval: str, source: str) -> DataFrame:
    return df.select(
        "symbol", F.lit(interval).alias("interval"), F.lit(source).alias("source"), F.lit("raw").alias("basis"),
        "timestamp", "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"),
    )


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_lineitem(spark, sf_dir, "l_returnflag")


def bars_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_lineitem(spark, sf_dir, "l_suppkey")


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("timestamp"),
        F.col("value").alias("price"), "ts", "event_id",
    )
    order = F.struct("ts", "event_id", "price")
    hourly = ticks.groupBy("symbol", "timestamp").agg(
        F.min(order)["price"].alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max(order)["price"].alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )
    return as_bars(hourly, "1h", "events")


def lineitem_sql(symbol: str, name: str = "bars") -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT symbol, '1d' AS "interval", 'lineitem' AS source, 'raw' AS basis, ts,
         arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close,
         sum(l_quantity) AS volume
  FROM (SELECT CAST({symbol} AS VARCHAR) AS symbol, date_trunc('day', l_shipdate) AS ts,
               l_extendedprice / l_quantity AS price, l_quantity,
               (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity) AS k
        FROM lineitem)
  GROUP BY symbol, ts)"""


DAILY_SQL = lineitem_sql("l_returnflag")
SUPPLIER_SQL = lineitem_sql("l_suppkey")
HOURLY_SQL = """bars AS MATERIALIZED (
  SELECT event_type AS symbol, '1h' AS "interval", 'events' AS source, 'raw' AS basis, date_trunc('hour', ts) AS ts,
         arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY event_type, date_trunc('hour', ts))"""
