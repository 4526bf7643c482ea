"""Analysis frames from the tables: one row per unit of observation, a named column per role."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y: price; t: a discount of at least 5 %; z: an odd line number; x1, x2: quantity and tax."""
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("y"), (F.col("l_discount") >= 0.05).cast("int").alias("t"),
        (F.col("l_linenumber") % 2).alias("z"), F.col("l_quantity").alias("x1"), F.col("l_tax").alias("x2"), F.col("l_discount").alias("d"),
        F.col("l_returnflag").alias("stratum"), F.col("l_linestatus").alias("segment"), F.col("l_suppkey").alias("cluster"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y: price; t: an even customer key; post: from 1999 on; unit: the customer; quarter counted from 1992."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("unit"), F.col("o_totalprice").alias("y"), (F.col("o_custkey") % 2).cast("int").alias("t"),
        (F.year("o_orderdate") >= 1999).cast("int").alias("post"), ((F.year("o_orderdate") - 1992) * 4 + F.quarter("o_orderdate") - 1).alias("quarter"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y: balance; t: building or machinery segment; observed: a balance of at least 0; nation."""
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("y"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").cast("int").alias("t"),
        (F.col("c_acctbal") >= 0).cast("int").alias("observed"), F.col("c_nationkey").alias("nation"),
    )


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series: event type; day; n and v: events and mean value of the day."""
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"))
