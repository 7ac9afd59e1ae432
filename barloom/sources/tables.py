"""Ticks from the given tables: (root, instrument_id, ts, price, volume, tie)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("root"), F.col("event_type").alias("instrument_id"), "ts", F.col("value").alias("price"), F.lit(1).cast("long").alias("volume"), F.col("event_id").alias("tie"))


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.lit("orders").alias("root"), F.col("o_orderpriority").alias("instrument_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"), F.lit(1).cast("long").alias("volume"), F.col("o_orderkey").alias("tie"))


def line_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ticks: a root for each line number, an instrument for each return flag."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(
        F.concat(F.lit("line"), F.col("l_linenumber").cast("string")).alias("root"), F.col("l_returnflag").alias("instrument_id"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("price"),
        F.col("l_quantity").cast("long").alias("volume"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tie"),
    )
