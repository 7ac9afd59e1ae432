"""Stage boundaries: a table written once and read by every later step."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def staged_path(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``); a local master may fall back to /tmp."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/barloom-{uuid.uuid4().hex}"


def staged(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its plan runs once, and what reads it survives lost executors."""
    path = staged_path(df.sparkSession)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, buckets: int, keys: tuple[str, ...] = ("root", "instrument_id"), order: tuple[str, ...] = ("ts",), name: str | None = None) -> DataFrame:
    """``df`` as a table of one file a bucket, rows of equal keys together and in order.

    Windows and groups by these keys (or by more) read it without an exchange. The table lies in the shared folder; with a
    name it stays in the session's catalogue under it.
    """
    spark, name = df.sparkSession, name or f"barloom_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys, *order).option("path", staged_path(spark)).saveAsTable(name)
    return spark.table(name)
