"""Shared helpers of the text operators: table access, held-out rules, shared-folder tables."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch: texts are long, and executors hold several batches outside their heap.
BATCH_ROWS = 1024


def light_batches(spark: SparkSession) -> None:
    """Lets Spark hand texts to Python in batches of BATCH_ROWS rows, unless the session asks for fewer already."""
    if int(spark.conf.get(BATCH, "10000")) > BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    light_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the rule by which rows are held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/barloom-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    The shuffle files behind it are of no use once it is written and are removed at once.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of values (before Spark's own overhead) that may be broadcast; what is larger is shuffled.
BROADCAST_BYTES = 32 << 20
#: Parts into which the rows of one key are dealt in a shuffled join.
SALT = 64


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if its values, measured first, take at most ``limit`` bytes (BROADCAST_BYTES), else as it is."""

    def width(name: str, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(name), F.lit(0)) + 16
        if kind.startswith(("array", "map", "struct")):
            return F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)) + 16
        return F.lit(8)

    size = df.select(sum((width(f"`{c}`", k) for c, k in df.dtypes), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0]
    return F.broadcast(df) if (size or 0) <= (BROADCAST_BYTES if limit is None else limit) else df


def attach(rows: DataFrame, found: DataFrame, key: str, spread: Column) -> DataFrame:
    """``rows`` left-joined with ``found`` (one row for each key): by broadcast if ``found`` is small, else with the rows of
    one key dealt over SALT parts by ``spread``, so that a hot key isn't one task. Null keys find nothing."""
    if (few := small(found)) is not found:
        return rows.join(few, key, "left")
    salt = F.pmod(F.xxhash64(spread), F.lit(SALT))
    copies = found.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return rows.withColumn("_salt", salt).join(copies, [key, "_salt"], "left").drop("_salt")


#: A key that more than one in HOT_SHARE rows hold is hot; so there are fewer than HOT_SHARE of these at any size.
HOT_SHARE = 4096


def attach_shuffled(rows: DataFrame, found: DataFrame, key: str, spread: Column) -> DataFrame:
    """As attach(), but whatever the size of ``found``, only the part of it that hot keys find may go through the driver;
    other rows are shuffled by key. ``rows`` is read twice."""
    least = rows.count() // HOT_SHARE
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    hot = written(counts.filter(F.col("_n") > least).select(key))
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    apart = F.col(key).isNull() | F.col("_hot").isNotNull()
    few = attach(marked.filter(apart).drop("_hot"), written(found.join(F.broadcast(hot), key, "left_semi")), key, spread)
    return marked.filter(~apart).drop("_hot").join(found, key, "left").unionByName(few)


def ship(spark: SparkSession, value):
    """A broadcast of a value whose size the caller has bounded."""
    light_batches(spark)
    return spark.sparkContext.broadcast(value)


#: Rows and bytes of text that a Python task handles at a time.
SLICE_ROWS, SLICE_BYTES = 1024, 1 << 20


def slices(batches, text: int, rows: int = SLICE_ROWS, size: int = SLICE_BYTES):
    """The Arrow batches in slices of at most ``rows`` rows and about ``size`` bytes in column ``text`` (longer single texts stay whole).

    Memory that Arrow holds but no longer uses goes back to the machine after each batch: workers live on between stages.
    """
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
        ends, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, stop - at)
            at = stop
        del batch
        pa.default_memory_pool().release_unused()


def whole_runs(batches, column: str):
    """Arrow tables of rows sorted by ``column``, cut so that all rows of a value are in one table: a batch and the longest run at most."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column)
        other = np.flatnonzero(pc.not_equal(keys, keys[-1]).to_numpy(zero_copy_only=False))
        start = int(other[-1]) + 1 if len(other) else 0
        if start or held and held[-1].column(column)[0] != keys[0]:
            held.append(batch.slice(0, start))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
