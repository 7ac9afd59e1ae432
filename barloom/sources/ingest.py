"""Ingest of raw minute bars: typed scans and sinks, symbol resolution, and audits.

Roots, month codes and decades are parameters of the instrument naming, not of the code's structure.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = T.StructType([T.StructField(n, k) for n, k in (("ts_event", T.StringType()), ("rtype", T.LongType()), ("publisher_id", T.LongType()), ("instrument_id", T.StringType()), ("open", T.DoubleType()), ("high", T.DoubleType()), ("low", T.DoubleType()), ("close", T.DoubleType()), ("volume", T.LongType()), ("symbol", T.StringType()))])
TYPED = T.StructType([T.StructField(n, k) for n, k in (("ts_event", T.TimestampType()), ("rtype", T.LongType()), ("publisher_id", T.LongType()), ("instrument_id", T.LongType()), ("open", T.DoubleType()), ("high", T.DoubleType()), ("low", T.DoubleType()), ("close", T.DoubleType()), ("volume", T.LongType()), ("symbol", T.StringType()), ("contract_root", T.StringType()), ("expiry_date", T.DateType()))])
#: Month codes of quarterly contracts.
MONTHS = {"H": 3, "M": 6, "U": 9, "Z": 12}
ROOTS = ("ES", "NQ", "RTY")


def scan_csv(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """All files of a glob by the raw schema; only the named columns are parsed."""
    df = spark.read.schema(RAW).csv(path, header=True)
    return df.select(*columns) if columns else df


def scan_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A projected scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_typed(df: DataFrame, path: str) -> None:
    """The typed table, one directory a root, rows sorted in each file. Large roots are split by symbol."""
    df.select(*TYPED.fieldNames()).repartition("contract_root", "symbol").sortWithinPartitions("contract_root", "symbol", "ts_event").write.partitionBy("contract_root").parquet(path)


def write_results(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Result tables as CSV (with header), JSON or Parquet."""
    w = df.write.option("header", True) if form == "csv" else df.write
    w.format(form).save(path)


def fingerprint(spark: SparkSession, inputs: Iterable[str] = (), **parameters) -> str:
    """A digest of parameters and of the files below the input paths (name, length, time of change)."""
    found = [json.dumps(parameters, sort_keys=True, default=str)]
    for path in inputs:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
        own = []
        while files.hasNext():
            f = files.next()
            own.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
        found += [path, *sorted(own)]
    return hashlib.sha256("\n".join(found).encode()).hexdigest()[:32]


def read_through(spark: SparkSession, path: str, compute, inputs: Iterable[str] = (), **parameters) -> DataFrame:
    """The table that ``compute`` makes of the input paths with these parameters, written below path at the first call.

    Other parameters or changed input files are another table. It is written aside and then renamed, so that a table
    that is there is whole; if two jobs write it at once, the first to finish is kept.
    """
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    target = jvm.Path(f"{path.rstrip('/')}/{fingerprint(spark, inputs, **parameters)}")
    files = target.getFileSystem(conf)
    if not files.exists(target):
        aside = jvm.Path(target.getParent(), f"_{target.getName()}-{uuid.uuid4().hex}")
        try:
            compute().write.parquet(aside.toString())
            if not files.exists(target):
                files.rename(aside, target)
                late = jvm.Path(target, aside.getName())  # where a rename goes if the target has come up meanwhile
                if files.exists(late):
                    files.delete(late, True)
        finally:
            if files.exists(aside):
                files.delete(aside, True)
    return spark.read.parquet(target.toString())


def typed_ids(df: DataFrame, strict: bool = True) -> DataFrame:
    """instrument_id as a number; null or other text raises, or (not strict) goes."""
    n = F.expr("try_cast(instrument_id AS BIGINT)")
    if strict:
        n = F.when(n.isNull(), F.raise_error(F.concat(F.lit("bad instrument_id: "), F.coalesce(F.col("instrument_id").cast("string"), F.lit("null"))))).otherwise(n)
        return df.withColumn("instrument_id", n.cast("bigint"))
    return df.withColumn("instrument_id", n).filter("instrument_id IS NOT NULL")


def utc_timestamp(c: str | Column) -> Column:
    """An ISO timestamp with or without fraction (up to ns) and zone, as a UTC timestamp; null if it is none."""
    c = F.col(c) if isinstance(c, str) else c
    cut = F.regexp_replace(c, r"(\.\d{6})\d+", "$1")
    zoned = F.when(cut.rlike(r"(Z|[+-]\d\d:?\d\d)$"), cut).otherwise(F.concat(cut, F.lit("Z")))
    return F.try_to_timestamp(zoned)


def is_outright(symbol: str | Column = "symbol", roots: tuple[str, ...] = ROOTS) -> Column:
    """Root, month code, one digit of the year."""
    return (F.col(symbol) if isinstance(symbol, str) else symbol).rlike(f"^({'|'.join(roots)})[{''.join(MONTHS)}][0-9]$")


def root_of(symbol: str | Column = "symbol", roots: tuple[str, ...] = ROOTS) -> Column:
    """S13."""
    return F.nullif(F.regexp_extract(symbol, f"^({'|'.join(roots)})[{''.join(MONTHS)}][0-9]$", 1), F.lit(""))


def contract_year(digit: Column, first: Column, last: Column, window_first: bool = False) -> Column:
    """Of 2010 + digit and 2020 + digit the nearer to the middle of the years seen, the earlier on a tie.

    S15 (``window_first``): the earlier candidate within a year of the years seen comes first.
    """
    early, late = digit + 2010, digit + 2020
    middle = (first + last) / 2
    near = F.when(F.abs(early - middle) <= F.abs(late - middle), early).otherwise(late)
    if not window_first:
        return near
    fits = lambda y: (y >= first - 1) & (y <= last + 1)
    return F.when(fits(early), early).when(fits(late), late).otherwise(near)


def third_friday(year: Column, month: Column) -> Column:
    """S16."""
    return F.date_add(F.next_day(F.date_sub(F.make_date(year, month, F.lit(1)), 1), "FRI"), 14)


def month_of(code: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, m in MONTHS.items():
        out = F.when(code == k, m).otherwise(out)
    return out


def instruments(df: DataFrame, window_first: bool = False) -> DataFrame:
    """(instrument_id, raw_symbol, symbol, contract_root, expiry_date), one row per instrument."""
    d = df.groupBy("instrument_id").agg(F.min_by("symbol", "ts_event").alias("raw_symbol"), F.year(F.min("ts_event")).alias("first"), F.year(F.max("ts_event")).alias("last"))
    code, digit = F.substring("raw_symbol", -2, 1), F.right("raw_symbol", F.lit(1)).cast("int")
    d = d.withColumn("year", contract_year(digit, F.col("first"), F.col("last"), window_first)).withColumn("contract_root", root_of("raw_symbol"))
    return d.select("instrument_id", "raw_symbol", F.concat("contract_root", code, F.col("year").cast("int").cast("string")).alias("symbol"), "contract_root", third_friday(F.col("year").cast("int"), month_of(code)).alias("expiry_date"))


def resolved(df: DataFrame) -> DataFrame:
    """Rows with the symbols of the instrument table."""
    return df.withColumnRenamed("symbol", "raw_symbol").join(instruments(df).drop("raw_symbol"), "instrument_id")


def symbol_inventory(df: DataFrame) -> DataFrame:
    """Q1: first and last time and rows of each symbol."""
    return df.groupBy(root_of().alias("contract_root"), "symbol").agg(F.min("ts_event").alias("first_ts"), F.max("ts_event").alias("last_ts"), F.count("*").alias("n"))


def top_rejected(df: DataFrame, k: int = 20) -> DataFrame:
    """Q2: the most frequent symbols that are no outrights."""
    return df.filter(~is_outright()).groupBy("symbol").count().orderBy(F.desc("count"), "symbol").limit(k)


def expiry_flags(df: DataFrame, late_days: int = 7, few: int = 10, busy_days: int = 2, busy: int = 1000) -> DataFrame:
    """Q3, Q4: instruments traded after expiry, with few rows, traded much after expiry, or under several symbols."""
    n = df.groupBy("instrument_id").agg(F.max("ts_event").alias("last_ts"), F.count("*").alias("n"), F.count_distinct("symbol").alias("n_symbols"))
    j = n.join(instruments(df), "instrument_id")
    return j.select(
        "instrument_id", "symbol", "n", "n_symbols", (F.to_date("last_ts") > F.date_add("expiry_date", late_days)).alias("late"), (F.col("n") <= few).alias("few"),
        ((F.to_date("last_ts") > F.date_add("expiry_date", busy_days)) & (F.col("n") > busy)).alias("busy_after"), (F.col("n_symbols") > 1).alias("many_symbols"),
    )


def ids_per_root(df: DataFrame) -> DataFrame:
    """Q4: distinct instruments and symbols of each root."""
    return df.groupBy(root_of().alias("contract_root")).agg(F.count_distinct("instrument_id").alias("n_ids"), F.count_distinct("symbol").alias("n_symbols"))


def drill_down(df: DataFrame, symbol: str) -> DataFrame:
    """Q5: the instruments of one raw symbol."""
    return df.filter(F.col("symbol") == symbol).groupBy("instrument_id").agg(F.min("ts_event").alias("first_ts"), F.max("ts_event").alias("last_ts"), F.count("*").alias("n"))


def schema_check(df: DataFrame, expected: T.StructType = TYPED) -> DataFrame:
    """Q6: each expected column with its place and type, whether the table agrees, and how many rows hold a value.

    One pass over the table; a column that the table lacks holds none.
    """
    at = {f.name: (i, f.dataType) for i, f in enumerate(df.schema)}
    cells = [
        F.struct(F.lit(i).alias("place"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(at.get(f.name) == (i, f.dataType)).alias("agrees"), (F.count(f.name) if f.name in at else F.lit(0).cast("long")).alias("known"), F.count("*").alias("n"))
        for i, f in enumerate(expected)
    ]
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Q7."""
    return df.groupBy(*keys).count().filter("count > 1")


def inversions(df: DataFrame, key: str, ts: str, place: str) -> DataFrame:
    """Q8: how often time runs back in stored order (``place``, added at ingest)."""
    back = F.col(ts) < F.lag(ts).over(Window.partitionBy(key).orderBy(place))
    return df.withColumn("_back", back).groupBy(key).agg(F.count_if("_back").alias("inversions"))


def one_to_one(df: DataFrame, a: str, b: str) -> DataFrame:
    """Q9: values of a with several b."""
    return df.groupBy(a).agg(F.count_distinct(b).alias("n")).filter("n > 1")


def round_trip(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-8) -> DataFrame:
    """Q10: rows of either side without an equal partner on the other."""
    j = a.select(*keys, *[F.col(v).alias(f"{v}_a") for v in values], F.lit(1).alias("_a")).join(b.select(*keys, *[F.col(v).alias(f"{v}_b") for v in values], F.lit(1).alias("_b")), keys, "full")
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    for v in values:
        same = same & F.coalesce(F.abs(F.col(f"{v}_a") - F.col(f"{v}_b")) <= tolerance, F.col(f"{v}_a").isNull() & F.col(f"{v}_b").isNull())
    return j.filter(~same).drop("_a", "_b")


def counts(df: DataFrame, key: str) -> DataFrame:
    """Q11: rows and distinct ids."""
    return df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("ids"))


def profile(df: DataFrame, columns: list[str], order: str | None = None) -> DataFrame:
    """Q12: type, known and distinct values, least and greatest, and with ``order`` first and last value, as text, of each column."""
    text = lambda c: c.cast("string")
    cells = [
        F.struct(
            F.lit(c).alias("name"), F.lit(df.schema[c].dataType.simpleString()).alias("type"), F.count(c).alias("known"), F.count_distinct(c).alias("unique"), text(F.min(c)).alias("least"), text(F.max(c)).alias("greatest"),
            *([text(F.min_by(c, order)).alias("head"), text(F.max_by(c, order)).alias("tail")] if order else []),
        )
        for c in columns
    ]
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def retention(df: DataFrame, valid: Column) -> DataFrame:
    """Q13: total, valid and excluded rows and the share kept, by root."""
    ok = F.count_if(valid)
    return df.groupBy("root").agg(F.count("*").alias("total"), ok.alias("valid"), (F.count("*") - ok).alias("excluded"), (ok / F.count("*")).alias("share"))


def window_counts(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Q14: training rows against an expected middle (root, middle), with the deviation in percent and a 20 % flag."""
    n = df.groupBy("root").agg(F.count("*").alias("n_total"), F.count_if("is_valid_bar").alias("n_valid"), F.count_if("is_train_valid_bar").alias("n_train"))
    off = (F.col("n_train") - F.col("middle")) * 100.0 / F.col("middle")
    return n.join(F.broadcast(expected), "root").withColumn("deviation_pct", off).withColumn("flagged", F.abs(off) > 20)
