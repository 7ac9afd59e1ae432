"""Checks of a feature table: availability, ranges, correlations, stability, samples."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.safe import correlation


def long(df: DataFrame, features: list[str]) -> DataFrame:
    return df.select("root", *features).unpivot(["root"], features, "feature", "value")


def availability(df: DataFrame, features: list[str], valid: str = "is_valid_bar", least: float = 0.9) -> DataFrame:
    """Rows, known values and their share on valid bars, with flags for all-null and rare features."""
    out = long(df.filter(valid), features).groupBy("root", "feature").agg(F.count("*").alias("n"), F.count("value").alias("known"))
    rate = F.col("known") / F.col("n")
    return out.withColumn("rate", rate).withColumn("all_null", F.col("known") == 0).withColumn("rare", rate < least)


def range_check(df: DataFrame, expected: DataFrame, valid: str = "is_valid_bar") -> DataFrame:
    """Moments and percentiles against expected bounds (feature, low, high); the first check that fails is named."""
    features = [r.feature for r in expected.select("feature").collect()]
    s = long(df.filter(valid), features).groupBy("root", "feature").agg(
        F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.percentile("value", 0.01).alias("p01"), F.percentile("value", 0.99).alias("p99"), F.max("value").alias("max")
    )
    bad = F.when(F.col("min") < F.col("low"), "min").when(F.col("max") > F.col("high"), "max").when(~F.col("mean").between(F.col("low"), F.col("high")), "mean").otherwise("ok")
    return s.join(F.broadcast(expected), "feature").withColumn("check", bad)


def correlations(df: DataFrame, features: list[str], high: float = 0.85, expected: tuple = ()) -> DataFrame:
    """Pearson r of each pair on rows without a null (NaN is a value), high pairs that aren't expected, and how
    orthogonal they are; r is null where a feature stands still."""
    whole = df.filter(reduce(and_, (F.col(c).isNotNull() for c in features)))
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(a, b).alias("r")) for a, b in combinations(features, 2)]
    out = whole.groupBy("root").agg(F.count("*").alias("n"), F.array(*pairs).alias("p")).select("root", "n", F.explode("p").alias("p")).select("root", "p.a", "p.b", "n", "p.r")
    exempt = F.lit(False)
    for a, b in expected:
        exempt = exempt | ((F.col("a") == a) & (F.col("b") == b))
    r = F.abs("r")
    return out.withColumn("high_pair", (r > high) & ~exempt).withColumn("orthogonality", F.when(r < 0.05, "preserved").when(r < 0.1, "marginal").otherwise("BROKEN")).withColumn("secondary_ok", r < 0.4)


def stability(df: DataFrame, features: list[str], limit: float = 2.0) -> DataFrame:
    """The means of both halves (by place in time order), their distance in deviations, and a flag. Places are dealt over days."""
    days = df.groupBy("root", F.to_date("ts").alias("_d")).count()
    before = Window.partitionBy("root").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_o", F.coalesce(F.sum("count").over(before), F.lit(0))).withColumn("_n", F.sum("count").over(Window.partitionBy("root"))).drop("count")
    place = F.col("_o") + F.row_number().over(Window.partitionBy("root", "_d").orderBy("ts", "instrument_id"))
    df = df.withColumn("_d", F.to_date("ts")).join(days, ["root", "_d"]).withColumn("_h", place <= F.floor(F.col("_n") / 2))
    l = df.select("root", "_h", *features).unpivot(["root", "_h"], features, "feature", "value").groupBy("root", "feature")  # noqa: E741
    out = l.agg(F.avg(F.when(F.col("_h"), F.col("value"))).alias("mean_1"), F.avg(F.when(~F.col("_h"), F.col("value"))).alias("mean_2"), F.stddev_samp("value").alias("std"))
    shift = F.try_divide(F.col("mean_2") - F.col("mean_1"), F.col("std"))
    return out.withColumn("shift", shift).withColumn("flagged", F.abs(shift) > limit).drop("std")


def row_sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """N rows of each root, drawn by a seeded hash of the row's key."""
    draw = F.md5(F.concat_ws("|", "root", "instrument_id", F.unix_micros(F.col("ts").cast("timestamp")), F.lit(seed)))
    return df.withColumn("_i", F.row_number().over(Window.partitionBy("root").orderBy(draw))).filter(F.col("_i") <= n).drop("_i")
