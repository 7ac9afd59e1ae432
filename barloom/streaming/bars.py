"""Streaming bars: the tumbling aggregate of operators.bars over an unbounded source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(ticks: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of ticks (root, instrument_id, ts, price, volume, tie), given once the watermark passes their end."""
    at = F.struct("ts", "tie")
    out = ticks.withWatermark("ts", late).groupBy("root", "instrument_id", F.window("ts", f"{minutes} minutes").alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume")
    )
    return out.select("root", "instrument_id", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume").filter("volume > 0")
