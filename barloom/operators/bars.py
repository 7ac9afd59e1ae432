"""Bars, sessions and volatility: ticks or minute bars in, one row per bar and instrument out.

Bars have ``root, instrument_id, ts, open, high, low, close, volume``. All windows of an instrument share one
partitioning (root, instrument_id) and order (ts), so Spark plans one exchange and sort for them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.safe import log_ratio, ratio, require_columns, seconds
from barloom.functions.smoothing import ewm_std, ewma

KEYS = ["root", "instrument_id"]
GAP, WARMUP, SPAN = 15 * 60, 80, 20


def order():
    """An instrument's rows in time order."""
    return Window.partitionBy(*KEYS).orderBy("ts")


def trailing(n: int):
    return order().rowsBetween(1 - n, 0)


def full(aggregate, c: Column, window, n: int) -> Column:
    """An aggregate over a window, null unless it holds n values."""
    return F.when(F.count(c).over(window) == n, aggregate(c).over(window))


def bars(ticks: DataFrame, minutes: int) -> DataFrame:
    """B1: left-closed, left-labelled bars of ticks (ts, price, volume, tie) or of finer bars; volume > 0 is kept."""
    if "price" in ticks.columns:
        ticks = ticks.select(*KEYS, "ts", "tie", *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], "volume")
    else:
        ticks = require_columns(ticks, *KEYS, "ts", "open", "high", "low", "close", "volume").withColumn("tie", F.lit(0))
    at = F.struct("ts", "tie")
    out = ticks.groupBy(*KEYS, F.window("ts", f"{minutes} minutes")["start"].alias("bar")).agg(
        F.min_by("open", F.when(F.col("open").isNotNull(), at)).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", F.when(F.col("close").isNotNull(), at)).alias("close"), F.sum("volume").alias("volume"),
    )
    return out.withColumnRenamed("bar", "ts").filter("open IS NOT NULL AND volume > 0")


def with_parent(sub: DataFrame, minutes: int) -> DataFrame:
    return sub.withColumn("bar_ts", F.window("ts", f"{minutes} minutes")["start"])


def bar_return() -> Column:
    """log(close / open)."""
    return log_ratio("close", "open")


def close_return() -> Column:
    """Log return from the instrument's last bar, across sessions."""
    return log_ratio(F.col("close"), F.lag("close").over(order()))


def close_location() -> Column:
    """Where the close lies in the bar's range, -1 to 1; 0 without range."""
    span = F.col("high") - F.col("low")
    return F.when(span == 0, 0.0).otherwise((2 * F.col("close") - F.col("high") - F.col("low")) / F.nullif(span, F.lit(0.0)))


def parent_bars(sub: DataFrame, minutes: int, subs: bool = False) -> DataFrame:
    """Parent bars with counts and dispersion of their sub-bars; volume > 0 and two returns at least. With ``subs``,
    a bar carries (r, volume) of its sub-bars as an array, which is as long as the minutes allow."""
    s = with_parent(sub, minutes).withColumn("r", bar_return()).withColumn("clv", close_location())
    out = s.groupBy(*KEYS, "bar_ts").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
        F.count("r").alias("n_sub"), F.sum(F.abs("r")).alias("sum_abs_ret"), F.median(F.abs("r")).alias("median_abs_ret"), F.avg("clv").alias("clv_mean"), F.var_samp("clv").alias("clv_var"),
        *([F.collect_list(F.struct("r", "volume")).alias("subs")] if subs else []),
    )
    return out.withColumnRenamed("bar_ts", "ts").filter("volume > 0 AND n_sub >= 2")


def parkinson() -> Column:
    """V2: high-low variance."""
    return F.pow(log_ratio("high", "low"), F.lit(2.0)) / (4 * math.log(2))


def garman_klass() -> Column:
    """V1: range variance; without range the squared return, Parkinson where it is negative, null where it is 0."""
    r = F.pow(bar_return(), F.lit(2.0))
    gk = 0.5 * F.pow(log_ratio("high", "low"), F.lit(2.0)) - (2 * math.log(2) - 1) * r
    return F.nullif(F.when(F.col("high") == F.col("low"), r).when(gk < 0, parkinson()).otherwise(gk), F.lit(0.0))


def sessions(df: DataFrame, gap: int = GAP, name: str = "session_id") -> DataFrame:
    """The running number of the instrument's session; a gap of more than ``gap`` seconds begins one."""
    gone = seconds("ts") - F.lag(seconds("ts")).over(order())
    fresh = F.coalesce((gone > gap).cast("int"), F.lit(1))
    return df.withColumn(name, F.sum(fresh).over(order().rowsBetween(Window.unboundedPreceding, 0)))


def warmed(df: DataFrame, warmup: int = WARMUP, session: str = "session_id") -> DataFrame:
    """Bars since the session began, and whether they reach the warm-up."""
    place = F.row_number().over(Window.partitionBy(*KEYS, session).orderBy("ts")) - 1
    return df.withColumn("bar_in_session", place).withColumn("warmup_valid", place >= warmup)


def boundary_mask(df: DataFrame, gap: int = 3600, bars_back: int = 200) -> DataFrame:
    """Whether none of the last bars (this one too) begins a session."""
    gone = seconds("ts") - F.lag(seconds("ts")).over(order())
    df = df.withColumn("is_boundary", F.coalesce(gone > gap, F.lit(True)))
    return df.withColumn("clear", ~F.max("is_boundary").over(trailing(bars_back)))


def long_gap_starts(df: DataFrame, gap: int = 48 * 3600) -> DataFrame:
    """The first bar of every session after a long gap."""
    s = sessions(df, gap, "_s")
    first = F.row_number().over(Window.partitionBy(*KEYS, "_s").orderBy("ts"))
    return s.withColumn("_n", first).filter("_n = 1").drop("_s", "_n")


def session_summary(df: DataFrame, event: Column | None = None) -> DataFrame:
    """Bars, sessions, and sessions with an event, by root."""
    key = F.struct("instrument_id", "session_id")
    event = F.lit(False) if event is None else event
    return df.groupBy("root").agg(F.count("*").alias("bars"), F.count_distinct(key).alias("sessions"), F.count_distinct(F.when(event, key)).alias("sessions_with_event"))


def sigma_concurrent(df: DataFrame, span: int = SPAN, min_periods: int = 10, name: str = "sigma") -> DataFrame:
    """V3, V4: root of the smoothed variance up to and with the bar."""
    return ewma(df, garman_klass(), name, KEYS, ["ts"], span, min_periods).withColumn(name, F.sqrt(name))


def sigma_causal(df: DataFrame, span: int = SPAN, min_periods: int = 10, name: str = "sigma") -> DataFrame:
    """V5 (and V8 with span 19): as concurrent, of the bars before."""
    return ewma(df, F.lag(garman_klass()).over(order()), name, KEYS, ["ts"], span, min_periods).withColumn(name, F.sqrt(name))


def sigma_session(df: DataFrame, span: int = SPAN, warmup: int = WARMUP, gap: int = GAP, name: str = "sigma") -> DataFrame:
    """V6: causal and restarted in each session; adds session_id, bar_in_session and warmup_valid.

    The estimate needs ``warmup`` known variances, warmup_valid as many bars: the two differ where a variance is null.
    """
    df = warmed(sessions(df, gap), warmup)
    keys = [*KEYS, "session_id"]
    past = F.lag(garman_klass()).over(Window.partitionBy(*keys).orderBy("ts"))
    return ewma(df, past, name, keys, ["ts"], span, warmup).withColumn(name, F.sqrt(name))


def sigma_ewm(df: DataFrame, span: int = SPAN, min_periods: int = 10, name: str = "sigma") -> DataFrame:
    """V7: smoothed standard deviation of bar returns."""
    return ewm_std(df, bar_return(), name, KEYS, ["ts"], span, min_periods)


def _yang_zhang(w, n: int) -> Column:
    """V9: overnight, open-to-close and Rogers-Satchell variance combined over n full bars."""
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    night, day = F.col("_night"), F.col("_day")
    total = full(F.var_samp, night, w, n) + k * full(F.var_samp, day, w, n) + (1 - k) * full(F.avg, F.col("_rs"), w, n)
    return F.sqrt(F.when(total.isNotNull(), F.greatest(total, F.lit(0.0))))


def with_yang_zhang(df: DataFrame, n: int = 20, name: str = "sigma_yz") -> DataFrame:
    rs = log_ratio("high", "close") * log_ratio("high", "open") + log_ratio("low", "close") * log_ratio("low", "open")
    df = df.withColumn("_night", log_ratio(F.col("open"), F.lag("close").over(order()))).withColumn("_day", bar_return()).withColumn("_rs", rs)
    return df.withColumn(name, _yang_zhang(trailing(n), n)).drop("_night", "_day", "_rs")


def convergence(df: DataFrame, gap: int = 48 * 3600, least: int = 500, bars_shown: int = 200, span: int = SPAN) -> DataFrame:
    """How the recursive estimate nears its later value after long gaps: median and P90 deviation by bar."""
    keys = [*KEYS, "session_id"]
    rows = Window.partitionBy(*keys).orderBy("ts")
    s = sessions(df, gap).withColumn("gk", F.lag(garman_klass()).over(rows)).filter("gk IS NOT NULL")
    s = ewma(s, F.col("gk"), "v", keys, ["ts"], span, adjust=False).withColumn("bar_no", F.row_number().over(rows))
    s = s.withColumn("late", F.max(F.when(F.col("bar_no") == least, F.sqrt("v"))).over(Window.partitionBy(*keys))).filter("late IS NOT NULL")
    off = F.abs(ratio(F.sqrt("v"), "late") - 1)
    s = s.filter(F.col("bar_no") <= bars_shown).groupBy("root", "bar_no").agg(F.median(off).alias("median_off"), F.percentile(off, 0.9).alias("p90_off"))
    first = lambda c, cut: F.min(F.when(F.col(c) < cut, F.col("bar_no"))).over(Window.partitionBy("root"))
    return s.withColumn("first_5pct", first("median_off", 0.05)).withColumn("first_10pct", first("median_off", 0.1))


def checkpoints(curves: DataFrame, at: tuple[int, ...] = (1, 10, 20, 50, 100, 150, 200)) -> DataFrame:
    """The median deviation at a few bars, one row per root."""
    return curves.filter(F.col("bar_no").isin(*at)).groupBy("root").pivot("bar_no", list(at)).agg(F.first("median_off"))
