"""Gated event study: gates, thresholds, rising edges, forward returns and the accuracy of their direction."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.cdf import detectable_effect, wilson, z_against_half
from barloom.functions.safe import log_ratio, ratio, seconds, sign
from barloom.operators.bars import KEYS, order

GATES = ("A", "B", "C")
TIERS = {"primary": 0.95, "secondary": 0.70}
HORIZONS = (1, 3, 6, 12)


def with_gates(df: DataFrame, gap: int, n: int = 20, median_n: int = 50, valid: str = "is_valid_bar") -> DataFrame:
    """Session ids over valid rows (0 elsewhere), rolling z and median in the session, and d_A, d_B, d_C.

    Windows count the current row and must be full; a window without spread has no z; a gate is null where any part is.
    """
    ok = F.coalesce(F.col(valid), F.lit(False))
    before = F.last(F.when(ok, seconds("ts")), ignorenulls=True).over(order().rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(ok, F.coalesce((seconds("ts") - before > gap).cast("int"), F.lit(1))).otherwise(0)
    df = df.withColumn("session_id", F.when(ok, F.sum(fresh).over(order().rowsBetween(Window.unboundedPreceding, 0))).otherwise(F.lit(0)).cast("long"))
    rows = Window.partitionBy(*KEYS, "session_id").orderBy("ts")  # invalid rows have a session of their own

    def z(c: Column) -> Column:
        w = rows.rowsBetween(1 - n, 0)
        return F.when(ok & (F.count(c).over(w) == n), ratio(c - F.avg(c).over(w), F.nullif(F.stddev_samp(c).over(w), F.lit(0.0))))

    m = rows.rowsBetween(1 - median_n, 0)
    df = df.withColumn("z_imb", z(F.abs("imbalance_t"))).withColumn("z_conc", z(F.col("sign_concordance")))
    df = df.withColumn("der_median", F.when(ok & (F.count("der").over(m) == median_n), F.percentile("der", 0.5).over(m)))
    up = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))
    df = df.withColumn("d_A", up(F.col("z_imb"))).withColumn("d_B", up(F.col("z_imb") * F.col("z_conc")))
    return df.withColumn("d_C", F.col("d_B") * (F.col("der") > F.col("der_median")).cast("double"))


def with_forward(df: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Df with ``forward``, structs (horizon, fwd): log return h bars ahead in the same session, else null."""
    w = order()
    each = [F.struct(F.lit(h).alias("horizon"), F.when(F.lead("session_id", h).over(w) == F.col("session_id"), log_ratio(F.lead("close", h).over(w), F.col("close"))).alias("fwd")) for h in horizons]
    return df.withColumn("forward", F.array(*each))


def long_gates(df: DataFrame) -> DataFrame:
    """One row per bar and gate."""
    carried = ["forward"] if "forward" in df.columns else []
    return df.unpivot(["root", "instrument_id", "ts", "session_id", "close", "imbalance_t", *carried], [f"d_{g}" for g in GATES], "gate", "d").withColumn("gate", F.substring("gate", 3, 1))


def thresholds(gated: DataFrame, start: Column, end: Column, least: int | None = None) -> DataFrame:
    """Linear percentiles of the positive values in the warm-up period, by root and gate.

    With ``least``, any root and gate with fewer positive values there is an error. It is part of the threshold itself, so that
    it is raised whenever thresholds are read.
    """
    p = gated.filter((F.col("ts") >= start) & (F.col("ts") < end) & (F.col("d") > 0))
    tiers = [F.struct(F.lit(t).alias("tier"), F.percentile("d", q).alias("threshold")) for t, q in TIERS.items()]
    out = p.groupBy("root", "gate").agg(F.count("*").alias("n_pos"), F.array(*tiers).alias("t")).select("root", "gate", "n_pos", F.explode("t").alias("t"))
    threshold = F.col("t.threshold")
    if least is not None:
        few = F.raise_error(F.concat(F.lit("too few positive values to calibrate: "), "root", F.lit(" "), "gate")).cast("double")
        threshold = F.when(F.col("n_pos") < least, few).otherwise(threshold)
    return out.select("root", "gate", "n_pos", "t.tier", threshold.alias("threshold"))


def rising(gated: DataFrame, limits: DataFrame, start: Column, first_only: bool = True) -> DataFrame:
    """Bars where d reaches the threshold and the bar before, if of the same session, was under it.

    A null bar before in the same session is no edge; one of another session (invalid rows are session 0) is (E6).
    """
    j = gated.join(F.broadcast(limits), ["root", "gate"])
    w = Window.partitionBy("root", "gate", "tier", "instrument_id").orderBy("ts")
    same = F.lag("session_id").over(w) == F.col("session_id")
    before = F.when(F.coalesce(same, F.lit(False)), F.coalesce(F.lag("d").over(w) < F.col("threshold"), F.lit(False))).otherwise(True)
    e = j.withColumn("edge", (F.col("d") >= F.col("threshold")) & before).filter(F.col("edge") & (F.col("ts") >= start))
    if not first_only:
        return e.drop("edge")
    s = Window.partitionBy("root", "gate", "tier", "instrument_id", "session_id").orderBy("ts")
    return e.withColumn("_n", F.row_number().over(s)).filter("_n = 1").drop("_n", "edge")


def forward_returns(df: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(root, instrument_id, ts, horizon, fwd), as in with_forward."""
    return with_forward(df, horizons).select(*KEYS, "ts", F.explode("forward").alias("f")).select(*KEYS, "ts", "f.*")


def scored(events: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """events (with ``forward``) by horizon with ``hit``: 1 or 0 where both signs are known and not 0, else null."""
    both = events.withColumn("f", F.explode(F.filter("forward", lambda f: f["horizon"].isin(*horizons)))).select(*[c for c in events.columns if c != "forward"], "f.*")
    ok = F.col("fwd").isNotNull() & (sign("imbalance_t") != 0) & (sign("fwd") != 0)
    return both.withColumn("hit", F.when(ok, (sign("imbalance_t") == sign("fwd")).cast("int")))


def accuracy(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Events, scored, correct, accuracy, Wilson interval, z and detectable effect of each cell."""
    c = hits.groupBy(*keys).agg(F.count("*").alias("n_events"), F.count("hit").alias("n_scored"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_correct"))
    k, n = F.col("n_correct"), F.col("n_scored")
    lo, hi = wilson(k, n)
    return c.withColumns({"accuracy": F.try_divide(k, n), "wilson_lo": lo, "wilson_hi": hi, "z_vs_half": z_against_half(k, n), "mde_80pct": detectable_effect(n), "wilson_half": (hi - lo) / 2})


def binomial_draws(n: int, k: int, uniform: np.ndarray) -> np.ndarray:
    """Counts of ones in resamples of k ones among n: binomials by the inverse of their distribution."""
    if not 0 < k < n:
        return np.full(len(uniform), k)
    p = k / n
    reach = int(12 * math.sqrt(n * p * (1 - p)) + 12)  # what lies beyond is under 1e-15
    lo, hi = max(0, k - reach), min(n, k + reach)
    j = np.arange(lo, hi)
    steps = np.log((n - j) / (j + 1)) + math.log(p / (1 - p))  # from each count to the next
    mass = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.exp(mass - mass.max())
    return lo + np.searchsorted(np.cumsum(mass) / mass.sum(), uniform)


def bootstrap(hits: DataFrame, keys: list[str], replicates: int = 1000, seed: int = 7) -> DataFrame:
    """Mean and 95 % interval of resampled hit rates of each cell.

    Resampling n zeros and ones depends on their counts only, so that events are counted once and no event is copied; a cell
    draws its replicates where its counts are, from a seed of its own.
    """
    hit = F.col("hit").isNotNull()
    cells = hits.filter(hit).groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("hit").alias("_k"), F.xxhash64(*keys, F.lit(seed)).alias("_s"))

    def draw(frames):
        for frame in frames:
            means = [binomial_draws(n, k, np.random.default_rng(s & (1 << 63) - 1).random(replicates)) / n for n, k, s in zip(frame.pop("_n"), frame.pop("_k"), frame.pop("_s"))]
            ends = np.array([[m.mean(), *np.quantile(m, [0.025, 0.975])] for m in means]).reshape(-1, 3)
            yield frame.assign(boot_mean=ends[:, 0], boot_lo=ends[:, 1], boot_hi=ends[:, 2])

    kinds = dict(cells.dtypes)
    return cells.mapInPandas(draw, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", boot_mean double, boot_lo double, boot_hi double")


def event_counts(events: DataFrame, df: DataFrame, start: Column, strict: bool = False) -> DataFrame:
    """Events a month (mean and deviation over all months, empty ones too) and the share of sessions with one.

    Sessions of the evaluation period include 0, the id of invalid rows (E7), unless ``strict``.
    """
    ev = df.filter(F.col("ts") >= start)
    key = F.struct("instrument_id", "session_id") if strict else F.struct(F.when(F.col("session_id") > 0, F.col("instrument_id")).alias("i"), "session_id")
    ses = ev.filter("session_id > 0") if strict else ev
    spine = ev.groupBy("root").agg(F.date_trunc("MONTH", F.max("ts")).alias("last")).select("root", F.explode(F.sequence(F.date_trunc("MONTH", start.cast("timestamp")).cast("date"), F.col("last").cast("date"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    cells = events.select("root", "gate", "tier").distinct()
    n = events.groupBy("root", "gate", "tier", F.date_trunc("MONTH", "ts").cast("date").alias("month")).agg(F.count("*").alias("n"))
    by_month = cells.join(spine, "root").join(n, ["root", "gate", "tier", "month"], "left").fillna(0, ["n"])
    per = by_month.groupBy("root", "gate", "tier").agg(F.sum("n").alias("n_events"), F.avg("n").alias("per_month_mean"), F.stddev_samp("n").alias("per_month_std"))
    total = ses.groupBy("root").agg(F.count_distinct(key).alias("total_eval_sessions"))
    hit = events.groupBy("root", "gate", "tier").agg(F.count_distinct("instrument_id", "session_id").alias("with_event"))
    return per.join(total, "root").join(hit, ["root", "gate", "tier"]).withColumn("frac_sessions", F.col("with_event") / F.col("total_eval_sessions")).drop("with_event")


def sanity(df: DataFrame, start: Column, n: int = 20) -> DataFrame:
    """The first n evaluation sessions of each root and their ungated accuracy."""
    ev = df.filter((F.col("ts") >= start))
    first = ev.groupBy("root", "instrument_id", "session_id").agg(F.min("ts").alias("t0"))
    kept = first.withColumn("_n", F.row_number().over(Window.partitionBy("root").orderBy("instrument_id", "t0"))).filter(F.col("_n") <= n)
    base = ev.join(kept.select("root", "instrument_id", "session_id"), ["root", "instrument_id", "session_id"], "left_semi")
    return accuracy(scored(base, (1,)), ["root"])


def cross_cutting(cells: DataFrame) -> DataFrame:
    """Accuracy of B over A, C over B, and primary over secondary, from cells (gate, tier, accuracy, n_events)."""
    g = cells.groupBy("tier").pivot("gate", list(GATES)).agg(F.first("accuracy").alias("acc"), F.first("n_events").alias("n"))
    gates = g.select(F.concat(F.lit("gates "), "tier").alias("what"), (F.col("B_acc") - F.col("A_acc")).alias("first"), (F.col("C_acc") - F.col("B_acc")).alias("second"), F.try_divide("C_n", "A_n").alias("ratio"))
    t = cells.groupBy("gate").pivot("tier", list(TIERS)).agg(F.first("accuracy").alias("acc"), F.first("n_events").alias("n"))
    return gates.unionByName(t.select(F.concat(F.lit("tiers "), "gate").alias("what"), (F.col("primary_acc") - F.col("secondary_acc")).alias("first"), F.lit(None).cast("double").alias("second"), F.try_divide("primary_n", "secondary_n").alias("ratio")))


def best(cells: DataFrame, z: float = 1.96, least: int = 100) -> DataFrame:
    """The most accurate cell that is significant and large enough, else the most accurate."""
    fine = ((F.col("z_vs_half") >= z) & (F.col("n_scored") >= least)).cast("int")
    return cells.orderBy(F.coalesce(fine, F.lit(0)).desc(), F.col("accuracy").desc_nulls_last(), *[c for c in ("gate", "tier", "horizon") if c in cells.columns]).limit(1)


def horizon_decay(cells: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Pooled accuracy by horizon."""
    return cells.groupBy("gate", "tier").pivot("horizon", list(horizons)).agg(F.first("accuracy"))
