"""Flow classification and bar features: z-scores, buy fractions, sub-bar and geometry features, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.cdf import normal_cdf, signed_imbalance, student_t_cdf, t_constant
from barloom.functions.safe import col, finite, log, log_ratio, ratio, sign
from barloom.functions.smoothing import ewma
from barloom.operators.bars import (
    GAP, KEYS, SPAN, WARMUP, bar_return, close_return, full, order, parent_bars, sigma_concurrent, sigma_session, trailing, with_yang_zhang,
)

Z_LIMIT = 50.0
FLOW_FEATURES = ("der", "sign_concordance", "subbar_imbalance", "clv_mean", "clv_var", "imbalance_t", "z")
GEOMETRY = ("sigma_yz", "body_to_range", "gel_fraction", "wick_asymmetry", "amihud", "ko_W", "polar_order_P")


def z_score(sigma: str | Column = "sigma") -> Column:
    """Bar return in units of sigma."""
    return ratio(bar_return(), sigma)


def clean_z(df: DataFrame, z: str = "z") -> DataFrame:
    """Rows with a finite z of less than 50 in size."""
    return df.filter(finite(z).isNotNull() & (F.abs(z) < Z_LIMIT))


def parameter_table(spark, rows: list[tuple]) -> DataFrame:
    """(root, nu, loc, scale) as a table with each row's density constant; ready to broadcast."""
    return spark.createDataFrame([(r, float(n), float(m), float(s), t_constant(n)) for r, n, m, s in rows], "root string, nu double, loc double, scale double, t_c double")


def buy_fraction(z: str | Column) -> Column:
    """C3 by the row's parameters (nu, loc, scale, t_c); an infinite z, which only a price of 0 gives, has none: NaN."""
    z = col(z)
    return F.when(F.abs(z) == float("inf"), float("nan")).otherwise(student_t_cdf(z, F.col("nu"), F.col("loc"), F.col("scale"), F.col("t_c")))


def with_flow(df: DataFrame, parameters: DataFrame, z: str = "z") -> DataFrame:
    """v_buy_t and imbalance_t by the root's parameters."""
    df = df.join(F.broadcast(parameters), "root", "left")
    return df.withColumn("v_buy_t", buy_fraction(z)).withColumn("imbalance_t", signed_imbalance("v_buy_t"))


def gaussian_flow(z: str | Column = "z") -> Column:
    """C4: buy fraction under the normal law."""
    return normal_cdf(z)


def directional_efficiency() -> Column:
    """The bar's return against the path of its sub-bars."""
    path = F.col("sum_abs_ret") + F.greatest("median_abs_ret", F.lit(1e-8))
    r = F.abs("log_ret") / path
    return F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(0.0)), F.lit(1.0)))


def subbar_features(sub: DataFrame, parameters: DataFrame, minutes: int, sigma_mode: str = "session", span: int = SPAN, warmup: int = WARMUP, gap: int = GAP) -> DataFrame:
    """X7 (with X1 to X6): parent bars with sigma, flow, concordance and the imbalance of their sub-bars.

    sigma_mode ``session`` keeps warm-up rows; ``concurrent`` drops rows without z. A sub-bar's return is divided by
    its parent's sigma. A parent carries its sub-bars as an array through the windows and is put together again in the
    windows' own partitioning, so that there is one scan, no join and no further exchange.
    """
    parents = parent_bars(sub, minutes, subs=True).withColumn("log_ret", bar_return())
    if sigma_mode == "session":
        parents = sigma_session(parents, span, warmup, gap, "sigma_gk")
    else:
        parents = sigma_concurrent(parents, span, name="sigma_gk")
    parents = with_flow(parents.withColumn("z", z_score("sigma_gk")), parameters).withColumn("der", directional_efficiency())
    kept = [c for c in parents.columns if c not in (*KEYS, "ts", "subs", "nu", "loc", "scale", "t_c")]
    each = parents.withColumn("_s", F.explode_outer("subs")).withColumns({"_r": F.col("_s.r"), "_v": F.col("_s.volume")}).drop("subs", "_s")
    known = F.col("log_ret").isNotNull() & F.col("sigma_gk").isNotNull() & F.col("_r").isNotNull()
    same = F.when(F.col("log_ret") == 0, 0.5).otherwise((sign("_r") == sign("log_ret")).cast("double"))
    tilt = signed_imbalance(buy_fraction(ratio("_r", "sigma_gk")))
    out = each.groupBy(*KEYS, "ts").agg(
        *[F.first(c).alias(c) for c in kept], F.avg(F.when(known, same)).alias("sign_concordance"), F.try_divide(F.sum(F.when(known, tilt * F.col("_v"))), F.sum(F.when(known, F.col("_v")))).alias("subbar_imbalance")
    )
    out = out.withColumn("vol_skew", F.lit(None).cast("double")).withColumn("real_kurt", F.lit(None).cast("double"))
    return out if sigma_mode == "session" else out.dropna(subset=["z", "sigma_gk"])


def confidence_weights(c: str | Column = "sign_concordance", d: str | Column = "der") -> dict[str, Column]:
    """Three ways to weigh imbalance by concordance and efficiency."""
    c, d = col(c), col(d)
    return {"conservative": (0.5 + 0.5 * c) * (0.5 + 0.5 * d), "moderate": c * (0.5 + 0.5 * d), "aggressive": c * d}


def validity(df: DataFrame, regime_starts: DataFrame, gated: tuple[str, ...] = ("v_buy_t", "imbalance_t", "subbar_imbalance")) -> DataFrame:
    """is_valid_bar, false and with its flow columns nulled before the root's regime start (root, regime_start)."""
    df = df.join(F.broadcast(regime_starts), "root", "left")
    early = F.coalesce(F.col("ts") < F.col("regime_start"), F.lit(False))
    df = df.withColumn("is_valid_bar", F.col("warmup_valid") & F.col("sigma_gk").isNotNull() & ~early)
    return df.select(*[F.when(~early, F.col(c)).alias(c) if c in gated else F.col(c) for c in df.columns if c != "regime_start"])


def training_window(df: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """is_train_valid_bar, valid from the root's cutoff on (root, cutoff)."""
    df = df.join(F.broadcast(cutoffs), "root", "left")
    return df.withColumn("is_train_valid_bar", F.col("is_valid_bar") & F.coalesce(F.col("ts") >= F.col("cutoff"), F.lit(False))).drop("cutoff")


def _span() -> Column:
    return F.col("high") - F.col("low")


def body_to_range() -> Column:
    """X11."""
    whole = F.col("open").isNotNull() & F.col("close").isNotNull() & _span().isNotNull()
    return F.when(whole, F.coalesce(F.abs(F.col("close") - F.col("open")) / F.nullif(_span(), F.lit(0.0)), F.lit(0.0)))


def gel_fraction() -> Column:
    """Distance of the close from the middle, in ranges."""
    whole = F.col("close").isNotNull() & _span().isNotNull()
    return F.when(whole, F.coalesce(F.abs(F.col("close") - (F.col("high") + F.col("low")) / 2) / F.nullif(_span(), F.lit(0.0)), F.lit(0.0)))


def wick_asymmetry() -> Column:
    """X13."""
    body = F.col("open").isNotNull() & F.col("close").isNotNull()
    return F.when(body, log_ratio("high", F.greatest("open", "close")) - log_ratio(F.least("open", "close"), "low"))


def amihud() -> Column:
    """Absolute close-to-close return per unit of volume."""
    return F.when(F.col("volume") > 0, F.abs(close_return()) / F.nullif(F.col("volume").cast("double"), F.lit(0.0)))


def polar_order(n: int = 50) -> Column:
    """The share by which one sign outweighs the other in n returns; an instrument's first counts as 0."""
    return F.abs(full(F.sum, F.col("_sign"), trailing(n), n)) / n


def geometry(df: DataFrame, sigma: str = "sigma_gk", yz_bars: int = 20, polar_bars: int = 50) -> DataFrame:
    """X11 to X16 and V9 as columns."""
    df = with_yang_zhang(df, yz_bars).withColumn("_sign", sign(F.coalesce(close_return(), F.lit(0.0))))
    return (
        df.withColumn("body_to_range", body_to_range()).withColumn("gel_fraction", gel_fraction()).withColumn("wick_asymmetry", wick_asymmetry())
        .withColumn("amihud", amihud()).withColumn("ko_W", F.col(sigma) * F.col("close") * F.col("volume")).withColumn("polar_order_P", polar_order(polar_bars)).drop("_sign")
    )


def scaled_imbalance(df: DataFrame, imbalance: str = "imbalance_t", span: int = 10) -> DataFrame:
    """|imbalance| over the recursive mean of its daily means, by instrument."""
    day = F.date_trunc("DAY", "ts").cast("date")
    daily = df.filter(F.col(imbalance).isNotNull()).groupBy(*KEYS, day.alias("day")).agg(F.avg(F.abs(imbalance)).alias("mean_abs"))
    daily = ewma(daily, F.col("mean_abs"), "usual", KEYS, ["day"], span, adjust=False).select(*KEYS, "day", "usual")
    out = df.withColumn("day", day).join(daily, [*KEYS, "day"], "left")
    return out.withColumn("v_star_C", ratio(F.abs(imbalance), F.nullif(F.col("usual"), F.lit(0.0)))).drop("day", "usual")


def masked(df: DataFrame, columns: tuple[str, ...] = GEOMETRY, valid: str = "is_valid_bar") -> DataFrame:
    """Features nulled on bars that aren't valid."""
    return df.select(*[F.when(F.col(valid), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, deviation, P05, P95 and share of nulls of each feature, by root."""
    long = df.unpivot(["root"], columns, "feature", "value")
    return long.groupBy("root", "feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.percentile("value", 0.05).alias("p05"), F.percentile("value", 0.95).alias("p95"), F.avg(F.col("value").isNull().cast("double")).alias("null_share")
    )


def vpin(imbalance: str = "imbalance_t", n: int = 20) -> Column:
    """Mean |imbalance| of n bars."""
    return full(F.avg, F.abs(imbalance), trailing(n), n)


def har_lags(df: DataFrame, sigma: str = "sigma_gk", short: int = 12, long: int = 60) -> DataFrame:
    """The last sigma, and its means over two longer stretches."""
    past = F.lag(sigma).over(order())
    df = df.withColumn("sigma_lag1", past)
    return df.withColumn("sigma_short", full(F.avg, F.col("sigma_lag1"), trailing(short), short)).withColumn("sigma_long", full(F.avg, F.col("sigma_lag1"), trailing(long), long))


def forward_target(df: DataFrame, horizon: int = 12, name: str = "target_log_sigma_rv") -> DataFrame:
    """Half the log of the summed squared close-to-close returns of the next bars."""
    ahead = order().rowsBetween(1, horizon)
    df = df.withColumn("_r2", F.pow(close_return(), F.lit(2.0)))
    return df.withColumn(name, 0.5 * log(full(F.sum, F.col("_r2"), ahead, horizon))).drop("_r2")


def feature_table(sub: DataFrame, parameters: DataFrame, regime_starts: DataFrame, cutoffs: DataFrame, minutes: int, span: int = SPAN, warmup: int = WARMUP, gap: int = GAP) -> DataFrame:
    """X7 to X18 in one lazy plan: sub-bars to the masked feature table."""
    df = subbar_features(sub, parameters, minutes, "session", span, warmup, gap)
    return training_window(masked(geometry(validity(df, regime_starts))), cutoffs)
