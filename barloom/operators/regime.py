"""Windows, segments, cutoffs and what is fitted on them. Interval tables are small and broadcast. Windows between month
starts are differences of running monthly histograms: rows are counted once, and what enters a fit is bins x windows.
Segments with other bounds are fitted from rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.cdf import student_t_cdf, two_sided_t
from barloom.operators.fitting import clean_z, fit_student_t, with_constants
from barloom.sources.stage import staged


def month_spine(spark, start: str, end: str) -> DataFrame:
    """Month starts in [start, end)."""
    days = F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1), F.expr("INTERVAL 1 MONTH"))
    return spark.range(1).select(F.explode(days).alias("month"))


def rolling_windows(bounds: DataFrame, years: int = 3, step_months: int = 3) -> DataFrame:
    """(root, window_start, window_end, center) from each root's first and last day (root, first_day, last_day)."""
    starts = F.sequence("first_day", "last_day", F.expr(f"INTERVAL {step_months} MONTH"))
    w = bounds.select("root", "last_day", F.explode(starts).alias("window_start")).withColumn("window_end", F.add_months("window_start", 12 * years))
    w = w.filter(F.col("window_end") <= F.date_add("last_day", 1)).drop("last_day")
    return w.withColumn("center", F.date_add("window_start", F.floor(F.datediff("window_end", "window_start") / 2).cast("int")))


def in_intervals(df: DataFrame, intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with every interval (root, start, end) that holds their ts; either bound may be null."""
    i = F.broadcast(intervals.withColumnRenamed("root", "_root"))
    inside = (F.col("root") == F.col("_root")) & (F.col(start).isNull() | (F.col("ts") >= F.col(start))) & (F.col(end).isNull() | (F.col("ts") < F.col(end)))
    return df.join(i, inside).drop("_root")


#: Width of a bin of z. The empirical distribution is exact at the bins' edges; between them a Kolmogorov distance can rise
#: by what a bin holds, under 0.001 for densities up to one half.
WIDTH = 0.002


def monthly_histogram(df: DataFrame, width: float = WIDTH, z: str = "z") -> DataFrame:
    """(root, month, bin, n, s): counts and sums of clean z in bins by month (a date)."""
    c = clean_z(df, z)
    return c.groupBy("root", F.trunc(F.col("ts").cast("date"), "MM").alias("month"), F.floor(F.col(z) / width).alias("bin")).agg(F.count("*").alias("n"), F.sum(z).alias("s"))


def running_histogram(df: DataFrame, width: float = WIDTH, z: str = "z") -> DataFrame:
    """(root, bin, steps): for each bin the running (month, n, s), in order of months."""
    w = Window.partitionBy("root", "bin").orderBy("month")
    h = monthly_histogram(df, width, z).withColumns({c: F.sum(c).over(w) for c in ("n", "s")})
    return h.groupBy("root", "bin").agg(F.array_sort(F.collect_list(F.struct("month", "n", "s"))).alias("steps"))


def window_bins(running: DataFrame, windows: DataFrame, start: str, end: str) -> DataFrame:
    """running x windows of its root: the columns of windows, bin, n and z (the mean in the bin); windows from one month
    start to before another, either may be null."""

    def before(m: Column) -> Column:
        last = F.try_element_at(F.filter("steps", lambda x: x["month"] < m.cast("date")), F.lit(-1))
        return F.struct(F.coalesce(last["n"], F.lit(0)).alias("n"), F.coalesce(last["s"], F.lit(0.0)).alias("s"))

    none, whole = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s")), F.element_at("steps", -1)
    j = running.join(F.broadcast(windows), "root")
    j = j.withColumn("_a", F.when(F.col(start).isNull(), none).otherwise(before(F.col(start)))).withColumn("_b", F.when(F.col(end).isNull(), F.struct(whole["n"].alias("n"), whole["s"].alias("s"))).otherwise(before(F.col(end))))
    n = F.col("_b.n") - F.col("_a.n")
    return j.withColumn("n", n).filter("n > 0").withColumn("z", F.try_divide(F.col("_b.s") - F.col("_a.s"), F.col("n"))).drop("steps", "_a", "_b")


def window_fits(df: DataFrame, windows: DataFrame, start: str, end: str, labels: list[str], minimum: int = 1000, binned: bool = False) -> DataFrame:
    """A fit for each interval; with ``binned``, from running histograms (bounds at month starts)."""
    if binned:
        off = windows.filter(" OR ".join(f"{c} <> date_trunc('MONTH', {c})" for c in (start, end)))
        if not off.isEmpty():
            raise ValueError("binned windows begin and end at month starts")
        rows = window_bins(running_histogram(df, 0.02), windows, start, end)
    else:
        rows = in_intervals(clean_z(df).select("root", "ts", "z", F.lit(1).alias("n")), windows, start, end)
    return fit_student_t(rows.withColumnRenamed("n", "w"), labels, "z", "w", minimum)


def edge_diagnostics(bins: DataFrame, fits: DataFrame, keys: list[str], width: float = WIDTH) -> DataFrame:
    """(keys, total, ks, shoulder) of bins (keys, bin, n) under the fits (keys, nu, loc, scale): F2 and F5 at the edges of the bins."""
    t = with_constants(fits.filter("nu IS NOT NULL")).select(*keys, "nu", "loc", "scale", "t_c")
    w = Window.partitionBy(*keys)
    up, total = F.sum("n").over(w.orderBy("bin")), F.sum("n").over(w)
    rows = bins.select(*keys, "bin", "n").withColumn("_up", up / total).withColumn("_down", (up - F.col("n")) / total).withColumn("total", total)
    p = lambda x: student_t_cdf(x, F.col("nu"), F.col("loc"), F.col("scale"), F.col("t_c"))
    lo, hi = F.col("bin") * width, (F.col("bin") + 1) * width
    rows = rows.join(F.broadcast(t), keys)
    off = F.greatest(F.abs(F.col("_up") - p(hi)), F.abs(F.col("_down") - p(lo)))
    band = F.abs(hi).between(1.0, 3.0)
    return rows.groupBy(*keys).agg(F.first("total").alias("total"), F.max(off).alias("ks"), F.max(F.when(band, F.abs(F.col("_up") - p(hi)))).alias("shoulder"))


def break_scan(df: DataFrame, cutoffs: DataFrame, minimum: int = 50) -> DataFrame:
    """Pre and post fits of each cutoff (cutoff, a month start), their count-weighted distance, and the rule's winner."""
    keys = ["root", "cutoff", "side"]
    none = F.lit(None).cast("timestamp_ntz")
    at = df.select("root").distinct().crossJoin(F.broadcast(cutoffs))  # roots x cutoffs
    sides = F.array(F.struct(F.lit("pre").alias("side"), none.alias("s"), F.col("cutoff").alias("e")), F.struct(F.lit("post").alias("side"), F.col("cutoff").alias("s"), none.alias("e")))
    windows = at.select("root", "cutoff", F.explode(sides).alias("w")).select("root", "cutoff", "w.*")
    bins = staged(window_bins(running_histogram(df), windows, "s", "e"))
    fits = staged(fit_student_t(bins.withColumn("w", F.col("n")), keys, "z", "w", minimum))
    d = fits.join(edge_diagnostics(bins, fits, keys), keys, "left")
    wide = d.groupBy("root", "cutoff").pivot("side", ["pre", "post"]).agg(F.first("nu").alias("nu"), F.first("scale").alias("scale"), F.first("n").alias("n"), F.first("ks").alias("ks"), F.first("shoulder").alias("shoulder"))
    wide = wide.withColumn("ks_combined", (F.col("pre_n") * F.col("pre_ks") + F.col("post_n") * F.col("post_ks")) / (F.col("pre_n") + F.col("post_n")))
    for s in ("pre", "post"):
        wide = wide.withColumn(f"{s}_passes", (F.col(f"{s}_ks") < 0.05) & (F.col(f"{s}_shoulder") < 0.01))
    first = F.row_number().over(Window.partitionBy("root").orderBy(F.col("ks_combined").asc_nulls_last(), "cutoff"))
    return wide.withColumn("winner", first == 1)


def excluded_middle(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """Rows and share between two breakpoints."""
    out = (F.col("ts") >= first) & (F.col("ts") < second)
    return df.groupBy("root").agg(F.count("*").alias("n"), F.count_if(out).alias("excluded")).withColumn("excluded_pct", F.col("excluded") * 100.0 / F.col("n"))


def trend(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, r and two-sided p of a line through three points at least."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r")).filter("n >= 3")
    t = F.abs(F.col("r")) * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0)))
    straight = F.abs(F.col("r")) >= 1
    return d.withColumn("p", F.when(straight, 0.0).otherwise(two_sided_t(t, F.col("n") - 2)))


def monthly_ks(df: DataFrame, fits: DataFrame, minimum: int = 500) -> DataFrame:
    """The distance of each month under the fit of each (root, cutoff) before it; null below the minimum."""
    keys = ["root", "cutoff", "month"]
    months = monthly_histogram(df).join(F.broadcast(fits.select("root", "cutoff")), "root").filter(F.col("month") >= F.col("cutoff").cast("date"))  # bins x cutoffs
    table = months.select(*keys).distinct().join(F.broadcast(fits.select("root", "cutoff", "nu", "loc", "scale")), ["root", "cutoff"])
    d = edge_diagnostics(months, table, keys)
    return d.select(*keys, F.col("total").alias("n"), F.when(F.col("total") >= minimum, F.col("ks")).alias("ks"))


def sweep(df: DataFrame, cutoffs: DataFrame, locked: DataFrame, minimum: int = 1000) -> DataFrame:
    """(root, cutoff, nu, loc, scale, n, ks, nu_delta) of the rows from each cutoff (root, cutoff) on; locked: (root, nu)."""
    keys = ["root", "cutoff"]
    windows = cutoffs.select(*keys).withColumn("_end", F.lit(None).cast("timestamp_ntz"))
    bins = staged(window_bins(running_histogram(df), windows, "cutoff", "_end"))
    fits = staged(fit_student_t(bins.withColumn("w", F.col("n")), keys, "z", "w", minimum))
    out = fits.join(edge_diagnostics(bins, fits, keys).select(*keys, "ks"), keys, "left")
    return out.join(F.broadcast(locked.select("root", F.col("nu").alias("_nu"))), "root").withColumn("nu_delta", F.col("nu") - F.col("_nu")).drop("_nu")


def first_acceptable(sweep: DataFrame, months: DataFrame, nu_limit: float = 0.15, ks_limit: float = 0.05, month_limit: float = 0.08) -> DataFrame:
    """The earliest cutoff whose fit and every month pass; sweep: (root, cutoff, nu_delta, ks)."""
    fine = months.groupBy("root", "cutoff").agg(F.bool_and(F.coalesce(F.col("ks") <= month_limit, F.lit(True))).alias("months_ok"))
    s = sweep.join(fine, ["root", "cutoff"], "left").filter((F.abs("nu_delta") <= nu_limit) & (F.col("ks") <= ks_limit) & F.coalesce("months_ok", F.lit(True)))
    return s.groupBy("root").agg(F.min("cutoff").alias("cutoff"))


def rejections(months: DataFrame, month_limit: float = 0.08) -> DataFrame:
    """The worst month of each cutoff."""
    return months.groupBy("root", "cutoff").agg(F.max_by("month", "ks").alias("worst_month"), F.max("ks").alias("worst_ks")).withColumn("passes", F.coalesce(F.col("worst_ks") <= month_limit, F.lit(True)))


def refit_triggers(fits: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Fits against a threshold table (root, nu_floor, ks_limit, scale_low, scale_high)."""
    t = fits.join(F.broadcast(thresholds), "root")
    return t.select(*fits.columns, (F.col("nu") < F.col("nu_floor")).alias("nu_low"), (F.col("ks") > F.col("ks_limit")).alias("ks_high"), (~F.col("scale").between(F.col("scale_low"), F.col("scale_high"))).alias("scale_drift"))
