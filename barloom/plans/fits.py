"""Registered queries over fits, diagnostics, regimes and feature validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.safe import rounded
from barloom.operators import bars as B
from barloom.operators import fitting as Q
from barloom.operators import flow as X
from barloom.operators import regime as R
from barloom.operators import validation as V
from barloom.plans.market import BARS, _ewma, FEATURES, features, GAP, GK, main_bars, phi, ROOTS, SIGMA, sigma_bars, SPAN, TCDF, W, WARM
from barloom.sources.stage import staged
from barloom.sources.tables import line_ticks, order_ticks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def z_rows(spark, d) -> DataFrame:
    return X.clean_z(sigma_bars(spark, d)).select("root", "instrument_id", "ts", "z")


def order_z(spark, d) -> DataFrame:
    """Daily bars of orders over seven years: one root, five instruments."""
    df = B.sigma_causal(B.bars(order_ticks(spark, d), 1440), SPAN)
    return X.clean_z(df.withColumn("z", B.close_return() / F.nullif(F.col("sigma"), F.lit(0.0)))).select("root", "instrument_id", "ts", "z")


def locked(spark, *keys: str) -> DataFrame:
    return spark.createDataFrame([(r, 4.0, 0.01, 0.85, 0) for r in (*ROOTS, "orders")], "root string, nu double, loc double, scale double, n long")


ZQ = SIGMA + f", c AS (SELECT * FROM z WHERE abs(z) < 50), p AS (SELECT *, {TCDF} AS pr FROM (SELECT *, (z - 0.01) / 0.85 AS u FROM c)), r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY pr) AS k, count(*) OVER (PARTITION BY root) AS n FROM p)"


@query(
    "f2_f3_f5_pit",
    ZQ + """, a AS (SELECT root, count(*) AS n, max(greatest(k / n - pr, pr - (k - 1) / n)) AS ks, avg((pr < 0.1)::INT) * 10 AS lt, avg((pr > 0.9)::INT) * 10 AS rt, avg((pr > 0.4 AND pr < 0.6)::INT) * 5 AS mid, max(abs(k / n - pr)) FILTER (abs(z) BETWEEN 1 AND 3) AS sh FROM r GROUP BY root)
SELECT root, n, round(ks, 6) AS ks, round(lt, 6) AS left_tail, round(rt, 6) AS right_tail, round(mid, 6) AS mid, round(sh, 6) AS shoulder_rank, CASE WHEN (lt + rt) / 2 > mid * 1.03 THEN 'U-shape' WHEN mid > (lt + rt) / 2 * 1.03 THEN 'Hump' ELSE 'Flat' END AS shape FROM a""",
)
def f2(spark, d):
    return rounded(Q.pit_diagnostics(z_rows(spark, d), locked(spark), ["root"]).select("root", "n", "ks", "left_tail", "right_tail", "mid", "shoulder_rank", "shape"))


@query("f1_student_t_fit")
def f1(spark, d):
    return rounded(Q.fit_student_t(z_rows(spark, d), ["root"]), 5)


@query("f2_monthly_p")
def f2_months(spark, d):
    """Months of each instrument under locked parameters: few values each, so that probabilities are exact."""
    z = order_z(spark, d).withColumn("month", F.trunc(F.col("ts").cast("date"), "MM"))
    keys = ["root", "instrument_id", "month"]
    table = staged(z.select(*keys).distinct()).join(F.broadcast(locked(spark).drop("n")), "root")
    return rounded(Q.with_exact_p(Q.pit_diagnostics(z, table, keys)).select(*keys, "n", "ks", "ks_p"))


@query(
    "f4_shoulder",
    ZQ + f""", rk AS (SELECT root, z, k, n, lead(z) OVER (PARTITION BY root ORDER BY k) AS ahead FROM r), gx AS (SELECT root, side, CASE side WHEN 'right' THEN 1.0 ELSE -3.0 END + i * 2.0 / 499 AS x FROM (SELECT DISTINCT root FROM r), (SELECT unnest(range(0, 500)) AS i), (SELECT unnest(['right', 'left']) AS side)),
gi AS (SELECT gx.root, side, CASE WHEN k IS NULL THEN 0.0 WHEN ahead IS NULL THEN CASE WHEN x > z THEN 1.0 ELSE k / (n + 1) END ELSE (k + coalesce((x - z) / nullif(ahead - z, 0), 0)) / (n + 1) END AS ec, (x - 0.01) / 0.85 AS u FROM gx ASOF LEFT JOIN rk ON gx.root = rk.root AND gx.x >= rk.z),
gd AS (SELECT root, max(abs(ec - {TCDF})) FILTER (side = 'right') AS a, max(abs(ec - {TCDF})) FILTER (side = 'left') AS b FROM gi GROUP BY root)
SELECT root, round(a, 6) AS max_dev_right, round(b, 6) AS max_dev_left, greatest(a, b) < 0.01 AS passes FROM gd""",
)
def f4(spark, d):
    return rounded(Q.shoulder(z_rows(spark, d), locked(spark), ["root"]))


@query("f6_split_half")
def f6(spark, d):
    return rounded(Q.split_half(z_rows(spark, d), ["root"]), 4)


@query(
    "f7_skew_buckets",
    SIGMA + """, b AS (SELECT root, z, CASE WHEN abs(z) < 1 THEN '0-1' WHEN abs(z) < 2 THEN '1-2' WHEN abs(z) < 3 THEN '2-3' WHEN abs(z) < 5 THEN '3-5' ELSE '5+' END AS band FROM z WHERE abs(z) < 50),
m AS (SELECT root, band, z, avg(z) OVER (PARTITION BY root, band) AS mu FROM b)
SELECT root, band, count(*) AS n, CASE WHEN count(*) >= 30 THEN round(avg((z - mu) ** 3) / pow(avg((z - mu) ** 2), 1.5), 6) + 0 END AS skew FROM m GROUP BY ALL""",
)
def f7(spark, d):
    return rounded(Q.skew_buckets(z_rows(spark, d), ["root"]))


def variants(spark, d) -> DataFrame:
    df = B.sigma_causal(B.sigma_concurrent(main_bars(spark, d), SPAN, name="sigma_a"), SPAN, name="sigma_b")
    df = B.sigma_ewm(df, SPAN, name="sigma_c")
    return df.withColumn("z_a", X.z_score("sigma_a")).withColumn("z_b", X.z_score("sigma_b")).withColumn("z_c", X.z_score("sigma_c"))


#: va: concurrent and causal sigma of each bar, with the z of either.
VARIANTSQL = BARS + ", " + _ewma(GK, "root", SPAN, "bar", "g1", 10, "sigma_a") + ", g2 AS (SELECT * EXCLUDE (x0, i) FROM g1), " + _ewma(f"lag({GK}) OVER ({W})", "root", SPAN, "g2", "g3", 10, "sigma_b") + """,
va AS (SELECT root, ts, sigma_a, sigma_b, ln(close / open) / nullif(sigma_a, 0) AS z_a, ln(close / open) / nullif(sigma_b, 0) AS z_b FROM g3)"""


def _skew(z: str) -> str:
    return f"(SELECT root, avg((v - mu) ** 3) / pow(avg((v - mu) ** 2), 1.5) AS skew FROM (SELECT root, {z} AS v, avg({z}) OVER (PARTITION BY root) AS mu FROM va WHERE {z} IS NOT NULL) GROUP BY root)"


@query(
    "f8_f9_variants",
    VARIANTSQL + f""", c AS (SELECT root, count(*) AS n, corr(z_a, z_b) AS corr, corr(sigma_a, sigma_b) AS corr_sigma, min(z_a) AS min_a, max(z_a) AS max_a, min(z_b) AS min_b, max(z_b) AS max_b, count(*) FILTER (abs(z_a) > 5) AS extreme_a, count(*) FILTER (abs(z_b) > 5) AS extreme_b
FROM va WHERE z_a IS NOT NULL AND z_b IS NOT NULL GROUP BY root), s AS (SELECT c.*, a.skew AS skew_a, b.skew AS skew_b FROM c JOIN {_skew("z_a")} a USING (root) JOIN {_skew("z_b")} b USING (root))
SELECT root, n, extreme_a, extreme_b, """ + ", ".join(f"round({c}, 6) + 0 AS {c}" for c in ("corr", "corr_sigma", "min_a", "max_a", "min_b", "max_b", "skew_a", "skew_b")) + """,
 CASE WHEN sign(skew_a) <> sign(skew_b) THEN 'sign flip' WHEN abs(skew_a - skew_b) > 0.3 THEN 'changed' WHEN abs(skew_a) > 0.3 AND abs(skew_b) > 0.3 THEN 'persistent' ELSE 'moderate' END AS verdict FROM s""",
)
def f8(spark, d):
    v = variants(spark, d)
    still = lambda c: F.coalesce(F.skewness(c), F.lit(float("nan")))  # noqa: E731  equal values have no skewness
    skew = v.groupBy("root").agg(still("z_a").alias("skew_a"), still("z_b").alias("skew_b"))
    return rounded(Q.compare_variants(v, ["root"], "z_a", "z_b", "sigma_a", "sigma_b").join(skew, "root").withColumn("verdict", Q.skew_verdict(F.col("skew_a"), F.col("skew_b"))))


VARIANTS = {"concurrent": "z_a", "causal": "z_b", "baseline": "z_c"}


@query("f8_variant_fits")
def f8_fits(spark, d):
    return rounded(Q.fit_variants(variants(spark, d), ["root"], VARIANTS), 4)


@query("f11_calibration")
def f11(spark, d):
    return rounded(Q.calibration(variants(spark, d), ["root"], {"ewma": "z_c", "garman_klass": "z_b"}), 4)


@query("f10_f19_parameter_shift")
def f10(spark, d):
    return rounded(Q.shift(Q.fit_student_t(z_rows(spark, d), ["root"]), locked(spark), ["root"]), 4)


@query("f12_f18_yearly_bundle")
def f12(spark, d):
    return rounded(Q.bundle(order_z(spark, d).withColumn("year", F.year("ts")), ["root", "year"]), 4)


WARMUPS = [5, 10, 20]


def grid(spark, d) -> DataFrame:
    return Q.sensitivity_grid(Q.with_gaps(main_bars(spark, d), [3600, 7200, 14400], SPAN, 5), WARMUPS)


@query("f13_f14_sensitivity_grid")
def f13(spark, d):
    return rounded(Q.grid_cells(grid(spark, d), ["root"]).select("root", "gap", "warmup", "nu", "n", "ks", "max_dev_right", "max_dev_left", "f2", "spread", "plateau"), 4)


@query("f15_grid_pivot")
def f15(spark, d):
    return rounded(Q.grid_pivots(Q.grid_cells(grid(spark, d), ["root"]), ["root"], WARMUPS), 4)


@query("f16_f17_reconciliation")
def f16(spark, d):
    """Three methods on two datasets: hourly bars of events, four-day bars of line items."""
    methods: dict[str, DataFrame] = {}
    for name, bars, gap, edge in (("events", main_bars(spark, d), GAP, 3600), ("lines", B.bars(line_ticks(spark, d), 5760), 40 * 86400, 8 * 86400)):
        old = B.boundary_mask(B.sigma_causal(bars, SPAN).withColumn("z", X.z_score()), edge, 12)
        session = B.sigma_session(bars, SPAN, WARM, gap).withColumn("z", X.z_score())
        for method, rows in (("unfiltered", old), ("filtered", old.filter("clear")), ("session", session)):
            own = rows.select(F.lit(name).alias("dataset"), "root", "instrument_id", "ts", "z")
            methods[method] = methods[method].unionByName(own) if method in methods else own
    return rounded(Q.reconciled(methods, ["dataset", "root"]), 4)


@query("f20_pit_histogram", ZQ + ", h AS (SELECT root, least(floor(pr * 50), 49)::BIGINT AS bin, count(*) AS count FROM p GROUP BY ALL) SELECT root, bin, count, round(count * 50 / sum(count) OVER (PARTITION BY root), 6) AS density FROM h")
def f20(spark, d):
    return rounded(Q.pit_histogram(z_rows(spark, d), locked(spark), ["root"]).withColumn("bin", F.col("bin").cast("long")))


@query(
    "f21_residual_curve",
    ZQ + f""", rk AS (SELECT root, z, k, n, lead(z) OVER (PARTITION BY root ORDER BY k) AS ahead FROM r), mo AS (SELECT root, avg(z) AS m, stddev_pop(z) AS sd FROM c GROUP BY root),
gx AS (SELECT root, k AS p, -4.0 + k * 8.0 / 199 AS x FROM (SELECT DISTINCT root FROM r), (SELECT unnest(range(0, 200)) AS k)),
gi AS (SELECT gx.root, p, x, CASE WHEN k IS NULL THEN 0.0 WHEN ahead IS NULL THEN CASE WHEN x > z THEN 1.0 ELSE k / (n + 1) END ELSE (k + coalesce((x - z) / nullif(ahead - z, 0), 0)) / (n + 1) END AS ec, (x - 0.01) / 0.85 AS u FROM gx ASOF LEFT JOIN rk ON gx.root = rk.root AND gx.x >= rk.z)
SELECT root, p AS k, round(x, 6) + 0 AS x, round(ec - {TCDF}, 6) + 0 AS minus_t, round(ec - {phi("v")}, 6) + 0 AS minus_normal FROM (SELECT gi.*, (x - m) / sd AS v FROM gi JOIN mo USING (root))""",
)
def f21(spark, d):
    return rounded(Q.residual_curve(z_rows(spark, d), locked(spark), ["root"], 200))


def order_windows(spark, d) -> DataFrame:
    b = order_z(spark, d).groupBy("root").agg(F.min("ts").cast("date").alias("first_day"), F.max("ts").cast("date").alias("last_day"))
    b = b.withColumn("first_day", F.trunc("first_day", "MM"))
    return R.rolling_windows(b)


@query("r1_rolling_fit")
def r1(spark, d):
    return rounded(R.window_fits(order_z(spark, d), order_windows(spark, d), "window_start", "window_end", ["root", "window_start", "window_end", "center"], 50, binned=True), 3)


@query("r2_r4_segment_fit")
def r2(spark, d):
    seg = spark.createDataFrame([("orders", "early", None, "1998-01-01"), ("orders", "late", "1998-01-01", None), ("orders", "middle", "1997-01-01", "1999-01-01")], "root string, segment string, s string, e string")
    seg = seg.select("root", "segment", F.col("s").cast("timestamp_ntz").alias("s"), F.col("e").cast("timestamp_ntz").alias("e"))
    return rounded(R.window_fits(order_z(spark, d), seg, "s", "e", ["root", "segment"], 50, binned=True), 4)


def cutoffs(spark) -> DataFrame:
    return R.month_spine(spark, "1998-01-01", "1998-06-01").select(F.col("month").cast("timestamp_ntz").alias("cutoff"))


@query("r3_break_scan")
def r3(spark, d):
    return rounded(R.break_scan(order_z(spark, d), cutoffs(spark)), 4)


@query("r5_excluded_middle", "SELECT 'orders' AS root, count(*) AS n, count(*) FILTER (d >= '1997-01-01' AND d < '1999-01-01') AS excluded, round(count(*) FILTER (d >= '1997-01-01' AND d < '1999-01-01') * 100.0 / count(*), 6) AS excluded_pct FROM (SELECT o_orderpriority, time_bucket(INTERVAL '1 day', o_orderdate) AS d FROM orders GROUP BY ALL)")
def r5(spark, d):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return rounded(R.excluded_middle(B.bars(order_ticks(spark, d), 1440), at("1997-01-01"), at("1999-01-01")))


@query(
    "r6_trend",
    # The probability has a closed form for the five degrees of freedom of seven years.
    """WITH y AS (SELECT o_orderpriority AS root, year(o_orderdate) AS x, avg(o_totalprice) AS y FROM orders GROUP BY ALL),
l AS (SELECT root, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, corr(x, y) AS r FROM y GROUP BY root HAVING count(*) >= 3), t AS (SELECT *, atan(abs(r) * sqrt((n - 2) / (1 - r * r)) / sqrt(5)) AS a FROM l)
SELECT root, n, round(slope, 4) AS slope, round(intercept, 2) AS intercept, round(r, 6) AS r, CASE WHEN n = 7 THEN round(1 - 2 / pi() * (a + sin(a) * (cos(a) + 2 / 3.0 * cos(a) ** 3)), 6) END AS p FROM t""",
)
def r6(spark, d):
    o = order_ticks(spark, d).groupBy(F.col("instrument_id").alias("root"), F.year("ts").cast("double").alias("x")).agg(F.avg("price").alias("y"))
    return rounded(R.trend(o, ["root"], "x", "y"), 6, slope=4, intercept=2)


def swept(spark, d) -> tuple[DataFrame, DataFrame]:
    """The sweep of the cutoffs, and the months under its fits."""
    z = order_z(spark, d)
    fits = staged(R.sweep(z, cutoffs(spark).withColumn("root", F.lit("orders")), Q.fit_student_t(z, ["root"]), 50))
    return fits, R.monthly_ks(z, fits, 20)


@query("r7_r12_monthly_sweep")
def r7(spark, d):
    fits, months = swept(spark, d)
    return rounded(R.rejections(months, 0.2).join(fits, ["root", "cutoff"]), 4)


@query(
    "r8_locked_months",
    """WITH ob AS (SELECT o_orderpriority AS root, time_bucket(INTERVAL '1 day', o_orderdate) AS ts, first(o_totalprice::DOUBLE ORDER BY o_orderdate, o_orderkey) AS open, max(o_totalprice)::DOUBLE AS high, min(o_totalprice)::DOUBLE AS low,
 last(o_totalprice::DOUBLE ORDER BY o_orderdate, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY ALL), """
    + _ewma(f"lag({GK}) OVER ({W})", "root", SPAN, "ob", "og", 10)
    + f""", oz AS (SELECT ts, ln(close / lag(close) OVER ({W})) / nullif(sigma, 0) AS z FROM og), h AS (SELECT date_trunc('month', ts)::DATE AS month, floor(z / 0.002) AS b, count(*) AS n FROM oz WHERE abs(z) < 50 GROUP BY ALL),
e AS (SELECT month, b, n, sum(n) OVER (PARTITION BY month ORDER BY b) AS up, sum(n) OVER (PARTITION BY month) AS total FROM h), f AS (SELECT month, total, up / total AS hi, (up - n) / total AS lo, unnest([0, 1]) AS side, ((b + side) * 0.002 - 0.01) / 0.85 AS u FROM e),
m AS (SELECT month, any_value(total) AS n, max(abs(CASE side WHEN 1 THEN hi ELSE lo END - {TCDF})) AS ks FROM f GROUP BY month), c AS (SELECT unnest([DATE '1998-01-01', DATE '1999-07-01']) AS cutoff)
SELECT 'orders' AS root, cutoff::TIMESTAMP AS cutoff, month, n::BIGINT AS n, CASE WHEN n >= 100 THEN round(ks, 6) END AS ks FROM m JOIN c ON month >= cutoff""",
)
def r8(spark, d):
    """R8 under locked parameters."""
    c = spark.createDataFrame([("orders", at, 4.0, 0.01, 0.85) for at in ("1998-01-01", "1999-07-01")], "root string, cutoff string, nu double, loc double, scale double")
    return rounded(R.monthly_ks(order_z(spark, d), c.withColumn("cutoff", F.col("cutoff").cast("timestamp_ntz")), 100))


@query("r9_first_acceptable")
def r9(spark, d):
    """Every cutoff with what the rule looks at, and whether it is the first that passes (none, if the rule finds none)."""
    fits, months = swept(spark, d)
    first = R.first_acceptable(fits, months).withColumn("first_acceptable", F.lit(True))
    worst = R.rejections(months).withColumnRenamed("passes", "months_ok")
    out = fits.select("root", "cutoff", "nu_delta", "ks").join(worst, ["root", "cutoff"], "left").join(first, ["root", "cutoff"], "left")
    return rounded(out.fillna(False, ["first_acceptable"]), 4)


@query("r10_six_month_fit")
def r10(spark, d):
    m = R.month_spine(spark, "1997-01-01", "1998-01-01").select(F.lit("orders").alias("root"), F.col("month").cast("timestamp_ntz").alias("anchor"))
    return rounded(R.window_fits(order_z(spark, d), m.withColumn("s", F.add_months("anchor", -6).cast("timestamp_ntz")), "s", "anchor", ["root", "anchor"], 50, binned=True), 3)


@query("r11_month_spine", "SELECT m::DATE AS month FROM (SELECT unnest(range(TIMESTAMP '1995-01-01', TIMESTAMP '2001-09-01', INTERVAL 1 MONTH)) AS m), (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders) WHERE m >= date_trunc('month', a) AND m <= b")
def r11(spark, d):
    b = order_ticks(spark, d).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    s = R.month_spine(spark, "1995-01-01", "2001-09-01")
    return s.join(F.broadcast(b), (F.col("month") >= F.date_trunc("MONTH", "a")) & (F.col("month") <= F.col("b"))).select("month")


@query("r13_r14_triggers")
def r13(spark, d):
    z = order_z(spark, d).withColumn("year", F.year("ts"))
    fits = Q.fit_student_t(z, ["root", "year"])
    d2 = fits.join(Q.pit_diagnostics(z, fits, ["root", "year"]).select("root", "year", "ks"), ["root", "year"])
    limits = spark.createDataFrame([("orders", 3.0, 0.05, 0.5, 2.0)], "root string, nu_floor double, ks_limit double, scale_low double, scale_high double")
    return rounded(R.refit_triggers(d2, limits).join(Q.yearly_span(fits, ["root"]), "root"), 4)


CHECKED = ["der", "sign_concordance", "subbar_imbalance", "clv_mean", "clv_var", "imbalance_t", "z", "sigma_yz", "body_to_range", "gel_fraction", "wick_asymmetry", "amihud", "ko_W", "polar_order_P"]
#: (root, feature, value) of the valid bars.
LONGSQL = FEATURES + ", lg AS (" + " UNION ALL ".join(f"SELECT root, '{c}' AS feature, \"{c}\" AS v FROM fe WHERE ok" for c in CHECKED) + ")"


@query("w1_w5_w8_availability", LONGSQL + " SELECT root, feature, count(*) AS n, count(v) AS known, round(count(v) / count(*), 6) AS rate, count(v) = 0 AS all_null, count(v) / count(*) < 0.9 AS rare FROM lg GROUP BY ALL")
def w1(spark, d):
    return rounded(V.availability(features(spark, d), CHECKED))


@query(
    "w2_range_check",
    LONGSQL + """, st AS (SELECT root, feature, avg(v) AS mean, median(v) AS median, stddev_samp(v) AS std, min(v) AS min, quantile_cont(v, 0.01) AS p01, quantile_cont(v, 0.99) AS p99, max(v) AS max FROM lg GROUP BY ALL)
SELECT root, feature, round(mean, 4) + 0 AS mean, round(median, 4) + 0 AS median, round(std, 4) AS std, round(min, 4) + 0 AS min, round(p01, 4) + 0 AS p01, round(p99, 4) + 0 AS p99, round(max, 4) + 0 AS max, -1.0::DOUBLE AS low, 1.0::DOUBLE AS high,
 CASE WHEN min < -1 THEN 'min' WHEN max > 1 THEN 'max' WHEN NOT mean BETWEEN -1 AND 1 THEN 'mean' ELSE 'ok' END AS "check" FROM st""",
)
def w2(spark, d):
    e = spark.createDataFrame([(f, -1.0, 1.0) for f in CHECKED], "feature string, low double, high double")
    return rounded(V.range_check(features(spark, d), e), 4)


#: High correlations that are expected, as pairs in order of the features.
EXPECTED = (("body_to_range", "gel_fraction"),)
PAIRS = [(a, b) for i, a in enumerate(CHECKED) for b in CHECKED[i + 1 :]]


@query(
    "w3_w4_correlations",
    FEATURES + ", wh AS (SELECT * FROM fe WHERE ok AND " + " AND ".join(f'"{c}" IS NOT NULL' for c in CHECKED) + "), pr AS (" + " UNION ALL ".join(f"SELECT root, '{a}' AS a, '{b}' AS b, \"{a}\" AS x, \"{b}\" AS y FROM wh" for a, b in PAIRS) + """),
co AS (SELECT root, a, b, count(*) AS n, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS r FROM pr GROUP BY ALL)
SELECT root, a, b, n, round(r, 6) + 0 AS r, abs(r) > 0.85 AND NOT (a = 'body_to_range' AND b = 'gel_fraction') AS high_pair, CASE WHEN abs(r) < 0.05 THEN 'preserved' WHEN abs(r) < 0.1 THEN 'marginal' ELSE 'BROKEN' END AS orthogonality, abs(r) < 0.4 AS secondary_ok FROM co""",
)
def w3(spark, d):
    return rounded(V.correlations(features(spark, d).filter("is_valid_bar"), CHECKED, expected=EXPECTED))


@query(
    "w6_stability",
    BARS + ", h AS (SELECT root, close AS v, row_number() OVER (PARTITION BY root ORDER BY ts) <= count(*) OVER (PARTITION BY root) // 2 AS f FROM bar) SELECT root, 'close' AS feature, round(avg(v) FILTER (f), 6) AS mean_1, round(avg(v) FILTER (NOT f), 6) AS mean_2, round((avg(v) FILTER (NOT f) - avg(v) FILTER (f)) / stddev_samp(v), 6) AS shift, abs((avg(v) FILTER (NOT f) - avg(v) FILTER (f)) / stddev_samp(v)) > 2 AS flagged FROM h GROUP BY root",
)
def w6(spark, d):
    return rounded(V.stability(main_bars(spark, d), ["close"]))


@query("w7_row_sample", BARS + " SELECT root, round(open, 6) AS open, round(close, 6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY md5(concat_ws('|', root, root, epoch_us(ts), 7))) AS i FROM bar) WHERE i <= 5")
def w7(spark, d):
    return rounded(V.row_sample(main_bars(spark, d), 5, 7).select("root", "open", "close"))
