"""Registered queries over bars, sessions, volatility, flow and features, with their SQL.

Parameters fit the test tables: 10-minute sub-bars, 60-minute bars, gaps of 120 minutes, span 20, warm-up 10.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.safe import rounded, seconds
from barloom.operators import bars as B
from barloom.operators import flow as X
from barloom.sources.stage import bucketed
from barloom.sources.tables import event_ticks

SUB, MAIN, GAP, WARM, SPAN = 10, 60, 7200, 10, 20
ROOTS = ("click", "error", "purchase", "signup", "view")
PARAMS = [(r, 4.0, 0.01, 0.85) for r in ROOTS]
CUT = "2024-01-08 00:00:00"
REGIME = "2024-01-02 00:00:00"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def main_bars(spark, d) -> DataFrame:
    return B.bars(event_ticks(spark, d), MAIN)


def sub_bars(spark, d) -> DataFrame:
    return B.bars(event_ticks(spark, d), SUB)


def sigma_bars(spark, d) -> DataFrame:
    return B.sigma_session(main_bars(spark, d), SPAN, WARM, GAP).withColumn("z", X.z_score())


def params(spark) -> DataFrame:
    return X.parameter_table(spark, PARAMS)


def gates(spark, name: str, at: str = CUT) -> DataFrame:
    return spark.createDataFrame([(r, at) for r in ROOTS], f"root string, {name} string").withColumn(name, F.col(name).cast("timestamp_ntz"))


def features(spark, d) -> DataFrame:
    return features_of(spark, sub_bars(spark, d))


def features_of(spark, sub: DataFrame) -> DataFrame:
    return X.feature_table(sub, params(spark), gates(spark, "regime_start", REGIME), gates(spark, "cutoff"), MAIN, SPAN, WARM, GAP)


def shown(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return rounded(df.select("root", seconds("ts").alias("t"), *columns), digits)


def _bar(minutes: int, name: str) -> str:
    return f"""{name} AS (SELECT event_type AS root, time_bucket(INTERVAL '{minutes} minutes', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY ALL)"""


GK = "nullif(CASE WHEN high = low THEN ln(close / open) ** 2 WHEN 0.5 * ln(high / low) ** 2 - (2 * ln(2) - 1) * ln(close / open) ** 2 < 0 THEN ln(high / low) ** 2 / (4 * ln(2)) ELSE 0.5 * ln(high / low) ** 2 - (2 * ln(2) - 1) * ln(close / open) ** 2 END, 0)"
W = "PARTITION BY root ORDER BY ts"
BARS = "WITH " + _bar(MAIN, "bar")
SESS = f"""s0 AS (SELECT *, coalesce((epoch(ts) - epoch(lag(ts) OVER ({W})) > {GAP})::INT, 1) AS brk FROM {{src}}),
s1 AS (SELECT *, sum(brk) OVER ({W} ROWS UNBOUNDED PRECEDING) AS session_id FROM s0),
s2 AS (SELECT *, row_number() OVER (PARTITION BY root, session_id ORDER BY ts) - 1 AS pos FROM s1)"""


def _ewma(x: str, part: str, span: int, src: str, dst: str, least: int, out: str = "sigma") -> str:
    """Decayed sums by prefix sums of x / decay^i; min periods on the count of values."""
    b = f"({span - 1}.0 / {span + 1}.0)"
    w = f"PARTITION BY {part} ORDER BY ts"
    return f"""{dst}a AS (SELECT *, {x} AS x0, row_number() OVER ({w}) AS i FROM {src}),
{dst} AS (SELECT *, CASE WHEN count(x0) OVER ({w} ROWS UNBOUNDED PRECEDING) >= {least} THEN sqrt(sum(x0 * pow({b}, -i)) OVER ({w} ROWS UNBOUNDED PRECEDING) / sum(CASE WHEN x0 IS NOT NULL THEN pow({b}, -i) END) OVER ({w} ROWS UNBOUNDED PRECEDING)) END AS {out} FROM {dst}a)"""


SIGMA = BARS + ", " + SESS.format(src="bar") + ", " + _ewma(f"lag({GK}) OVER (PARTITION BY root, session_id ORDER BY ts)", "root, session_id", SPAN, "s2", "g", WARM) + ", z AS (SELECT *, ln(close / open) / nullif(sigma, 0) AS z FROM g)"


def phi(x: str) -> str:
    """SQL for the normal distribution at x, by the series of odd powers over odd factorials."""
    u = f"least(greatest({x}, -8.5), 8.5)"
    terms = f"list_sum(list_transform(range(0, 160), lambda k: exp((2 * k + 1) * ln(abs({u})) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)))))"
    return f"CASE WHEN {x} = 0 THEN 0.5 WHEN {x} IS NOT NULL THEN 0.5 + sign({x}) * exp(-{u} * {u} / 2) / sqrt(2 * pi()) * {terms} END"


TCDF = "(0.5 + 0.375 * u / sqrt(1 + u * u / 4) * (1 - u * u / (12 * (1 + u * u / 4))))"
FLOW = SIGMA + f", f AS (SELECT *, 2 * {TCDF} - 1 AS imb, {TCDF} AS buy FROM (SELECT *, (z - 0.01) / 0.85 AS u FROM z))"
T = "root, epoch(ts)::BIGINT AS t"


@query("b1_bars", BARS + f" SELECT {T}, open, high, low, close, volume FROM bar")
def b1(spark, d):
    return shown(main_bars(spark, d), "open", "high", "low", "close", "volume")


SUBS = "WITH " + _bar(SUB, "sub") + """, p AS (SELECT root, time_bucket(INTERVAL '60 minutes', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume,
  count(ln(close / open)) AS n_sub, sum(abs(ln(close / open))) AS sum_abs_ret, median(abs(ln(close / open))) AS median_abs_ret,
  avg(CASE WHEN high = low THEN 0 ELSE (2 * close - high - low) / (high - low) END) AS clv_mean, var_samp(CASE WHEN high = low THEN 0 ELSE (2 * close - high - low) / (high - low) END) AS clv_var FROM sub GROUP BY ALL),
bar AS (SELECT * FROM p WHERE volume > 0 AND n_sub >= 2)"""


@query("b2_parent_bars", SUBS + f" SELECT {T}, volume::BIGINT AS volume, n_sub, round(sum_abs_ret, 6) AS sum_abs_ret, round(median_abs_ret, 6) AS median_abs_ret, round(clv_mean, 6) + 0 AS clv_mean, round(clv_var, 6) AS clv_var FROM bar")
def b2(spark, d):
    return shown(B.parent_bars(sub_bars(spark, d), MAIN), "volume", "n_sub", "sum_abs_ret", "median_abs_ret", "clv_mean", "clv_var")


@query("b3_b5_returns", BARS + f" SELECT {T}, round(ln(close / open), 6) + 0 AS bar_ret, round(ln(close / lag(close) OVER ({W})), 6) + 0 AS close_ret, round(CASE WHEN high = low THEN 0 ELSE (2 * close - high - low) / (high - low) END, 6) + 0 AS clv FROM bar")
def b3(spark, d):
    df = main_bars(spark, d)
    return shown(df.withColumn("bar_ret", B.bar_return()).withColumn("close_ret", B.close_return()).withColumn("clv", B.close_location()), "bar_ret", "close_ret", "clv")


@query("v1_v2_range_variance", BARS + f" SELECT {T}, round({GK}, 6) AS gk, round(ln(high / low) ** 2 / (4 * ln(2)), 6) AS pk FROM bar")
def v1(spark, d):
    return shown(main_bars(spark, d).withColumn("gk", B.garman_klass()).withColumn("pk", B.parkinson()), "gk", "pk")


@query("n1_n2_sessions", BARS + ", " + SESS.format(src="bar") + f" SELECT {T}, session_id::BIGINT AS session_id, pos::BIGINT AS bar_in_session, pos >= {WARM} AS warmup_valid FROM s2")
def n1(spark, d):
    return shown(B.warmed(B.sessions(main_bars(spark, d), GAP), WARM).withColumn("bar_in_session", F.col("bar_in_session").cast("long")), "session_id", "bar_in_session", "warmup_valid")


@query("n3_boundary_mask", BARS + f", m AS (SELECT *, coalesce(epoch(ts) - epoch(lag(ts) OVER ({W})) > 3600, true) AS is_boundary FROM bar) SELECT {T}, is_boundary, NOT bool_or(is_boundary) OVER ({W} ROWS 11 PRECEDING) AS clear FROM m")
def n3(spark, d):
    return shown(B.boundary_mask(main_bars(spark, d), 3600, 12), "is_boundary", "clear")


@query("n4_long_gap_starts", BARS + f" SELECT {T} FROM (SELECT *, epoch(ts) - epoch(lag(ts) OVER ({W})) AS g FROM bar) WHERE coalesce(g > 10800, true)")
def n4(spark, d):
    return shown(B.long_gap_starts(main_bars(spark, d), 10800))


@query("n5_session_summary", BARS + ", " + SESS.format(src="bar") + " SELECT root, count(*) AS bars, count(DISTINCT session_id) AS sessions, count(DISTINCT CASE WHEN close > open * 10 THEN session_id END) AS sessions_with_event FROM s2 GROUP BY root")
def n5(spark, d):
    return B.session_summary(B.sessions(main_bars(spark, d), GAP), F.col("close") > F.col("open") * 10)


@query("v3_v4_sigma_concurrent", BARS + ", " + _ewma(GK, "root", SPAN, "bar", "g", 10) + f" SELECT {T}, round(sigma, 6) AS sigma FROM g")
def v4(spark, d):
    return shown(B.sigma_concurrent(main_bars(spark, d), SPAN), "sigma")


for _span, _name in ((20, "v5_sigma_causal"), (19, "v8_sigma_causal_short")):

    @query(_name, BARS + ", " + _ewma(f"lag({GK}) OVER ({W})", "root", _span, "bar", "g", 10) + f" SELECT {T}, round(sigma, 6) AS sigma FROM g")
    def v5(spark, d, span=_span):
        return shown(B.sigma_causal(main_bars(spark, d), span), "sigma")


@query("v6_sigma_session", SIGMA + f" SELECT {T}, round(sigma, 6) AS sigma, pos >= {WARM} AS warmup_valid FROM g")
def v6(spark, d):
    return shown(sigma_bars(spark, d), "sigma", "warmup_valid")


@query(
    "v7_sigma_ewm_std",
    BARS + f""", a AS (SELECT *, ln(close / open) AS x0, pow(19.0 / 21.0, -row_number() OVER ({W})) AS w FROM bar), a2 AS (SELECT *, x0 - avg(x0) OVER (PARTITION BY root) AS x FROM a),
s AS (SELECT *, count(x) OVER c AS n, sum(w) OVER c AS sw, sum(w * w) OVER c AS sww, sum(w * x) OVER c AS swx, sum(w * x * x) OVER c AS swxx FROM a2 WINDOW c AS ({W} ROWS UNBOUNDED PRECEDING))
SELECT {T}, CASE WHEN n >= 10 THEN round(sqrt((swxx / sw - (swx / sw) ** 2) * (sw * sw) / (sw * sw - sww)), 6) END AS sigma FROM s""",
)
def v7(spark, d):
    return shown(B.sigma_ewm(main_bars(spark, d), SPAN), "sigma")


def _full(f: str, x: str, n: int, frame: str | None = None) -> str:
    frame = frame or f"ROWS {n - 1} PRECEDING"
    return f"CASE WHEN count({x}) OVER ({W} {frame}) = {n} THEN {f}({x}) OVER ({W} {frame}) END"


YZ = f"""y0 AS (SELECT *, ln(open / lag(close) OVER ({W})) AS night, ln(close / open) AS day, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs, 0.34 / (1.34 + 21.0 / 19.0) AS k FROM {{src}}),
y AS (SELECT *, sqrt(greatest({_full('var_samp', 'night', 20)} + k * {_full('var_samp', 'day', 20)} + (1 - k) * {_full('avg', 'rs', 20)}, 0)) AS sigma_yz FROM y0)"""


@query("v9_yang_zhang", BARS + ", " + YZ.format(src="bar") + f" SELECT {T}, CASE WHEN {_full('count', 'night', 20)} IS NOT NULL THEN round(sigma_yz, 6) END AS sigma_yz FROM y")
def v9(spark, d):
    return shown(B.with_yang_zhang(main_bars(spark, d)), "sigma_yz")


SESSV = BARS + ", " + SESS.format(src="bar") + f""", v0 AS (SELECT root, ts, session_id, lag({GK}) OVER (PARTITION BY root, session_id ORDER BY ts) AS gk FROM s2), v1 AS (SELECT *, row_number() OVER (PARTITION BY root, session_id ORDER BY ts) AS i FROM v0 WHERE gk IS NOT NULL),
v2 AS (SELECT *, sqrt(pow(19.0 / 21.0, i) * (first_value(gk) OVER p / (19.0 / 21.0) + sum(CASE WHEN i > 1 THEN gk * (2.0 / 21.0) * pow(19.0 / 21.0, -i) ELSE 0 END) OVER (p ROWS UNBOUNDED PRECEDING))) AS sig FROM v1 WINDOW p AS (PARTITION BY root, session_id ORDER BY ts)),
v3 AS (SELECT *, max(CASE WHEN i = 60 THEN sig END) OVER (PARTITION BY root, session_id) AS late FROM v2),
v4 AS (SELECT root, i::INT AS bar_no, median(abs(sig / late - 1)) AS m, quantile_cont(abs(sig / late - 1), 0.9) AS q FROM v3 WHERE late IS NOT NULL AND i <= 40 GROUP BY ALL)"""


@query(
    "v10_convergence",
    SESSV + " SELECT root, bar_no, round(m, 6) AS median_off, round(q, 6) AS p90_off, min(CASE WHEN m < 0.05 THEN bar_no END) OVER (PARTITION BY root) AS first_5pct, min(CASE WHEN m < 0.1 THEN bar_no END) OVER (PARTITION BY root) AS first_10pct FROM v4",
)
def v10(spark, d):
    return rounded(B.convergence(main_bars(spark, d), GAP, 60, 40))


@query("v11_checkpoints", SESSV + " SELECT root, " + ", ".join(f'round(max(CASE WHEN bar_no = {k} THEN m END), 6) AS "{k}"' for k in (1, 10, 20, 40)) + " FROM v4 WHERE bar_no IN (1, 10, 20, 40) GROUP BY root")
def v11(spark, d):
    return rounded(B.checkpoints(B.convergence(main_bars(spark, d), GAP, 60, 40), (1, 10, 20, 40)))


@query("c1_c2_clean_z", SIGMA + f" SELECT {T}, round(z, 6) + 0 AS z FROM z WHERE abs(z) < 50")
def c1(spark, d):
    return shown(X.clean_z(sigma_bars(spark, d)), "z")


@query("c3_c5_student_flow", FLOW + f" SELECT {T}, round(buy, 6) AS v_buy_t, round(imb, 6) + 0 AS imbalance_t FROM f")
def c3(spark, d):
    return shown(X.with_flow(sigma_bars(spark, d), params(spark)), "v_buy_t", "imbalance_t")


@query("c4_gaussian_flow", SIGMA + f" SELECT {T}, round({phi('z')}, 6) AS v_buy_n FROM z")
def c4(spark, d):
    return shown(sigma_bars(spark, d).withColumn("v_buy_n", X.gaussian_flow()), "v_buy_n")


SUBFLOW = SUBS + ", " + SESS.format(src="bar") + ", " + _ewma(f"lag({GK}) OVER (PARTITION BY root, session_id ORDER BY ts)", "root, session_id", SPAN, "s2", "g", WARM) + f"""
, z AS (SELECT *, ln(close / open) AS log_ret, ln(close / open) / nullif(sigma, 0) AS z FROM g),
q AS (SELECT z.root, z.ts, z.log_ret, s.volume AS v, ln(s.close / s.open) AS r, (ln(s.close / s.open) / nullif(sigma, 0) - 0.01) / 0.85 AS u FROM sub s JOIN z ON s.root = z.root AND time_bucket(INTERVAL '60 minutes', s.ts) = z.ts WHERE z.sigma IS NOT NULL),
e AS (SELECT root, ts, avg(CASE WHEN log_ret = 0 THEN 0.5 WHEN sign(r) = sign(log_ret) THEN 1.0 ELSE 0.0 END) AS conc, sum((2 * {TCDF} - 1) * v) / sum(v) AS simb FROM q GROUP BY ALL)"""


@query(
    "x1_x7_subbar_features",
    SUBFLOW + " SELECT z.root, epoch(z.ts)::BIGINT AS t, round(least(abs(log_ret) / (sum_abs_ret + greatest(median_abs_ret, 1e-8)), 1), 6) AS der, round(conc, 6) AS sign_concordance, round(simb, 6) + 0 AS subbar_imbalance, round(z, 6) + 0 AS z FROM z LEFT JOIN e USING (root, ts)",
)
def x7(spark, d):
    return shown(X.subbar_features(sub_bars(spark, d), params(spark), MAIN, "session", SPAN, WARM, GAP), "der", "sign_concordance", "subbar_imbalance", "z")


#: The feature table: flow columns are null before the regime start, geometry on bars that aren't valid.
FEATURES = SUBFLOW + f""", y0 AS (SELECT *, ln(open / lag(close) OVER ({W})) AS night, ln(close / open) AS day, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs, 0.34 / (1.34 + 21.0 / 19.0) AS yk,
  ln(close / lag(close) OVER ({W})) AS cr, (z - 0.01) / 0.85 AS u FROM z),
y1 AS (SELECT *, sign(coalesce(cr, 0)) AS sg, pos >= {WARM} AND sigma IS NOT NULL AND ts >= TIMESTAMP '{REGIME}' AS ok, 2 * {TCDF} - 1 AS imb0, {TCDF} AS buy0 FROM y0),
y2 AS (SELECT *, CASE WHEN count(night) OVER w = 20 AND count(day) OVER w = 20 AND count(rs) OVER w = 20 THEN sqrt(greatest(list_aggregate(list(night) OVER w, 'var_samp') + yk * list_aggregate(list(day) OVER w, 'var_samp') + (1 - yk) * avg(rs) OVER w, 0)) END AS yz,
  CASE WHEN count(*) OVER w50 = 50 THEN abs(sum(sg) OVER w50) / 50 END AS polar FROM y1 WINDOW w AS ({W} ROWS 19 PRECEDING), w50 AS ({W} ROWS 49 PRECEDING)),
fe AS (SELECT y.root, y.ts, open, high, low, close, volume, clv_mean, clv_var, sigma, z, ok, ok AND y.ts >= TIMESTAMP '{CUT}' AS train, e.conc AS sign_concordance, CASE WHEN y.ts >= TIMESTAMP '{REGIME}' THEN e.simb END AS subbar_imbalance,
  least(abs(log_ret) / (sum_abs_ret + greatest(median_abs_ret, 1e-8)), 1) AS der, CASE WHEN y.ts >= TIMESTAMP '{REGIME}' THEN imb0 END AS imbalance_t, CASE WHEN ok THEN yz END AS sigma_yz,
  CASE WHEN ok THEN CASE WHEN high = low THEN 0 ELSE abs(close - open) / (high - low) END END AS body_to_range, CASE WHEN ok THEN CASE WHEN high = low THEN 0 ELSE abs(close - (high + low) / 2) / (high - low) END END AS gel_fraction,
  CASE WHEN ok THEN ln(high / greatest(open, close)) - ln(least(open, close) / low) END AS wick_asymmetry, CASE WHEN ok THEN abs(cr) / volume END AS amihud, CASE WHEN ok THEN sigma * close * volume END AS "ko_W", CASE WHEN ok THEN polar END AS "polar_order_P"
  FROM y2 y LEFT JOIN e ON y.root = e.root AND y.ts = e.ts)"""

#: As SUBFLOW, with the concurrent estimate and without rows that lack one.
CONCURRENT = SUBS + ", " + _ewma(GK, "root", SPAN, "bar", "g", 10) + """
, z AS (SELECT *, ln(close / open) AS log_ret, ln(close / open) / nullif(sigma, 0) AS z FROM g),
q AS (SELECT z.root, z.ts, z.log_ret, ln(s.close / s.open) AS r FROM sub s JOIN z ON s.root = z.root AND time_bucket(INTERVAL '60 minutes', s.ts) = z.ts WHERE z.sigma IS NOT NULL),
e AS (SELECT root, ts, avg(CASE WHEN log_ret = 0 THEN 0.5 WHEN sign(r) = sign(log_ret) THEN 1.0 ELSE 0.0 END) AS c FROM q GROUP BY ALL),
x AS (SELECT z.root, z.ts, c, least(abs(log_ret) / (sum_abs_ret + greatest(median_abs_ret, 1e-8)), 1) AS d FROM z LEFT JOIN e USING (root, ts) WHERE z.z IS NOT NULL AND sigma IS NOT NULL)"""


@query("x8_confidence_weights", CONCURRENT + f" SELECT {T}, round((0.5 + 0.5 * c) * (0.5 + 0.5 * d), 6) AS conservative, round(c * (0.5 + 0.5 * d), 6) AS moderate, round(c * d, 6) AS aggressive FROM x")
def x8(spark, d):
    df = X.subbar_features(sub_bars(spark, d), params(spark), MAIN, "concurrent")
    return shown(df.select("root", "ts", *[c.alias(n) for n, c in X.confidence_weights().items()]), "conservative", "moderate", "aggressive")


@query(
    "x9_x10_validity",
    SUBFLOW + f", v AS (SELECT *, pos >= {WARM} AND sigma IS NOT NULL AND ts >= TIMESTAMP '2024-01-02' AS ok FROM z) SELECT root, count(*) AS n, count(*) FILTER (ok) AS n_valid, count(*) FILTER (ok AND ts >= TIMESTAMP '{CUT}') AS n_train FROM v GROUP BY root",
)
def x9(spark, d):
    return features(spark, d).groupBy("root").agg(F.count("*").alias("n"), F.count_if("is_valid_bar").alias("n_valid"), F.count_if("is_train_valid_bar").alias("n_train"))


@query(
    "x11_x16_geometry",
    BARS + f""", c AS (SELECT *, ln(close / lag(close) OVER ({W})) AS cr FROM bar), c2 AS (SELECT *, sign(coalesce(cr, 0)) AS sg FROM c)
SELECT {T}, round(CASE WHEN high = low THEN 0 ELSE abs(close - open) / (high - low) END, 6) AS body_to_range, round(CASE WHEN high = low THEN 0 ELSE abs(close - (high + low) / 2) / (high - low) END, 6) AS gel_fraction,
 round(ln(high / greatest(open, close)) - ln(least(open, close) / low), 6) + 0 AS wick_asymmetry, round(abs(cr) / volume, 6) AS amihud, round(close * volume, 6) AS "ko_W",
 round(abs({_full('sum', 'sg', 20)}) / 20, 6) AS "polar_order_P" FROM c2""",
)
def x11(spark, d):
    df = X.geometry(main_bars(spark, d).withColumn("one", F.lit(1.0)), "one", polar_bars=20)
    return shown(df, "body_to_range", "gel_fraction", "wick_asymmetry", "amihud", "ko_W", "polar_order_P")


@query(
    "x17_scaled_imbalance",
    FLOW + f""", dm AS (SELECT root, ts::DATE AS day, avg(abs(imb)) AS m FROM f WHERE imb IS NOT NULL GROUP BY ALL), di AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY day) AS i FROM dm),
du AS (SELECT root, day, pow(9.0 / 11.0, i) * (first_value(m) OVER (PARTITION BY root ORDER BY day) / (9.0 / 11.0) + sum(CASE WHEN i > 1 THEN m * (2.0 / 11.0) * pow(9.0 / 11.0, -i) ELSE 0 END) OVER (PARTITION BY root ORDER BY day ROWS UNBOUNDED PRECEDING)) AS usual FROM di)
SELECT f.root, epoch(f.ts)::BIGINT AS t, round(abs(imb) / nullif(usual, 0), 6) AS "v_star_C" FROM f LEFT JOIN du ON f.root = du.root AND f.ts::DATE = du.day""",
)
def x17(spark, d):
    return shown(X.scaled_imbalance(X.with_flow(sigma_bars(spark, d), params(spark))), "v_star_C")


_X18 = ", ".join(f'round({c}, 6) + 0 AS {c}' for c in ("sigma_yz", "body_to_range", "gel_fraction", "wick_asymmetry", "amihud", '"ko_W"', '"polar_order_P"', "der", "sign_concordance", "subbar_imbalance", "clv_mean", "clv_var", "imbalance_t", "z"))


@query("x18_feature_table", FEATURES + f" SELECT {T}, {_X18}, ok AS is_valid_bar, train AS is_train_valid_bar FROM fe")
def x18(spark, d):
    return shown(features(spark, d), *X.GEOMETRY, *[c for c in X.FLOW_FEATURES], "is_valid_bar", "is_train_valid_bar")


@query("s4_s7_bucketed_features", FEATURES + f" SELECT {T}, {_X18}, ok AS is_valid_bar, train AS is_train_valid_bar FROM fe")
def s7(spark, d):
    """The feature table from sub-bars stored in buckets: no exchange after the store."""
    stored = bucketed(sub_bars(spark, d), 8)
    return shown(features_of(spark, stored), *X.GEOMETRY, *[c for c in X.FLOW_FEATURES], "is_valid_bar", "is_train_valid_bar")


@query(
    "x19_summary",
    BARS + """, u AS (SELECT root, 'close' AS feature, close AS v FROM bar UNION ALL SELECT root, 'open', open FROM bar)
SELECT root, feature, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.95), 6) AS p95, avg((v IS NULL)::INT)::DOUBLE AS null_share FROM u GROUP BY ALL""",
)
def x19(spark, d):
    return rounded(X.summary(main_bars(spark, d), ["open", "close"]))


@query("x20_vpin", FLOW + f" SELECT {T}, round({_full('avg', 'abs(imb)', 20)}, 6) AS vpin FROM f")
def x20(spark, d):
    return shown(X.with_flow(sigma_bars(spark, d), params(spark)).withColumn("vpin", X.vpin()), "vpin")


@query(
    "x21_har_lags",
    SIGMA + f", h AS (SELECT *, lag(sigma) OVER ({W}) AS l1 FROM g) SELECT {T}, round(l1, 6) AS sigma_lag1, round({_full('avg', 'l1', 12)}, 6) AS sigma_short, round({_full('avg', 'l1', 60)}, 6) AS sigma_long FROM h",
)
def x21(spark, d):
    return shown(X.har_lags(sigma_bars(spark, d), "sigma"), "sigma_lag1", "sigma_short", "sigma_long")


@query(
    "x22_forward_target",
    BARS + f", c AS (SELECT *, ln(close / lag(close) OVER ({W})) ** 2 AS r2 FROM bar) SELECT {T}, round(0.5 * ln({_full('sum', 'r2', 12, 'ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING')}), 6) + 0 AS target_log_sigma_rv FROM c",
)
def x22(spark, d):
    return shown(X.forward_target(main_bars(spark, d)), "target_log_sigma_rv")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Bars, session-isolated sigma, flow: mean |imbalance|, bars and valid share of each instrument."""
    df = B.sigma_session(B.bars(event_ticks(spark, d), 360), SPAN, WARM, 12 * 3600).withColumn("z", X.z_score())
    df = X.with_flow(df, params(spark))
    return df.groupBy("root", "instrument_id").agg(F.avg(F.abs("imbalance_t")).alias("mean_abs_imbalance"), F.count("*").alias("bars"), F.avg(F.col("warmup_valid").cast("double")).alias("valid_share"))
