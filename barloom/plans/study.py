"""Registered queries over the event study and the walk-forward forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.safe import rounded, seconds
from barloom.operators import bars as B
from barloom.operators import boosting as G
from barloom.operators import events as E
from barloom.operators import flow as X
from barloom.operators import forecast as M
from barloom.plans.market import FEATURES, FLOW, GAP, GK, SPAN, T, W, WARM, _ewma, _full, features, main_bars, params, shown
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


def at(s: str):
    return F.lit(s).cast("timestamp_ntz")


WARM_FROM, EVAL_FROM = "2024-01-02", "2024-01-12"


def gated(spark, d) -> DataFrame:
    """The feature table with gates and forward returns: one stage, written once and read by every step of the study."""
    return staged(E.with_forward(E.with_gates(features(spark, d), GAP, 20, 30)))


def events(g: DataFrame) -> DataFrame:
    l = E.long_gates(g)  # noqa: E741
    return E.rising(l, E.thresholds(l, at(WARM_FROM), at(EVAL_FROM), 1), at(EVAL_FROM))


def cells(spark, d, *keys: str, horizons=E.HORIZONS) -> DataFrame:
    return E.accuracy(E.scored(events(gated(spark, d)), horizons), list(keys))


def _roll(c: str, n: int) -> str:
    w = f"(PARTITION BY root, sid ORDER BY ts ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({c}) OVER {w} = {n} THEN ({c} - avg({c}) OVER {w}) / nullif(list_aggregate(list({c}) OVER {w}, 'stddev_samp'), 0) END"


#: gt: gates on all bars (session 0: bars that aren't valid); lg: one row per gate; th: thresholds; ev: first events of sessions; sc: events by horizon.
GATES = FEATURES + f""", g0 AS (SELECT *, sum(brk) OVER ({W} ROWS UNBOUNDED PRECEDING)::BIGINT AS sid, abs(imbalance_t) AS ai FROM (SELECT *, coalesce((epoch(ts) - epoch(lag(ts) OVER ({W})) > {GAP})::INT, 1) AS brk FROM fe WHERE ok)),
g1 AS (SELECT *, {_roll("ai", 20)} AS z_imb, {_roll("sign_concordance", 20)} AS z_conc, CASE WHEN count(der) OVER m = 30 THEN median(der) OVER m END AS der_median FROM g0 WINDOW m AS (PARTITION BY root, sid ORDER BY ts ROWS 29 PRECEDING)),
g2 AS (SELECT *, CASE WHEN z_imb IS NOT NULL THEN greatest(z_imb, 0) END AS d_A, CASE WHEN z_imb * z_conc IS NOT NULL THEN greatest(z_imb * z_conc, 0) END AS d_B FROM g1),
gt AS (SELECT fe.root, fe.ts, coalesce(sid, 0) AS sid, fe.close, fe.imbalance_t, z_imb, z_conc, der_median, d_A, d_B, d_B * (g2.der > der_median)::INT AS d_C FROM fe LEFT JOIN g2 ON fe.root = g2.root AND fe.ts = g2.ts),
lg AS (SELECT root, ts, sid, imbalance_t, 'A' AS gate, d_A AS d FROM gt UNION ALL SELECT root, ts, sid, imbalance_t, 'B', d_B FROM gt UNION ALL SELECT root, ts, sid, imbalance_t, 'C', d_C FROM gt),
th AS (SELECT root, gate, count(*) AS n_pos, tier, quantile_cont(d, 0.95) AS q95, quantile_cont(d, 0.7) AS q70, CASE tier WHEN 'primary' THEN q95 ELSE q70 END AS threshold
  FROM lg, (SELECT unnest(['primary', 'secondary']) AS tier) WHERE ts >= TIMESTAMP '{WARM_FROM}' AND ts < TIMESTAMP '{EVAL_FROM}' AND d > 0 GROUP BY root, gate, tier),
e0 AS (SELECT lg.*, tier, threshold, lag(sid) OVER w = sid AS same, lag(d) OVER w AS d0 FROM lg JOIN th USING (root, gate) WINDOW w AS (PARTITION BY root, gate, tier ORDER BY ts)),
ev AS (SELECT * FROM e0 WHERE d >= threshold AND CASE WHEN coalesce(same, false) THEN coalesce(d0 < threshold, false) ELSE true END AND ts >= TIMESTAMP '{EVAL_FROM}' QUALIFY row_number() OVER (PARTITION BY root, gate, tier, sid ORDER BY ts) = 1),
fo AS (SELECT root, ts, sid, close, row_number() OVER ({W}) AS k FROM gt), fw AS (SELECT a.root, a.ts, horizon, CASE WHEN a.sid = b.sid THEN ln(b.close / a.close) END AS fwd FROM fo a CROSS JOIN (SELECT unnest([1, 3, 6, 12]) AS horizon) LEFT JOIN fo b ON a.root = b.root AND b.k = a.k + horizon),
sc AS (SELECT ev.*, horizon, CASE WHEN sign(imbalance_t) <> 0 AND sign(fwd) <> 0 THEN (sign(imbalance_t) = sign(fwd))::INT END AS hit FROM ev JOIN fw ON ev.root = fw.root AND ev.ts = fw.ts)"""


def _cells(keys: str, source: str = "sc") -> str:
    return f"""c0 AS (SELECT {keys}, count(*) AS n_events, count(hit) AS n_scored, coalesce(sum(hit), 0)::BIGINT AS n_correct FROM {source} GROUP BY {keys}), c1 AS (SELECT *, n_correct / nullif(n_scored, 0) AS p, nullif(n_scored, 0)::DOUBLE AS n, 1.959963984540054 AS zz FROM c0),
c2 AS (SELECT *, (p + zz * zz / (2 * n)) / (1 + zz * zz / n) AS mid, zz * sqrt(p * (1 - p) / n + zz * zz / (4 * n * n)) / (1 + zz * zz / n) AS half FROM c1),
cl AS (SELECT {keys}, n_events, n_scored, n_correct, p AS accuracy, mid - half AS wilson_lo, mid + half AS wilson_hi, (p - 0.5) / sqrt(0.25 / n) AS z_vs_half, (zz + 0.8416212335729143) * sqrt(0.25 / n) AS mde_80pct, half AS wilson_half FROM c2)"""


_SHOWN = "n_events, n_scored, n_correct, " + ", ".join(f"round({c}, 6) + 0 AS {c}" for c in ("accuracy", "wilson_lo", "wilson_hi", "z_vs_half", "mde_80pct", "wilson_half"))


@query("d2_d5_gates", GATES + f" SELECT {T}, sid AS session_id, " + ", ".join(f'round({c}, 6) + 0 AS "{c}"' for c in ("z_imb", "z_conc", "der_median", "d_A", "d_B", "d_C")) + " FROM gt")
def d2(spark, d):
    return shown(E.with_gates(features(spark, d), GAP, 20, 30), "session_id", "z_imb", "z_conc", "der_median", "d_A", "d_B", "d_C")


@query("d6_thresholds", GATES + " SELECT root, gate, n_pos, tier, round(threshold, 6) AS threshold FROM th")
def d6(spark, d):
    return rounded(E.thresholds(E.long_gates(E.with_gates(features(spark, d), GAP, 20, 30)), at(WARM_FROM), at(EVAL_FROM), 1))


@query("d7_d8_events", GATES + f" SELECT {T}, gate, tier, round(d, 6) AS d FROM ev")
def d7(spark, d):
    return shown(events(gated(spark, d)), "gate", "tier", "d")


@query(
    "d9_forward_returns",
    FLOW + """, h AS (SELECT unnest([1, 3, 6, 12]) AS horizon), o AS (SELECT root, ts, session_id, close, row_number() OVER (PARTITION BY root ORDER BY ts) AS k FROM f)
SELECT a.root, epoch(a.ts)::BIGINT AS t, horizon, CASE WHEN a.session_id = b.session_id THEN round(ln(b.close / a.close), 6) + 0 END AS fwd FROM o a CROSS JOIN h LEFT JOIN o b ON a.root = b.root AND b.k = a.k + horizon""",
)
def d9(spark, d):
    df = B.sessions(main_bars(spark, d), GAP)
    return rounded(E.forward_returns(df).select("root", seconds("ts").alias("t"), "horizon", "fwd"))


@query(
    "d10_d12_cells",
    FLOW + """, v AS (SELECT root, ts, imb, session_id AS s, close, lead(session_id) OVER (PARTITION BY root ORDER BY ts) AS s1, lead(close) OVER (PARTITION BY root ORDER BY ts) AS c1 FROM f),
e AS (SELECT root, CASE WHEN s = s1 AND sign(imb) <> 0 AND sign(ln(c1 / close)) <> 0 THEN (sign(imb) = sign(ln(c1 / close)))::INT END AS hit FROM v WHERE imb IS NOT NULL AND abs(imb) > 0.5),
a AS (SELECT root, count(*) AS n_events, count(hit) AS n_scored, coalesce(sum(hit), 0)::BIGINT AS n_correct FROM e GROUP BY root), b AS (SELECT *, n_correct / n_scored AS p, n_scored AS n, 1.959963984540054 AS z FROM a)
SELECT root, n_events, n_scored, n_correct, round(p, 6) AS accuracy, round((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) AS wilson_lo,
 round((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) AS wilson_hi, round((p - 0.5) / sqrt(0.25 / n), 6) + 0 AS z_vs_half, round((z + 0.8416212335729143) * sqrt(0.25 / n), 6) AS mde_80pct FROM b""",
)
def d10(spark, d):
    f = E.with_forward(X.with_flow(B.sigma_session(main_bars(spark, d), SPAN, WARM, GAP).withColumn("z", X.z_score()), params(spark)))
    return rounded(E.accuracy(E.scored(f.filter(F.abs("imbalance_t") > 0.5), (1,)), ["root"]).drop("wilson_half"))


@query("d10_d16_d20_cells", GATES + ", sd AS (SELECT *, root AS pool FROM sc UNION ALL SELECT *, 'all' FROM sc), " + _cells("pool, gate, tier, horizon", "sd") + f" SELECT pool, gate, tier, horizon, {_SHOWN} FROM cl")
def d16(spark, d):
    hits = E.scored(events(gated(spark, d))).withColumn("pool", F.explode(F.array("root", F.lit("all"))))
    return rounded(E.accuracy(hits, ["pool", "gate", "tier", "horizon"]))


@query("d13_d16_pooled")
def d13(spark, d):
    h = staged(E.scored(events(gated(spark, d)), (1,)))
    return rounded(E.accuracy(h, ["gate", "tier"]).join(E.bootstrap(h, ["gate", "tier"]), ["gate", "tier"], "left"))


@query(
    "d14_event_counts",
    GATES + f""", en AS (SELECT * FROM gt WHERE ts >= TIMESTAMP '{EVAL_FROM}'), sp AS (SELECT root, unnest(generate_series(date_trunc('month', TIMESTAMP '{EVAL_FROM}'), date_trunc('month', max(ts)), INTERVAL 1 MONTH)) AS month FROM en GROUP BY root),
mc AS (SELECT root, gate, tier, month, count(ev_ts) AS n FROM (SELECT DISTINCT root, gate, tier FROM ev) JOIN sp USING (root) LEFT JOIN (SELECT root, gate, tier, date_trunc('month', ts) AS month, ts AS ev_ts FROM ev) USING (root, gate, tier, month) GROUP BY ALL),
tt AS (SELECT root, count(DISTINCT sid) AS total_eval_sessions FROM en GROUP BY root), wi AS (SELECT root, gate, tier, count(DISTINCT sid) AS w FROM ev GROUP BY ALL)
SELECT root, gate, tier, sum(n)::BIGINT AS n_events, round(avg(n), 6) AS per_month_mean, round(stddev_samp(n), 6) AS per_month_std, total_eval_sessions, round(w / total_eval_sessions, 6) AS frac_sessions FROM mc JOIN tt USING (root) JOIN wi USING (root, gate, tier) GROUP BY ALL""",
)
def d14(spark, d):
    g = gated(spark, d)
    return rounded(E.event_counts(events(g), g, at(EVAL_FROM)))


@query(
    "d15_sanity",
    GATES + f""", en AS (SELECT * FROM gt WHERE ts >= TIMESTAMP '{EVAL_FROM}'), se AS (SELECT root, sid, min(ts) AS t0 FROM en GROUP BY root, sid QUALIFY row_number() OVER (PARTITION BY root ORDER BY min(ts)) <= 20),
sa AS (SELECT en.root, CASE WHEN sign(imbalance_t) <> 0 AND sign(fwd) <> 0 THEN (sign(imbalance_t) = sign(fwd))::INT END AS hit FROM en JOIN se USING (root, sid) JOIN fw ON en.root = fw.root AND en.ts = fw.ts AND horizon = 1), """ + _cells("root", "sa") + f" SELECT root, {_SHOWN} FROM cl",
)
def d15(spark, d):
    return rounded(E.sanity(gated(spark, d), at(EVAL_FROM)))


@query(
    "d17_cross_cutting",
    GATES + ", sh1 AS (SELECT * FROM sc WHERE horizon = 1), " + _cells("gate, tier", "sh1") + """, pa AS (SELECT tier, max(accuracy) FILTER (gate = 'A') AS a, max(accuracy) FILTER (gate = 'B') AS b, max(accuracy) FILTER (gate = 'C') AS c, max(n_events) FILTER (gate = 'A') AS na, max(n_events) FILTER (gate = 'C') AS nc FROM cl GROUP BY tier),
pt AS (SELECT gate, max(accuracy) FILTER (tier = 'primary') AS p, max(accuracy) FILTER (tier = 'secondary') AS s, max(n_events) FILTER (tier = 'primary') AS np, max(n_events) FILTER (tier = 'secondary') AS ns FROM cl GROUP BY gate)
SELECT 'gates ' || tier AS what, round(b - a, 6) + 0 AS "first", round(c - b, 6) + 0 AS "second", round(nc / na, 6) AS ratio FROM pa UNION ALL SELECT 'tiers ' || gate, round(p - s, 6) + 0, NULL, round(np / ns, 6) FROM pt""",
)
def d17(spark, d):
    return rounded(E.cross_cutting(cells(spark, d, "gate", "tier", horizons=(1,))))


@query(
    "d18_best",
    GATES + ", " + _cells("gate, tier, horizon") + f" SELECT gate, tier, horizon, {_SHOWN} FROM cl ORDER BY coalesce((z_vs_half >= 1.96 AND n_scored >= 100)::INT, 0) DESC, accuracy DESC NULLS LAST, gate, tier, horizon LIMIT 1",
)
def d18(spark, d):
    return rounded(E.best(cells(spark, d, "gate", "tier", "horizon")))


@query("d19_d20_horizon_decay", GATES + ", " + _cells("gate, tier, horizon") + " SELECT gate, tier, " + ", ".join(f'round(max(CASE WHEN horizon = {h} THEN accuracy END), 6) AS "{h}"' for h in (1, 3, 6, 12)) + " FROM cl GROUP BY ALL")
def d19(spark, d):
    return rounded(E.horizon_decay(cells(spark, d, "gate", "tier", "horizon")))


INPUTS = ["ln_s1", "ln_s2", "ln_s3", "vpin"]


def order_rows(spark, d) -> DataFrame:
    """Daily bars of orders with HAR lags and a five-bar target; seven years, one root per priority."""
    df = B.sigma_causal(B.bars(order_ticks(spark, d).withColumn("root", F.col("instrument_id")), 1440), SPAN)
    df = X.har_lags(df, "sigma", 5, 20).withColumn("imb", F.tanh(B.close_return()))
    df = X.forward_target(df.withColumn("vpin", X.vpin("imb", 10)), 5, "target")
    for i, c in enumerate(("sigma_lag1", "sigma_short", "sigma_long"), 1):
        df = df.withColumn(f"ln_s{i}", F.when(F.col(c) > 0, F.ln(c)))
    return M.training_rows(df, INPUTS, ["sigma_lag1", "sigma_short", "sigma_long"])


def planned(spark, d) -> tuple[DataFrame, M.Schedule]:
    """The rows of the forecasts, staged, and their folds."""
    rows = staged(order_rows(spark, d))
    return rows, M.schedule(M.folds(rows, 12, 2))


@query(
    "m4_folds",
    """WITH b AS (SELECT date_trunc('day', min(o_orderdate)) AS a, max(o_orderdate) AS z FROM orders), k AS (SELECT a, z, unnest(range(0, 200)) AS fold_id, a + INTERVAL 12 MONTH + INTERVAL 1 DAY AS f FROM b),
t AS (SELECT fold_id, a, z, f + to_months((2 * fold_id)::INT) AS ts, f + to_months((2 * (fold_id + 1))::INT) AS te FROM k) SELECT fold_id::INT AS fold_id, epoch(a)::BIGINT AS train_start, epoch(ts)::BIGINT - 1 AS train_end, epoch(ts)::BIGINT AS test_start, epoch(te)::BIGINT AS test_end FROM t WHERE te <= z""",
)
def m4(spark, d):
    f = M.folds(order_ticks(spark, d))
    return f.select("fold_id", *[seconds(c).alias(c) for c in ("train_start", "train_end", "test_start", "test_end")])


@query("m3_attrition", "SELECT * FROM (SELECT 0 AS step, 'priced' AS name, count(*) FILTER (o_totalprice > 1000) AS rows FROM orders UNION ALL SELECT 1, 'open', count(*) FILTER (o_totalprice > 1000 AND o_orderstatus = 'O') FROM orders)")
def m3(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return M.attrition(o, {"priced": F.col("o_totalprice") > 1000, "open": F.col("o_orderstatus") == "O"})


def _b3() -> str:
    """Least squares on three inputs by Cramer's rule over covariances."""
    c = lambda i, j: f"c{min(i, j)}{max(i, j)}"
    det = lambda m: f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
    full = [[c(i, j) for j in (1, 2, 3)] for i in (1, 2, 3)]
    put = lambda k: [[f"y{i + 1}" if j == k else full[i][j] for j in range(3)] for i in range(3)]
    return ", ".join(f"{det(put(k))} / {det(full)} AS k{k + 1}" for k in range(3))


#: tr: training rows; fr: rows of the folds with their part; pt: test rows with the three baselines; pv: medians of the training targets.
MODELS = (
    """WITH ob AS (SELECT o_orderpriority AS root, time_bucket(INTERVAL '1 day', o_orderdate) AS ts, first(o_totalprice::DOUBLE ORDER BY o_orderdate, o_orderkey) AS open, max(o_totalprice)::DOUBLE AS high, min(o_totalprice)::DOUBLE AS low,
 last(o_totalprice::DOUBLE ORDER BY o_orderdate, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY ALL), """
    + _ewma(f"lag({GK}) OVER ({W})", "root", SPAN, "ob", "og", 10)
    + f""", o2 AS (SELECT *, lag(sigma) OVER ({W}) AS l1, ln(close / lag(close) OVER ({W})) AS cr FROM og), o3 AS (SELECT *, cr * cr AS r2, abs(tanh(cr)) AS ai FROM o2),
o4 AS (SELECT root, ts, l1, {_full("avg", "l1", 5)} AS sh, {_full("avg", "l1", 20)} AS lo, {_full("avg", "ai", 10)} AS vpin, 0.5 * ln({_full("sum", "r2", 5, "ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING")}) AS target FROM o3),
tr AS (SELECT *, ln(l1) AS ln_s1, ln(sh) AS ln_s2, ln(lo) AS ln_s3 FROM o4 WHERE target IS NOT NULL AND vpin IS NOT NULL AND l1 > 0 AND sh > 0 AND lo > 0),
fb AS (SELECT date_trunc('day', min(ts)) AS a, max(ts) AS z FROM tr), fk AS (SELECT a, z, unnest(range(0, 200)) AS fold_id, a + INTERVAL 12 MONTH + INTERVAL 1 DAY AS f FROM fb),
ft AS (SELECT fold_id::INT AS fold_id, a, f + to_months((2 * fold_id)::INT) AS ts0, f + to_months((2 * (fold_id + 1))::INT) AS te FROM fk WHERE f + to_months((2 * (fold_id + 1))::INT) <= z),
f0 AS (SELECT fold_id, tr.*, CASE WHEN ts < ts0 THEN 'train' ELSE 'test' END AS part FROM tr JOIN ft ON ts >= a AND ts < te),
fr AS (SELECT * FROM f0 WHERE fold_id IN (SELECT fold_id FROM f0 GROUP BY fold_id HAVING count(*) FILTER (part = 'train') >= 50 AND count(*) FILTER (part = 'test') >= 10)),
pv AS (SELECT fold_id, median(target) AS mid FROM fr WHERE part = 'train' GROUP BY fold_id),
cv AS (SELECT fold_id, avg(target) AS m, avg(vpin) AS mv, avg(ln_s1) AS m1, avg(ln_s2) AS m2, avg(ln_s3) AS m3, covar_pop(vpin, vpin) AS vv, covar_pop(vpin, ln_s1) AS v1, covar_pop(vpin, target) AS yv,
 covar_pop(ln_s1, ln_s1) AS c11, covar_pop(ln_s1, ln_s2) AS c12, covar_pop(ln_s1, ln_s3) AS c13, covar_pop(ln_s2, ln_s2) AS c22, covar_pop(ln_s2, ln_s3) AS c23, covar_pop(ln_s3, ln_s3) AS c33, covar_pop(ln_s1, target) AS y1, covar_pop(ln_s2, target) AS y2, covar_pop(ln_s3, target) AS y3 FROM fr WHERE part = 'train' GROUP BY fold_id),
bt AS (SELECT *, (yv * c11 - y1 * v1) / (vv * c11 - v1 * v1) AS h1, (y1 * vv - yv * v1) / (vv * c11 - v1 * v1) AS h2, """
    + _b3()
    + """ FROM cv),
pt AS (SELECT fold_id, root, ts, target, round(ln(greatest(l1, 1e-10)) + 0.5 * ln(5), 9) AS b1, round(m + h1 * (vpin - mv) + h2 * (ln_s1 - m1), 9) AS b2, round(m + k1 * (ln_s1 - m1) + k2 * (ln_s2 - m2) + k3 * (ln_s3 - m3), 9) AS b3 FROM fr JOIN bt USING (fold_id) WHERE part = 'test')"""
)
#: me: metrics by fold, model and slice.
METRICS = MODELS + """, lo AS (SELECT fold_id, root, target, model, pred, unnest(['pooled', root]) AS slice FROM (SELECT fold_id, root, target, unnest(['b1', 'b2', 'b3']) AS model, unnest([b1, b2, b3]) AS pred FROM pt)),
rk AS (SELECT *, rank() OVER (k ORDER BY target) + (count(*) OVER (PARTITION BY fold_id, model, slice, target) - 1) / 2.0 AS ra, rank() OVER (k ORDER BY pred) + (count(*) OVER (PARTITION BY fold_id, model, slice, pred) - 1) / 2.0 AS rb FROM lo WINDOW k AS (PARTITION BY fold_id, model, slice)),
me AS (SELECT fold_id, model, slice, count(*) AS n, CASE WHEN count(*) >= 2 THEN covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) END AS rho, sqrt(avg((target - pred) ** 2)) AS rmse, avg(abs(target - pred)) AS mae, avg((sign(pred - mid) = sign(target - mid))::INT) AS hit_rate FROM rk JOIN pv USING (fold_id) GROUP BY ALL HAVING slice = 'pooled' OR count(*) >= 10)"""


def baselines(rows: DataFrame, plan: M.Schedule) -> DataFrame:
    """The test rows with three forecasts, rounded, so that the last bits of a sigma that stands still don't decide ranks."""
    rows = M.walk_forward(rows.withColumn("b1", M.persistence("sigma_lag1", 5)), plan, {"b2": ["vpin", "ln_s1"], "b3": ["ln_s1", "ln_s2", "ln_s3"]}, 50, 10)
    return rows.withColumns({b: F.round(b, 9) for b in ("b1", "b2", "b3")})


@query("m5_m9_baselines", MODELS + " SELECT fold_id, root, epoch(ts)::BIGINT AS t, round(target, 4) + 0 AS target, round(b1, 4) + 0 AS b1, round(b2, 4) + 0 AS b2, round(b3, 4) + 0 AS b3 FROM pt")
def m9(spark, d):
    return rounded(baselines(*planned(spark, d)).select("fold_id", "root", seconds("ts").alias("t"), "target", "b1", "b2", "b3"), 4)


def measured(spark, d) -> DataFrame:
    """Forecasts and metrics from one staged table of test rows."""
    rows, plan = planned(spark, d)
    tested = staged(baselines(rows, plan).select("fold_id", "root", "target", "b1", "b2", "b3"))
    return M.metrics(tested, ["b1", "b2", "b3"], staged(M.expanding_medians(rows, plan)))


@query("m14_m16_m18_metrics", METRICS + " SELECT fold_id, model, slice, n, round(rho, 6) + 0 AS rho, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(hit_rate, 6) AS hit_rate FROM me")
def m14(spark, d):
    return rounded(measured(spark, d))


@query(
    "m17_success",
    METRICS + """, dd AS (SELECT fold_id, slice, max(rho) FILTER (model = 'b3') - max(rho) FILTER (model = 'b1') AS d FROM me GROUP BY ALL), pd AS (SELECT avg(d) AS edge, avg((d > 0)::INT) AS won FROM dd WHERE slice = 'pooled'), rd AS (SELECT count(*) FILTER (d > 0) AS roots_won FROM (SELECT slice, avg(d) AS d FROM dd WHERE slice <> 'pooled' GROUP BY slice))
SELECT round(edge, 6) + 0 AS edge, round(won, 6) AS won, roots_won, edge >= 0.03 AND won >= 0.7 AND roots_won >= 2 AS passes FROM pd, rd""",
)
def m17(spark, d):
    return rounded(M.success(measured(spark, d), "b3", "b1"))


@query("m19_fold_deltas", METRICS + " SELECT fold_id, round(max(rho) FILTER (model = 'b3') - max(rho) FILTER (model = 'b1'), 6) + 0 AS delta FROM me WHERE slice = 'pooled' GROUP BY fold_id")
def m19(spark, d):
    return rounded(M.fold_deltas(measured(spark, d), "b3", "b1"))


@query("m28_sanity_flags", METRICS + " SELECT fold_id, model, round(rho, 6) + 0 AS rho, CASE WHEN rho IS NULL OR rho NOT BETWEEN -0.5 AND 0.99 THEN 'BLOCK' WHEN rho NOT BETWEEN 0 AND 0.9 THEN 'WARN' ELSE 'OK' END AS flag FROM me WHERE slice = 'pooled'")
def m28(spark, d):
    b = spark.createDataFrame([(m, 0.0, 0.9, -0.5, 0.99) for m in ("b1", "b2", "b3")], "model string, warn_low double, warn_high double, block_low double, block_high double")
    return rounded(M.sanity_flags(measured(spark, d), b))


@query(
    "m23_residuals",
    MODELS + """, hp AS (SELECT fold_id, quantile_cont(target, 0.9) AS p90 FROM pt GROUP BY fold_id),
rs AS (SELECT target - b3 AS e, unnest(['root ' || root, CASE WHEN target >= p90 THEN 'regime high' ELSE 'regime rest' END, CASE WHEN ts::DATE IN (DATE '1998-03-02', DATE '1999-06-01') THEN 'calendar day' ELSE 'other day' END]) AS slice FROM pt JOIN hp USING (fold_id))
SELECT slice, count(*) AS n, round(avg(e), 6) + 0 AS bias, round(stddev_samp(e), 6) AS std FROM rs GROUP BY slice""",
)
def m23(spark, d):
    cal = spark.createDataFrame([("1998-03-02",), ("1999-06-01",)], "day string").select(F.col("day").cast("date"))
    return rounded(M.residual_report(baselines(*planned(spark, d)), "b3", cal))


@query(
    "m24_deciles",
    MODELS + """, eg AS (SELECT fold_id, quantile_cont(target, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges, max(target) AS top FROM pt GROUP BY fold_id),
dc AS (SELECT *, len(list_filter(list_distinct(edges), lambda e: target > e AND e < top))::INT AS decile FROM pt JOIN eg USING (fold_id))
SELECT decile, count(*) AS n, round(avg(b1 - target), 6) + 0 AS bias_b1, round(stddev_samp(b1 - target), 6) AS std_b1, round(avg(b3 - target), 6) + 0 AS bias_b3, round(stddev_samp(b3 - target), 6) AS std_b3 FROM dc GROUP BY decile""",
)
def m24(spark, d):
    return rounded(M.deciles(baselines(*planned(spark, d)), ["b1", "b3"]))


@query(
    "m14_spearman",
    "WITH r AS (SELECT o_orderpriority AS root, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS a, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2.0 AS b FROM orders) SELECT root, round(corr(a, b), 6) + 0 AS rho FROM r GROUP BY root",
)
def spear(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").withColumnRenamed("o_orderpriority", "root")
    return rounded(M.spearman(o, ["root"], "o_totalprice", "o_custkey"))


@query("m27_target_stats", "SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.75), 4) AS p75, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, max(o_totalprice) AS max FROM orders")
def m27(spark, d):
    return rounded(M.target_stats(spark.read.parquet(f"{d}/orders.parquet"), "o_totalprice"), 4)


@query("m25_coverage", "SELECT coalesce(o_orderpriority, 'all') AS root, count(*) AS n, round(avg((o_totalprice <= o_custkey * 100.0)::INT), 6) AS coverage FROM orders GROUP BY ROLLUP (o_orderpriority)")
def m25(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("root"), F.col("o_totalprice").alias("target"), (F.col("o_custkey") * 100.0).alias("q"))
    return rounded(M.coverage(o, "q"))


@query(
    "m27_forecast_target",
    MODELS + " SELECT count(target) AS n, round(avg(target), 4) + 0 AS mean, round(stddev_samp(target), 4) AS std, round(min(target), 4) + 0 AS min, round(quantile_cont(target, 0.25), 4) + 0 AS p25, round(quantile_cont(target, 0.5), 4) + 0 AS p50, round(quantile_cont(target, 0.75), 4) + 0 AS p75, round(quantile_cont(target, 0.95), 4) + 0 AS p95, round(max(target), 4) + 0 AS max FROM tr",
)
def m27_target(spark, d):
    return rounded(M.target_stats(order_rows(spark, d)), 4)


#: The 17 inputs of the boosted models; the root is a category beside them.
BOOSTED = [*X.FLOW_FEATURES, *X.GEOMETRY, "sigma_lag1", "sigma_short", "sigma_long"]
#: Fewer rounds and smaller leaves than ``boosting.fit`` has by default: the test tables have a few thousand bars.
GROWN = dict(rounds=30, patience=6, rate=0.15, leaves=16, depth=4, least=20, least_train=50, least_test=10)


def pooled_rows(spark, d) -> DataFrame:
    """M1, M2: four-day bars of line items (root: line number, instrument: return flag) with all inputs and a five-bar target.

    The roots are pooled; each row belongs to its folds by time, and ties of a time are told apart by (ts, instrument_id, root).
    """
    ticks = line_ticks(spark, d)
    roots = [r[0] for r in ticks.select("root").distinct().orderBy("root").limit(256).collect()]
    laws = X.parameter_table(spark, [(r, 4.0 + 0.25 * i, 0.0, 0.9) for i, r in enumerate(roots)])  # C6: a law for each root
    at = lambda name: spark.createDataFrame([(r, "1992-01-01") for r in roots], f"root string, {name} string").withColumn(name, F.col(name).cast("timestamp_ntz"))
    df = X.feature_table(B.bars(ticks, 1440), laws, at("regime_start"), at("cutoff"), 5760, SPAN, WARM, 40 * 86400)
    df = X.forward_target(X.har_lags(df, "sigma_gk", 5, 10), 5, "target")
    return M.training_rows(df, BOOSTED, ["sigma_lag1", "sigma_short", "sigma_long"], valid="is_train_valid_bar").select("root", "instrument_id", "ts", "target", *BOOSTED)


def grown(spark, d, tau: float | None = None):
    """The quantised rows and the boosted models of all folds."""
    rows = staged(pooled_rows(spark, d))
    table = staged(M.folds(rows, 12, 2))
    first = table.agg(F.min("test_start")).first()[0]
    rows = G.quantised(rows, BOOSTED, "root", F.col("ts") < F.lit(first))
    return rows, G.fit(rows, table, categorical=True, tau=tau, **GROWN)


@query("m10_m13_boosted")
def m10(spark, d):
    rows, folds = grown(spark, d)
    return rounded(G.forecast(rows, folds).select("fold_id", "root", "instrument_id", seconds("ts").alias("t"), "target", "pred_gbt"))


@query("m20_m22_importance")
def m20(spark, d):
    _, folds = grown(spark, d)
    gains = staged(G.gains(spark, folds, [*BOOSTED, "root"]))
    watched = ["sigma_lag1", "sigma_short", "sigma_long", "imbalance_t", "root"]
    top = M.top_features(gains, 18).join(M.top_presence(gains, watched, 5), "feature", "left")
    return rounded(top.crossJoin(M.stability_summary(M.rank_stability(gains, 10))))


@query("m11_leaf_quantile")
def m11(spark, d):
    rows, folds = grown(spark, d, 0.9)
    return rounded(M.coverage(G.forecast(rows, folds, "pred_q"), "pred_q"))


@query("m12_m26_attributions")
def m12(spark, d):
    rows, folds = grown(spark, d)
    shares = staged(M.attribution_shares(G.attributions(rows, folds, [*BOOSTED, "root"])))
    families = {**dict.fromkeys(X.FLOW_FEATURES, "flow"), **dict.fromkeys(X.GEOMETRY, "geometry"), **dict.fromkeys(("sigma_lag1", "sigma_short", "sigma_long"), "volatility"), "root": "root"}
    own = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])[F.col("feature")]
    whole = M.family_shares(shares, families, "geometry").select("root", "family", F.col("share").alias("family_share"), "supported")
    return rounded(shares.withColumn("family", own).join(whole, ["root", "family"], "left"))
