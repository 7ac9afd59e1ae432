import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.cdf import detectable_effect, normal_cdf, student_t_cdf, wilson, z_against_half
from barloom.functions.smoothing import ewm_std, ewma
from barloom.operators import bars as B
from barloom.operators import events as E
from barloom.operators import fitting as Q
from barloom.operators import forecast as M
from barloom.plans import market
from barloom.sources import ingest as S
from barloom.sources.stage import bucketed


@pytest.fixture(scope="module")
def series(spark):
    r = np.random.default_rng(0)
    rows = [("r", k, datetime.fromisoformat("2024-01-01") + timedelta(minutes=i), None if r.random() < 0.05 else float(r.normal(1, 2))) for k in ("a", "b") for i in range(900)]
    return pd.DataFrame(rows, columns=["root", "instrument_id", "ts", "x"]), spark.createDataFrame(rows, "root string, instrument_id string, ts timestamp_ntz, x double")


def test_ewma_is_pandas(series):
    pdf, df = series
    got = ewma(df, F.col("x"), "y", ["instrument_id"], ["ts"], 20, 30).toPandas().sort_values(["instrument_id", "ts"]).y.to_numpy()
    want = pdf.groupby("instrument_id").x.transform(lambda s: s.ewm(span=20, min_periods=30).mean()).to_numpy()
    assert np.array_equal(np.isnan(got), np.isnan(want)) and np.nanmax(np.abs(got - want)) < 1e-11


def test_ewm_std_and_recursive_form(series):
    pdf, df = series
    got = ewm_std(df, F.col("x"), "y", ["instrument_id"], ["ts"], 20, 10).toPandas().sort_values(["instrument_id", "ts"]).y.to_numpy()
    want = pdf.groupby("instrument_id").x.transform(lambda s: s.ewm(span=20, min_periods=10).std()).to_numpy()
    assert np.array_equal(np.isnan(got), np.isnan(want)) and np.nanmax(np.abs(got - want)) < 1e-9
    full = df.fillna(0.5, ["x"])
    got = ewma(full, F.col("x"), "y", ["instrument_id"], ["ts"], 10, adjust=False).toPandas().sort_values(["instrument_id", "ts"]).y.to_numpy()
    want = pdf.fillna({"x": 0.5}).groupby("instrument_id").x.transform(lambda s: s.ewm(span=10, adjust=False).mean()).to_numpy()
    assert np.max(np.abs(got - want)) < 1e-11


def test_distribution_functions(spark):
    xs = [-40.0, -3.0, -0.5, 0.0, 1.0, 8.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    three = lambda t: 0.5 + (math.atan(t / math.sqrt(3)) + t * math.sqrt(3) / (3 + t * t)) / math.pi
    for r in df.select("x", student_t_cdf("x", 3.0).alias("t"), normal_cdf("x").alias("n")).collect():
        assert abs(r.t - three(r.x)) < 1e-13 and abs(r.n - 0.5 * math.erfc(-r.x / math.sqrt(2))) < 1e-12


def test_edge_bars_and_sessions(spark):
    t = lambda m: datetime.fromisoformat("2024-01-01") + timedelta(minutes=m)
    rows = [("r", 1, t(0), 10.0, 10.0, 10.0, 10.0, 1), ("r", 1, t(15), 10.0, 12.0, 9.0, 11.0, 1), ("r", 1, t(31), 10.0, 30.0, 10.0, 30.0, 1)]
    df = spark.createDataFrame(rows, "root string, instrument_id int, ts timestamp_ntz, open double, high double, low double, close double, volume int")
    got = B.sessions(df.withColumn("gk", B.garman_klass()), 900).orderBy("ts").collect()
    assert [r.session_id for r in got] == [1, 1, 2] and got[0].gk is None
    assert abs(got[1].gk - (0.5 * math.log(12 / 9) ** 2 - (2 * math.log(2) - 1) * math.log(1.1) ** 2)) < 1e-12
    assert abs(got[2].gk - 0.5 * math.log(3) ** 2 + (2 * math.log(2) - 1) * math.log(3) ** 2) < 1e-12


def test_session_sigma_is_causal_and_isolated(spark):
    r = np.random.default_rng(1)
    rows = []
    for i in range(500):
        o, c = 100 + r.normal(), 100 + r.normal()
        ts = datetime.fromisoformat("2024-01-01") + timedelta(minutes=5 * i) + (timedelta(hours=2) if i >= 250 else timedelta())
        rows.append(("r", 1, ts, o, max(o, c) + 0.5, min(o, c) - 0.5, c, 1))
    kind = "root string, instrument_id int, ts timestamp_ntz, open double, high double, low double, close double, volume int"
    run = lambda x: B.sigma_session(spark.createDataFrame(x, kind), 20, 40, 3600).orderBy("ts").toPandas()
    whole, second = run(rows), run(rows[250:])
    assert whole.sigma[250:290].isna().all() and whole.warmup_valid.sum() == 2 * 210
    assert np.allclose(whole.sigma[250:], second.sigma, equal_nan=True, atol=1e-12)
    changed = rows[:300] + [(*x[:3], 1.0, 500.0, 1.0, 400.0, 1) for x in rows[300:]]
    assert np.allclose(run(changed).sigma[:301], whole.sigma[:301], equal_nan=True)


def test_fit_recovers_parameters(spark):
    r = np.random.default_rng(2)
    rows = [(g, float(m + s * r.standard_t(nu))) for g, nu, m, s in (("a", 4.6, 0.01, 0.85), ("b", 3.0, -0.2, 1.5)) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "root string, z double")
    fits = {x.root: x for x in Q.fit_student_t(df, ["root"]).collect()}
    assert abs(fits["a"].nu - 4.6) < 0.4 and abs(fits["a"].scale - 0.85) < 0.03 and abs(fits["b"].nu - 3.0) < 0.2 and abs(fits["b"].loc + 0.2) < 0.05
    d = {x.root: x for x in Q.pit_diagnostics(df, Q.fit_student_t(df, ["root"]), ["root"]).collect()}
    assert d["a"].ks < 0.015 and d["a"].ks_p > 0.001
    assert all(x.passes for x in Q.shoulder(df, Q.fit_student_t(df, ["root"]), ["root"]).collect())


def test_event_edges(spark):
    """A null bar before in the same session is no edge; one of another session is."""
    t = lambda m: datetime.fromisoformat("2024-02-01") + timedelta(minutes=m)
    d = [(1, None), (1, 9.0), (1, 1.0), (1, 9.0), (1, 9.0), (0, None), (2, 9.0), (2, 1.0), (2, 9.0)]
    rows = [("r", 1, t(i), s, 1.0, 0.1, "A", x) for i, (s, x) in enumerate(d)]
    g = spark.createDataFrame(rows, "root string, instrument_id int, ts timestamp_ntz, session_id long, close double, imbalance_t double, gate string, d double")
    lim = spark.createDataFrame([("r", "A", "primary", 5.0)], "root string, gate string, tier string, threshold double")
    at = lambda first: sorted((r.ts.minute) for r in E.rising(g, lim, F.lit("2024-01-01").cast("timestamp_ntz"), first).collect())
    assert at(False) == [3, 6, 8] and at(True) == [3, 6]


def test_published_intervals(spark):
    r = spark.createDataFrame([(2050, 4249)], "k long, n long")
    lo, hi = wilson(F.col("k"), F.col("n"))
    got = r.select(lo.alias("lo"), hi.alias("hi"), z_against_half(F.col("k"), F.col("n")).alias("z"), detectable_effect(F.col("n")).alias("m")).first()
    p, n, z = 2050 / 4249, 4249, 1.959963984540054
    mid, half = (p + z * z / 2 / n) / (1 + z * z / n), z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n) / (1 + z * z / n)
    assert abs(got.lo - mid + half) < 1e-12 and abs(got.hi - mid - half) < 1e-12 and abs(got.z - (p - 0.5) / math.sqrt(0.25 / n)) < 1e-12


def test_thirty_one_folds(spark):
    df = spark.createDataFrame([(datetime.fromisoformat("2020-01-02 00:05"),), (datetime.fromisoformat("2026-04-14 20:00"),)], "ts timestamp_ntz")
    got = M.folds(df).orderBy("fold_id").collect()
    assert len(got) == 31 and str(got[0].test_start) == "2021-01-03 00:00:00" and str(got[0].train_end) == "2021-01-02 23:59:59"


def test_symbols(spark):
    df = spark.createDataFrame([("ESH0", True), ("ESH0-ESM0", False), ("XXH0", False), ("RTYZ9", True), ("ESG1", False)], "symbol string, ok boolean")
    assert all(r.ok == r.got for r in df.select("ok", S.is_outright().alias("got")).collect())
    f = spark.range(1).select(S.third_friday(F.lit(2020), F.lit(6)).alias("a"), S.third_friday(F.lit(2021), F.lit(1)).alias("b"), S.contract_year(F.lit(5), F.lit(2020), F.lit(2020)).alias("tie")).first()
    assert (str(f.a), str(f.b), f.tie) == ("2020-06-19", "2021-01-15", 2015)
    with pytest.raises(Exception):
        S.typed_ids(spark.createDataFrame([("x",)], "instrument_id string")).collect()


def test_files_round_trip(spark, tmp_path):
    rows = [("2024-01-02T00:00:00.000000001Z", 1, 1, "7", 1.0, 2.0, 0.5, 1.5, 10, "ESH4")]
    spark.createDataFrame(rows, S.RAW).write.option("header", True).csv(str(tmp_path / "raw"))
    df = S.typed_ids(S.scan_csv(spark, str(tmp_path / "raw"))).withColumn("ts_event", S.utc_timestamp("ts_event"))
    typed = S.resolved(df)
    assert typed.first().symbol == "ESH2024" and str(typed.first().expiry_date) == "2024-03-15"
    S.write_typed(typed, str(tmp_path / "typed"))
    assert S.scan_parquet(spark, str(tmp_path / "typed"), "symbol", "contract_root").first().contract_root == "ES"
    again = [S.read_through(spark, str(tmp_path / "z"), lambda: spark.range(3)).count() for _ in range(2)]
    S.write_results(spark.range(2), str(tmp_path / "c"), "csv")
    assert again == [3, 3] and spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_read_through_knows_its_inputs(spark, tmp_path):
    at, source = str(tmp_path / "cache"), str(tmp_path / "in")
    spark.range(3).write.parquet(source)
    calls = []

    def compute(n):
        calls.append(n)
        return spark.read.parquet(source).limit(n)

    read = lambda n: S.read_through(spark, at, lambda: compute(n), [source], n=n).count()
    assert [read(2), read(2), read(1), read(2)] == [2, 2, 1, 2] and calls == [2, 1]  # a parameter is another table
    spark.range(5).write.mode("overwrite").parquet(source)
    assert read(5) == 5 and read(2) == 2 and calls == [2, 1, 5, 2]  # so are changed files

    def broken():
        return spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))

    with pytest.raises(Exception, match="lost"):
        S.read_through(spark, at, broken, [source], n=0)
    assert read(0) == 0 and calls[-1] == 0  # nothing of the broken write is taken for the table
    assert not [p for p in (tmp_path / "cache").iterdir() if p.name.startswith("_")]


def test_bucketed_bars_need_no_exchange(spark, tmp_path):
    sub = bucketed(market.sub_bars(spark, "/root/testdata/sf0.001"), 3)
    df = market.features_of(spark, sub)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" in plan
    files = {r[0] for r in sub.select(F.input_file_name()).distinct().collect()}
    assert 0 < len(files) <= 3
    a, b = (x.select("root", "ts", F.round("z", 9), F.round("subbar_imbalance", 9), "is_valid_bar") for x in (df, market.features(spark, "/root/testdata/sf0.001")))
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_streaming_bars_match_batch(spark, tmp_path):
    from barloom.sources.tables import event_ticks
    from barloom.streaming.bars import streaming_bars

    ticks = event_ticks(spark, "/root/testdata/sf0.001")
    ticks.write.parquet(str(tmp_path / "in"))
    q = streaming_bars(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp")), 60).writeStream.format("memory").queryName("bars_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("bars_out")
    assert 0 < got.count() <= B.bars(ticks, 60).count()
    assert got.withColumn("ts", F.col("ts").cast("timestamp_ntz")).select("root", "ts", "close").exceptAll(B.bars(ticks, 60).select("root", "ts", "close")).count() == 0
