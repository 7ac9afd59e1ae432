from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import fitting as Q
from barloom.operators import forecast as M
from barloom.operators import regime as R
from barloom.operators import validation as V


def sample(spark, n=4000, seed=3):
    """Student-t draws of two roots over 100 days."""
    rng = np.random.default_rng(seed)
    rows = []
    for root, nu, loc, scale in (("a", 4.0, 0.05, 0.9), ("b", 9.0, -0.1, 1.3)):
        z = loc + scale * rng.standard_t(nu, n)
        rows += [(root, "x", i, float(v)) for i, v in enumerate(z)]
    df = spark.createDataFrame(rows, "root string, instrument_id string, i int, z double")
    return df.withColumn("ts", (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("i") * 2160)).cast("timestamp_ntz")).drop("i")


@pytest.fixture(scope="module")
def drawn(spark):
    return sample(spark).cache()


def test_variants_are_fitted_on_common_rows(spark, drawn):
    df = drawn.withColumn("z2", F.when(F.col("z") > -3, F.col("z") * 1.001)).withColumn("z3", F.col("z") * 2)
    got = {(r.root, r.variant): r for r in Q.fit_variants(df, ["root"], {"first": "z", "near": "z2", "far": "z3"}).collect()}
    assert len({r.n for k, r in got.items() if k[0] == "a"}) == 1
    assert all(got[r, "first"].close and got[r, "near"].close and not got[r, "far"].close for r in "ab")
    assert abs(got["a", "far"].scale / got["a", "first"].scale - 2) < 1e-4


def test_grid_pivots_and_reconciliation(spark, drawn):
    by_gap = drawn.withColumn("bar_in_session", F.pmod(F.xxhash64("ts"), F.lit(100))).withColumn("gap", F.explode(F.array(F.lit(60), F.lit(120))))
    cells = Q.grid_cells(Q.sensitivity_grid(by_gap, [0, 50]), ["root"]).cache()
    assert cells.count() == 8 and cells.filter("ks IS NULL OR max_dev_left IS NULL").count() == 0
    pivot = {(r.root, r.gap): r for r in Q.grid_pivots(cells, ["root"], [0, 50]).collect()}
    assert pivot["a", 60]["0_n"] == 4000 > pivot["a", 60]["50_n"] > 1500 and pivot["a", 60]["0_nu"] == pivot["a", 120]["0_nu"]
    both = {(r.root, r.method): r for r in Q.reconciled({"all": drawn, "some": drawn.filter("z < 1")}, ["root"]).collect()}
    assert both["a", "all"].heavy and not both["b", "all"].heavy and len(both) == 4


def test_calibration_gives_every_variant_the_whole_bundle(spark, drawn):
    got = Q.calibration(drawn.withColumn("w", F.col("z") / 2), ["root"], {"one": "z", "two": "w"}).collect()
    assert len(got) == 4 and {r.shape for r in got} <= {"Flat", "U-shape", "Hump"}
    assert all(r.ks < 0.03 and r.shoulder_max is not None and r.n == 4000 for r in got)


def test_binned_windows_agree_with_exact_ones(spark, drawn):
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    w = drawn.select("root", at("2023-12-01").alias("s"), at("2024-02-01").alias("e")).distinct()  # bins are those of whole months
    fit = lambda binned: {r.root: r for r in R.window_fits(drawn, w, "s", "e", ["root"], 50, binned=binned).collect()}
    exact, binned = fit(False), fit(True)
    for r in "ab":
        assert abs(exact[r].nu / binned[r].nu - 1) < 0.02
        assert abs(exact[r]["loc"] - binned[r]["loc"]) < 0.002 and abs(exact[r].scale / binned[r].scale - 1) < 0.005


def test_halves_and_stability_by_days(spark, drawn):
    h = {(r.root, r.half): r.n for r in Q.halves(drawn, ["root"]).groupBy("root", "half").agg(F.count("*").alias("n")).collect()}
    assert h["a", "full"] == 4000 and h["a", "h1"] == h["a", "h2"] == 2000
    z = [r.z for r in drawn.filter("root = 'a'").orderBy("ts").collect()]
    got = V.stability(drawn, ["z"]).filter("root = 'a'").first()
    assert abs(got.mean_1 - np.mean(z[:2000])) < 1e-12 and abs(got.mean_2 - np.mean(z[2000:])) < 1e-12


def test_folds_from_running_sums_against_numpy(spark):
    """Least squares and medians of every expanding fold; a purge leaves rows in no part, and small folds go."""
    rng, n = np.random.default_rng(1), 2000
    x, day = rng.normal(size=(n, 3)), np.sort(rng.integers(0, 900, n))
    y = 1e6 + x @ [1.0, -0.5, 0.25] + rng.normal(size=n) * 0.1 + day * 0.01
    at = [datetime(2020, 1, 1) + timedelta(days=int(k), seconds=i) for i, k in enumerate(day)]
    df = spark.createDataFrame([(at[i], *map(float, x[i]), float(y[i])) for i in range(n)], "ts timestamp, a double, b double, c double, target double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for strict in (False, True):
        plan = M.schedule(M.folds(df, 12, 2, strict_purge=strict))
        got = M.walk_forward(df, plan, {"p": ["a", "b", "c"], "q": ["b"]}, 100, 95).toPandas()
        mid = {r.fold_id: r.pivot for r in M.expanding_medians(df, plan).collect()}
        t = df.select(M.micros("ts")).toPandas().iloc[:, 0].to_numpy()
        kept = set()
        for f, a, b, c, d in plan.folds:
            train, test = (t >= a) & (t <= b), (t >= c) & (t < d)
            assert abs(mid[f] - np.median(y[train])) < 1e-9
            if train.sum() < 100 or test.sum() < 95:
                continue
            kept.add(f)
            own = got[got.fold_id == f].sort_values("ts")
            for name, columns in (("p", [0, 1, 2]), ("q", [1])):
                beta = np.linalg.lstsq(np.c_[np.ones(train.sum()), x[train][:, columns]], y[train] - 1e6, rcond=None)[0]
                want = 1e6 + np.c_[np.ones(test.sum()), x[test][:, columns]] @ beta
                assert np.abs(own[name].to_numpy() - want[np.argsort(t[test], kind="stable")]).max() < 1e-6
        assert set(got.fold_id) == kept and 0 < len(kept) <= len(plan.folds)


def test_rank_correlation_with_ties_and_without_spread(spark):
    rows = [("a", 1.0, 2.0), ("a", 1.0, 3.0), ("a", 2.0, 3.0), ("a", 3.0, 9.0), ("b", 1.0, 5.0), ("b", 1.0, 6.0), ("c", 1.0, 1.0)]
    got = {r.k: r.rho for r in M.spearman(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert abs(got["a"] - np.corrcoef([1.5, 1.5, 3, 4], [1, 2.5, 2.5, 4])[0, 1]) < 1e-12 and got["b"] is None and got["c"] is None


def test_folds_have_no_upper_limit(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'1900-01-01 00:00:00' AS ts UNION ALL SELECT TIMESTAMP_NTZ'2020-06-01 00:00:00'")
    got = M.folds(df, 12, 1).agg(F.count("*").alias("n"), F.max("test_end").alias("z")).first()
    assert got.n == 1432 and str(got.z) == "2020-05-02 00:00:00"


def test_family_shares(spark):
    shares = spark.createDataFrame([("r", "s1", 3.0), ("r", "s2", 1.0), ("r", "v", 1.0), ("r", "root", 5.0)], "root string, feature string, mean_abs double")
    got = {r.family: r for r in M.family_shares(shares, {"s1": "sigma", "s2": "sigma", "v": "flow"}, "flow").collect()}
    assert got["sigma"].share == 0.8 and got["sigma"].supported is None and got["flow"].supported is True


def test_running_histograms_against_rows(spark):
    """Windows, segments, a break scan, months and the rule of the first acceptable cutoff, against fits and distances of the rows."""
    rng = np.random.default_rng(8)
    n = 12_000
    day, z = np.sort(rng.integers(0, 365, n)), 0.02 + 0.9 * rng.standard_t(4.5, n)
    z[day < 60] = rng.normal(size=(day < 60).sum()) * 2.5  # an unlike start
    rows = [("a", datetime(2021, 1, 1) + timedelta(days=int(k), seconds=i), float(v)) for i, (k, v) in enumerate(zip(day, z))]
    df = spark.createDataFrame(rows, "root string, ts timestamp, z double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).cache()
    at = lambda *m: spark.createDataFrame([("a", f"2021-{i:02d}-01", f"2021-{j:02d}-01" if j else None) for i, j in m], "root string, s string, e string").select("root", *[F.col(c).cast("timestamp_ntz").alias(c) for c in "se"])
    windows = at((1, 7), (4, 7), (6, None), (3, 10))
    exact, got = ({(str(r.s), str(r.e)): r for r in R.window_fits(df, windows, "s", "e", ["root", "s", "e"], 50, binned=b).collect()} for b in (False, True))
    assert len(got) == 4 and all(abs(exact[k].nu - got[k].nu) < 0.01 * max(1, exact[k].nu / 4) and exact[k].n == got[k].n and abs(exact[k].scale - got[k].scale) < 0.002 for k in got)
    assert all(sum(b.n for b in R.window_bins(R.running_histogram(df, 0.02), windows.filter(F.col("s") == F.lit(k[0]).cast("timestamp_ntz")), "s", "e").collect()) == exact[k].n for k in [("2021-04-01 00:00:00", "2021-07-01 00:00:00")])
    with pytest.raises(ValueError):
        R.window_fits(df, windows.withColumn("s", F.date_add("s", 3).cast("timestamp_ntz")), "s", "e", ["root", "s"], 50, binned=True)
    cut = at((2, None), (3, None), (4, None), (5, None)).select("root", F.col("s").alias("cutoff"))
    scan = {r.cutoff: r for r in R.break_scan(df, cut.select("cutoff")).collect()}
    sweep = R.sweep(df, cut, spark.createDataFrame([("a", 4.5)], "root string, nu double"), 50).cache()
    months = R.monthly_ks(df, sweep, 500).cache()
    for r in sweep.collect():
        fit = spark.createDataFrame([("a", r.nu, r["loc"], r.scale)], "root string, nu double, loc double, scale double")
        own = Q.pit_diagnostics(df.filter(F.col("ts") >= F.lit(r.cutoff)), fit, ["root"]).first()
        assert abs(own.ks - r.ks) < 0.001 and abs(scan[r.cutoff].post_ks - r.ks) < 1e-9 and abs(own.shoulder_rank - scan[r.cutoff].post_shoulder) < 0.002
        june = Q.pit_diagnostics(df.filter(F.month("ts") == 6), fit, ["root"]).first()
        assert abs(june.ks - months.filter(F.col("cutoff") == F.lit(r.cutoff)).filter(F.month("month") == 6).first().ks) < 0.001
    assert sum(r.winner for r in scan.values()) == 1
    # The rule with its own limits: the first cutoff after the unlike start, and none if months may not differ at all.
    assert [str(r.cutoff) for r in R.first_acceptable(sweep, months, 0.6).collect()] == ["2021-03-01 00:00:00"]
    assert R.first_acceptable(sweep, months, 0.6, 0.05, 0.001).count() == 0
    worst = {str(r.cutoff): r for r in R.rejections(months).collect()}
    assert str(worst["2021-02-01 00:00:00"].worst_month) == "2021-02-01" and not worst["2021-02-01 00:00:00"].passes
    limits = spark.createDataFrame([("a", 4.0, 0.05, 0.5, 1.0)], "root string, nu_floor double, ks_limit double, scale_low double, scale_high double")
    flags = R.refit_triggers(sweep, limits).collect()
    assert all(f.nu_low == (f.nu < 4.0) and f.ks_high == (f.ks > 0.05) and f.scale_drift == (not 0.5 <= f.scale <= 1.0) for f in flags)


def test_exact_distances_of_few_values(spark):
    # tabulated 5 % and 1 % points of the Kolmogorov distance, and the closed form for one and two values
    for n, d, p in [(5, 0.56328, 0.05), (10, 0.40925, 0.05), (20, 0.29408, 0.05), (20, 0.35241, 0.01), (50, 0.18841, 0.05), (100, 0.13403, 0.05)]:
        assert abs(Q.ks_exact(n, d) - p) < 2e-4
    assert abs(Q.ks_exact(1, 0.7) - 0.6) < 1e-12 and abs(Q.ks_exact(2, 0.6) - 2 * 0.4**2) < 1e-12
    rng = np.random.default_rng(3)
    u = np.sort(rng.random((40_000, 7)), axis=1)
    far = np.maximum(np.arange(1, 8) / 7 - u, u - np.arange(7) / 7).max(axis=1)
    assert abs((far > 0.4).mean() - Q.ks_exact(7, 0.4)) < 0.01
    df = spark.createDataFrame([("a", 7, 0.4, 0.5), ("b", 700, 0.04, 0.5)], "root string, n long, ks double, ks_p double")
    assert {r.root: round(r.ks_p, 6) for r in Q.with_exact_p(df).collect()} == {"a": round(Q.ks_exact(7, 0.4), 6), "b": 0.5}
