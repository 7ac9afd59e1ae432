import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.cdf import incomplete_beta, log_gamma, two_sided_t
from barloom.operators import events as E
from barloom.operators import regime as R


def test_few_positive_values_are_an_error_wherever_thresholds_are_read(spark):
    rows = [("r", "i", i, 1, 1.0, 1.0, "A", float(i)) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "root string, instrument_id string, s int, session_id int, close double, imbalance_t double, gate string, d double").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    at = lambda s: F.timestamp_seconds(F.lit(s)).cast("timestamp_ntz")
    few = E.thresholds(df, at(0), at(100), 100)
    for read in (few.select("root", "gate", "tier", "threshold"), E.rising(df, few, at(0))):
        with pytest.raises(Exception, match="too few positive values"):
            read.collect()
    assert E.thresholds(df, at(0), at(100), 8).count() == 2


def test_bootstrap_by_counts_against_resampled_rows(spark):
    rng = np.random.default_rng(5)
    hit = (rng.random(700) < 0.46).astype(int)
    rows = [("A", int(h)) for h in hit] + [("B", 1)] * 5 + [("C", None)] * 3
    got = {r.gate: r for r in E.bootstrap(spark.createDataFrame(rows, "gate string, hit int"), ["gate"], 4000).collect()}
    means = rng.choice(hit, (4000, 700)).mean(axis=1)
    assert abs(got["A"].boot_mean - hit.mean()) < 0.002
    assert np.abs(np.quantile(means, [0.025, 0.975]) - [got["A"].boot_lo, got["A"].boot_hi]).max() < 0.005
    assert got["B"].boot_lo == got["B"].boot_hi == 1.0 and "C" not in got


def test_binomial_draws_invert_the_distribution():
    n, k = 12, 5
    cdf = np.cumsum([math.comb(n, j) * (k / n) ** j * (1 - k / n) ** (n - j) for j in range(n + 1)])
    u = np.linspace(0.001, 0.999, 200)
    assert (E.binomial_draws(n, k, u) == np.searchsorted(cdf, u)).all()
    big = E.binomial_draws(5_000_000, 2_000_000, np.random.default_rng(1).random(4000))
    assert abs(big.mean() - 2e6) < 60 and abs(big.std() / math.sqrt(5e6 * 0.24) - 1) < 0.05


def test_incomplete_beta_and_student_tails(spark):
    # I_x(a, b) for whole a and b is a binomial sum
    rows = [(a, b, x) for a in (1, 2, 7, 40) for b in (1, 3, 25) for x in (0.0, 0.01, 0.3, 0.5, 0.9, 1.0)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, b double, x double")
    for r in df.select("a", "b", "x", incomplete_beta(F.col("a"), F.col("b"), F.col("x")).alias("v")).collect():
        n = int(r.a + r.b) - 1
        assert abs(r.v - sum(math.comb(n, j) * r.x**j * (1 - r.x) ** (n - j) for j in range(int(r.a), n + 1))) < 1e-12
    # tabulated two-sided 5 % and 1 % points of the t law
    table = [(1, 12.7062, 0.05), (5, 2.570582, 0.05), (10, 3.169273, 0.01), (30, 2.042272, 0.05), (40, 2.704459, 0.01), (120, 1.97993, 0.05), (1000, 2.580755, 0.01), (100000, 1.959988, 0.05)]
    got = spark.createDataFrame([(float(n), t, p) for n, t, p in table], "n double, t double, p double").select("p", two_sided_t(F.col("t"), F.col("n")).alias("v")).collect()
    assert all(abs(r.v - r.p) < 2e-6 for r in got)
    assert all(abs(r[1] - math.lgamma(r[0])) < 1e-11 * max(1, abs(r[1])) for r in df.select(F.col("a") / 3, log_gamma(F.col("a") / 3)).collect())


def test_trend_of_many_points(spark):
    rng = np.random.default_rng(2)
    y = 0.01 * np.arange(60) + rng.normal(size=60)
    rows = [("a", float(i), float(v)) for i, v in enumerate(y)] + [("b", float(i), 2.0 * i) for i in range(5)]
    got = {r.root: r for r in R.trend(spark.createDataFrame(rows, "root string, x double, y double"), ["root"], "x", "y").collect()}
    r = np.corrcoef(np.arange(60), y)[0, 1]
    t, grid = abs(r) * math.sqrt(58 / (1 - r * r)), np.linspace(0, math.pi / 2, 400_001)
    density = np.cos(grid) ** 57  # t = sqrt(58) tan(angle)
    beyond = grid > math.atan(t / math.sqrt(58))
    assert abs(got["a"].p - density[beyond].sum() / density.sum()) < 1e-4
    assert got["b"].p < 1e-9 and abs(got["b"].slope - 2) < 1e-12


def test_published_cells(spark):
    """Counts of the pooled cells at the first horizon, and what was published for them."""
    cells = {
        ("A", "primary"): (4249, 2050, 0.4824664626971052, 0.4674643192078746, 0.497500281179247, 0.4678689103318428, 0.4991821605083549, -2.285824603127426, 0.021489706105103142),
        ("A", "secondary"): (4489, 2166, 0.48251280908888394, 0.46791635532452974, 0.497139166567576, 0.4684729338382713, 0.4967698819336155, -2.3432835820895517, 0.020907352373977374),
        ("B", "primary"): (4424, 2135, 0.4825949367088608, 0.4678916908736395, 0.4973283827373484, 0.46903254972875225, 0.4968467450271247, -2.3153314003984127, 0.02106038385191233),
    }
    rows = [(g, t, int(i < k)) for (g, t), (n, k, *_) in cells.items() for i in range(n)]
    hits = spark.createDataFrame(rows, "gate string, tier string, hit int").cache()
    got = {(r.gate, r.tier): r for r in E.accuracy(hits, ["gate", "tier"]).join(E.bootstrap(hits, ["gate", "tier"]), ["gate", "tier"]).collect()}
    for key, (n, k, p, lo, hi, boot_lo, boot_hi, z, mde) in cells.items():
        r = got[key]
        assert (r.n_scored, r.n_correct) == (n, k)
        assert max(abs(a - b) for a, b in zip((r.accuracy, r.wilson_lo, r.wilson_hi, r.z_vs_half), (p, lo, hi, z))) < 1e-9
        assert abs(r.mde_80pct - mde) < 3e-5  # the published table rounds the two quantiles
        assert abs(r.boot_lo - boot_lo) < 0.002 and abs(r.boot_hi - boot_hi) < 0.002
