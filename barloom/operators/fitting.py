"""Student-t fits of many groups at once, and their diagnostics.

A group is any tuple of key columns (root, year, window, variant, half ...). The driver sees only parameter and sum
tables, one row per group.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.cdf import normal_cdf, student_t_cdf, t_constants
from barloom.functions.safe import correlation, ratio, sign
from barloom.operators.bars import sigma_session
from barloom.operators.flow import clean_z, z_score
from barloom.sources.stage import staged

NU_MAX = 1e3


def _digamma(x: float) -> tuple[float, float]:
    """psi and its derivative, by recurrence and asymptotic series."""
    p = q = 0.0
    while x < 12:
        p, q, x = p - 1 / x, q + 1 / (x * x), x + 1
    i = 1 / (x * x)
    p += math.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240)))
    q += 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))
    return p, q


def _step(s, nu: float, sd: float) -> np.ndarray:
    """A damped Newton step on (log nu, mu, log sigma) from a group's sums."""
    (p1, q1), (p0, q0) = _digamma((nu + 1) / 2), _digamma(nu / 2)
    g_nu = s.n * 0.5 * (p1 - p0 - 1 / nu) + s.a
    h_nu = s.n * (0.25 * (q1 - q0) + 0.5 / nu**2) + s.b
    g = np.array([nu * g_nu, s.wu / sd, s.wuu - s.n])
    hm = np.array([
        [nu * nu * h_nu + nu * g_nu, -nu * s.luv / sd, -nu * s.uluv],
        [0, s.luu / sd**2, (s.uluu - s.wu) / sd],
        [0, 0, s.uuluu - s.wuu],
    ])
    hm = np.triu(hm) + np.triu(hm, 1).T
    values, vectors = np.linalg.eigh(-hm)
    step = vectors @ ((vectors.T @ g) / np.maximum(np.abs(values), 1e-9))
    return step * min(1.0, 0.7 / max(np.abs(step).max(), 1e-12))


FIT = "nu double, loc double, scale double, n long"


def fit_student_t(df: DataFrame, keys: list[str], z: str = "z", weight: str | None = None, minimum: int = 50, rounds: int = 30) -> DataFrame:
    """(keys, nu, loc, scale, n) of each group of clean z with at least ``minimum`` rows; others are null.

    One aggregation of 11 sums per round for all groups together; rows are persisted for the rounds. Groups near the
    normal law stop at nu = 1000.
    """
    spark = df.sparkSession
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = clean_z(df, z).select(F.struct(*keys).alias("g"), F.col(z).alias("z"), w.alias("k")).persist()
    try:
        base = rows.groupBy("g").agg(F.sum("k").alias("n")).collect()
        kind = rows.select("g").schema
        params = {r.g: [6.0, 0.0, 1.0] for r in base if r.n >= minimum}
        moving = set(params)
        nu, mu, sd = F.col("nu"), F.col("mu"), F.col("sd")
        u = (F.col("z") - mu) / sd
        for _ in range(rounds):
            if not moving:
                break
            table = spark.createDataFrame([(g, *params[g]) for g in moving], kind.add("nu", "double").add("mu", "double").add("sd", "double"))
            kind = rows.select("g").schema
            t = rows.join(F.broadcast(table), "g").withColumn("u", u).withColumn("q", nu + F.col("u") * F.col("u"))
            uu, q = F.col("u") * F.col("u"), F.col("q")
            t = t.withColumn("w", (nu + 1) / q).withColumn("luu", -(nu + 1) * (nu - uu) / (q * q)).withColumn("luv", F.col("u") * (1 - uu) / (q * q))
            add = lambda c, name: F.sum(F.col("k") * c).alias(name)
            sums = t.groupBy("g").agg(
                add(F.lit(1.0), "n"), add(F.col("w") * F.col("u"), "wu"), add(F.col("w") * uu, "wuu"), add(0.5 * (nu + 1) * uu / (nu * q) - 0.5 * F.log1p(uu / nu), "a"), add(uu / (nu * q) - 0.5 * (nu + 1) * uu * (q + nu) / (nu * nu * q * q), "b"),
                add(F.col("luu"), "luu"), add(F.col("luu") * F.col("u"), "uluu"), add(F.col("luu") * uu, "uuluu"), add(F.col("luv"), "luv"), add(F.col("luv") * F.col("u"), "uluv"),
            ).collect()
            for s in sums:
                p = params[s.g]
                d = _step(s, p[0], p[2])
                params[s.g] = [float(x) for x in (min(p[0] * math.exp(d[0]), NU_MAX), p[1] + d[1], p[2] * math.exp(d[2]))]
                if np.abs(d).max() < 1e-7 or params[s.g][0] >= NU_MAX:
                    moving.discard(s.g)
        schema = rows.select("g.*").schema
        for name in ("nu", "loc", "scale"):
            schema = schema.add(name, "double")
        return spark.createDataFrame([(*r.g, *(params.get(r.g) or [None] * 3), int(r.n)) for r in base], schema.add("n", "long"))
    finally:
        rows.unpersist()


def with_constants(fits: DataFrame) -> DataFrame:
    """fits with t_c, each row's density constant."""
    return fits.withColumn("t_c", t_constants(F.col("nu")))


def pit(df: DataFrame, fits: DataFrame, keys: list[str], z: str = "z") -> DataFrame:
    """clean z with u, its probability under the group's fit."""
    table = with_constants(fits).select(*keys, "nu", "loc", "scale", "t_c")
    df = clean_z(df, z).join(F.broadcast(table.filter("nu IS NOT NULL")), keys)
    return df.withColumn("u", student_t_cdf(z, F.col("nu"), F.col("loc"), F.col("scale"), F.col("t_c")))


def ranked(df: DataFrame, keys: list[str], value: str, unit: Column, buckets: int = 1024, drop: bool = True) -> DataFrame:
    """df with i (1-based rank in the group) and total. ``unit`` in [0, 1] must rise with value: it deals a group's rows
    over many tasks; the offsets come from the small table of bucket counts."""
    df = df.withColumn("_b", F.least(F.floor(unit * buckets), F.lit(buckets - 1)))
    counts = df.groupBy(*keys, "_b").count()
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_o", F.coalesce(F.sum("count").over(before), F.lit(0))).withColumn("total", F.sum("count").over(Window.partitionBy(*keys))).drop("count")
    df = df.join(counts, [*keys, "_b"])
    df = df.withColumn("i", F.col("_o") + F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(value))).drop("_o")
    return df.drop("_b") if drop else df


def ks_p(d: Column, n: Column) -> Column:
    """The asymptotic probability of a larger Kolmogorov distance."""
    x = F.greatest(F.sqrt(n.cast("double")) * d, F.lit(0.2))
    total = sum((((-1.0) ** (k - 1)) * 2 * F.exp(-2.0 * k * k * x * x) for k in range(1, 31)), F.lit(0.0))
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def ks_exact(n: int, d: float) -> float:
    """P(a larger Kolmogorov distance than d) of n values, exact: the n-th power of a banded matrix of step counts
    (Marsaglia, Tsang and Wang 2003)."""
    if d >= 1:
        return 0.0
    if d <= 0.5 / n:
        return 1.0
    k = math.ceil(n * d)
    m, h = 2 * k - 1, k - n * d
    a = np.tril(np.ones((m, m)), 1)
    powers = h ** np.arange(1, m + 1)
    a[:, 0] -= powers
    a[-1] -= powers[::-1]
    a[-1, 0] += max(2 * h - 1, 0.0) ** m
    steps = np.arange(m)[:, None] - np.arange(m)[None] + 1
    a /= np.array([math.factorial(s) if s > 0 else 1 for s in range(m + 1)], float)[np.clip(steps, 0, m)]
    # Powers by squaring; a common factor is kept apart, so that nothing overflows.
    out, scale, base, base_scale, e = np.eye(m), 0.0, a, 0.0, n
    while e:
        if e & 1:
            out, scale = out @ base, scale + base_scale
        base, base_scale, e = base @ base, 2 * base_scale, e >> 1
        size = np.abs(base).max()
        base, base_scale = base / size, base_scale + math.log(size)
    p = out[k - 1, k - 1]
    return 1.0 - math.exp(math.log(p) + scale + math.lgamma(n + 1) - n * math.log(n)) if p > 0 else 1.0


def with_exact_p(diagnostics: DataFrame, below: int = 100) -> DataFrame:
    """the table (a row for each group: n, ks, ks_p) with exact probabilities where n is under ``below``."""

    def run(frames):
        for f in frames:
            few = (f.n < below) & f.ks.notna()
            f.loc[few, "ks_p"] = [ks_exact(int(n), float(d)) for n, d in zip(f.n[few], f.ks[few])]
            yield f

    return diagnostics.mapInPandas(run, diagnostics.schema)


def pit_diagnostics(df: DataFrame, fits: DataFrame, keys: list[str], z: str = "z") -> DataFrame:
    """Kolmogorov distance and p-value, tail and middle densities, shape, and the rank-form shoulder."""
    r = ranked(pit(df, fits, keys, z), keys, "u", F.col("u"))
    n, i, u = F.col("total"), F.col("i"), F.col("u")
    share = lambda c: F.avg(c.cast("double"))
    band = F.abs(F.col(z)).between(1.0, 3.0)
    out = r.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max(F.greatest(i / n - u, u - (i - 1) / n)).alias("ks"), (share(u < 0.1) * 10).alias("left_tail"), (share(u > 0.9) * 10).alias("right_tail"),
        (share((u > 0.4) & (u < 0.6)) * 5).alias("mid"), F.max(F.when(band, F.abs(i / n - u))).alias("shoulder_rank"),
    )
    tail = (F.col("left_tail") + F.col("right_tail")) / 2
    shape = F.when(tail > F.col("mid") * 1.03, "U-shape").when(F.col("mid") > tail * 1.03, "Hump").otherwise("Flat")
    return out.withColumn("ks_p", ks_p(F.col("ks"), F.col("n"))).withColumn("asymmetry", F.col("left_tail") - F.col("right_tail")).withColumn("shape", shape)


def ecdf_grid(df: DataFrame, fits: DataFrame, keys: list[str], low: float, high: float, points: int, z: str = "z") -> DataFrame:
    """(keys, k, x, ecdf, ...parameters): the empirical distribution i/(n+1), interpolated on an even grid; 0 and 1 outside.

    Each row fills the grid points up to its neighbour's value, so no range join is needed.
    """
    step = (high - low) / (points - 1)
    r = ranked(pit(df, fits, keys, z), keys, z, F.col("u"), drop=False)
    # The next value is in the same bucket, or the least one of the next bucket that has rows.
    least = r.groupBy(*keys, "_b").agg(F.min(z).alias("_least"))
    least = least.withColumn("_next", F.lead("_least").over(Window.partitionBy(*keys).orderBy("_b"))).drop("_least")
    rows = Window.partitionBy(*keys, "_b").orderBy("i")
    r = r.join(least, [*keys, "_b"]).withColumn("ahead", F.coalesce(F.lead(z).over(rows), "_next")).withColumn("first", F.col("i") == 1)
    cell = lambda c: F.ceil((c - low) / step)
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    here, end = F.greatest(cell(F.col(z)), F.lit(0)), F.lit(points - 1).cast("long")
    own = span(here.cast("long"), F.least(F.coalesce(cell(F.col("ahead")) - 1, end), end).cast("long"))
    before = F.when(F.col("first"), span(F.lit(0).cast("long"), F.least(here - 1, end).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    at = F.concat(F.transform(before, lambda k: F.struct(k.alias("k"), F.lit(True).alias("under"))), F.transform(own, lambda k: F.struct(k.alias("k"), F.lit(False).alias("under"))))
    r = r.select(*keys, F.col(z).alias("z0"), "ahead", "i", "total", "nu", "loc", "scale", "t_c", F.explode(at).alias("p"))
    x = low + F.col("p.k") * step
    inside = (F.col("i") + F.coalesce(F.try_divide(x - F.col("z0"), F.col("ahead") - F.col("z0")), F.lit(0.0))) / (F.col("total") + 1)
    ecdf = F.when(F.col("p.under"), 0.0).when(F.col("ahead").isNull() & (x > F.col("z0")), 1.0).otherwise(inside)
    return r.select(*keys, F.col("p.k").alias("k"), x.alias("x"), ecdf.alias("ecdf"), "nu", "loc", "scale", "t_c")


def shoulder(df: DataFrame, fits: DataFrame, keys: list[str], low: float = 1.0, high: float = 3.0, points: int = 500, z: str = "z") -> DataFrame:
    """the largest distance between the interpolated and the fitted distribution on either shoulder."""
    out = None
    for name, a, b in (("right", low, high), ("left", -high, -low)):
        g = ecdf_grid(df, fits, keys, a, b, points, z)
        g = g.groupBy(*keys).agg(F.max(F.abs(F.col("ecdf") - student_t_cdf("x", F.col("nu"), F.col("loc"), F.col("scale"), F.col("t_c")))).alias(f"max_dev_{name}"))
        out = g if out is None else out.join(g, keys)
    return out.withColumn("passes", F.greatest("max_dev_right", "max_dev_left") < 0.01)


def residual_curve(df: DataFrame, fits: DataFrame, keys: list[str], points: int = 1000, z: str = "z") -> DataFrame:
    """the empirical distribution less the Student-t and less the normal law, on [-4, 4]. Where all z of a group are
    equal, the normal law is a step: 0 before them, 1 after, one half at them."""
    moments = clean_z(df, z).groupBy(*keys).agg(F.avg(z).alias("m"), F.stddev_pop(z).alias("sd"))
    g = ecdf_grid(df, fits, keys, -4.0, 4.0, points, z).join(F.broadcast(moments), keys)
    t = student_t_cdf("x", F.col("nu"), F.col("loc"), F.col("scale"), F.col("t_c"))
    d = F.col("x") - F.col("m")
    step = F.when(d > 0, float("inf")).when(d < 0, float("-inf")).otherwise(float("nan"))
    v = F.when(F.col("sd") == 0, step).otherwise(ratio(d, "sd"))
    return g.select(*keys, "k", "x", (F.col("ecdf") - t).alias("minus_t"), (F.col("ecdf") - normal_cdf(v)).alias("minus_normal"))


def pit_histogram(df: DataFrame, fits: DataFrame, keys: list[str], bins: int = 50, z: str = "z") -> DataFrame:
    """the density of u in equal bins."""
    p = pit(df, fits, keys, z).withColumn("bin", F.least(F.floor(F.col("u") * bins), F.lit(bins - 1)))
    p = p.groupBy(*keys, "bin").count()
    return p.withColumn("density", F.col("count") * bins / F.sum("count").over(Window.partitionBy(*keys)))


def halves(df: DataFrame, keys: list[str], z: str = "z") -> DataFrame:
    """clean z with ``half``: full, h1, h2, by place in time order (E15). Places are dealt over days, not over whole groups."""
    c = clean_z(df, z).withColumn("_d", F.to_date("ts"))
    days = c.groupBy(*keys, "_d").count()
    before = Window.partitionBy(*keys).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_o", F.coalesce(F.sum("count").over(before), F.lit(0))).withColumn("_n", F.sum("count").over(Window.partitionBy(*keys))).drop("count")
    place = F.col("_o") + F.row_number().over(Window.partitionBy(*keys, "_d").orderBy("ts", "instrument_id"))
    part = F.when(place <= F.floor(F.col("_n") / 2), "h1").otherwise("h2")
    c = c.join(days, [*keys, "_d"]).withColumn("_h", part)
    return c.withColumn("half", F.explode(F.array(F.lit("full"), "_h"))).drop("_d", "_o", "_n", "_h")


def split_half(df: DataFrame, keys: list[str], z: str = "z", minimum: int = 50) -> DataFrame:
    """fits of both halves and their differences."""
    h = halves(df, keys, z)
    wide = fit_student_t(h, [*keys, "half"], z, minimum=minimum).groupBy(*keys).pivot("half", ["full", "h1", "h2"]).agg(F.first("nu").alias("nu"), F.first("loc").alias("loc"), F.first("scale").alias("scale"), F.first("n").alias("n"))
    skew = h.groupBy(*keys).pivot("half", ["h1", "h2"]).agg(F.skewness(z)).withColumnsRenamed({"h1": "h1_skew", "h2": "h2_skew"})
    d = {f"d_{p}": F.abs(F.col(f"h1_{p}") - F.col(f"h2_{p}")) for p in ("nu", "loc", "scale")}
    return wide.join(skew, keys).withColumns(d).withColumn("stable", (F.col("d_nu") < 1.0) & (F.col("d_scale") < 0.03))


def skew_buckets(df: DataFrame, keys: list[str], z: str = "z", minimum: int = 30) -> DataFrame:
    """population skewness of z in bands of its size; null below the minimum."""
    a = F.abs(F.col(z))
    band = F.when(a < 1, "0-1").when(a < 2, "1-2").when(a < 3, "2-3").when(a < 5, "3-5").otherwise("5+")
    return clean_z(df, z).groupBy(*keys, band.alias("band")).agg(F.count("*").alias("n"), F.when(F.count("*") >= minimum, F.skewness(z)).alias("skew"))


def compare_variants(df: DataFrame, keys: list[str], a: str, b: str, sigma_a: str | None = None, sigma_b: str | None = None) -> DataFrame:
    """F8: two z variants on rows where both are known: correlation (of z, and of sigma if given; NaN where one stands
    still), ranges and extremes."""
    p = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    related = lambda x, y: F.coalesce(correlation(x, y), F.lit(float("nan")))
    sigma = [related(sigma_a, sigma_b).alias("corr_sigma")] if sigma_a and sigma_b else []
    return p.groupBy(*keys).agg(
        F.count("*").alias("n"), related(a, b).alias("corr"), *sigma, F.min(a).alias("min_a"), F.max(a).alias("max_a"), F.min(b).alias("min_b"), F.max(b).alias("max_b"), F.count_if(F.abs(a) > 5).alias("extreme_a"), F.count_if(F.abs(b) > 5).alias("extreme_b")
    )


def fit_variants(df: DataFrame, keys: list[str], variants: dict[str, str], minimum: int = 50, limits: tuple[float, float, float] = (0.5, 0.03, 0.005)) -> DataFrame:
    """F8: one batched fit of every variant (name -> z column) on rows where all are known, against the first one.

    d_nu, d_loc and d_scale are absolute differences; ``close`` tells whether all stay within the limits (nu, loc, scale).
    """
    names = list(variants)
    whole = df.dropna(subset=list(variants.values()))
    long = whole.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.col(c).alias("z")) for n, c in variants.items()])).alias("v")).select(*keys, "v.*")
    fits = fit_student_t(long, [*keys, "variant"], minimum=minimum)
    first = fits.filter(F.col("variant") == names[0]).select(*keys, *[F.col(c).alias(f"first_{c}") for c in ("nu", "loc", "scale")])
    d = {f"d_{c}": F.abs(F.col(c) - F.col(f"first_{c}")) for c in ("nu", "loc", "scale")}
    out = fits.join(F.broadcast(first), keys, "left").withColumns(d).drop("first_nu", "first_loc", "first_scale")
    return out.withColumn("close", (F.col("d_nu") <= limits[0]) & (F.col("d_loc") <= limits[1]) & (F.col("d_scale") <= limits[2]))


def calibration(df: DataFrame, keys: list[str], variants: dict[str, str], minimum: int = 50) -> DataFrame:
    """the whole bundle (fit, skew, distances, shape, shoulder, quality) of each sigma variant (name -> z column)."""
    long = df.select(*keys, "ts", "instrument_id", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.col(c).alias("z")) for n, c in variants.items()])).alias("v"))
    return bundle(long.select(*keys, "ts", "instrument_id", "v.*"), [*keys, "variant"], minimum=minimum)


def sensitivity_grid(by_gap: DataFrame, warmups: list[int]) -> DataFrame:
    """clean z of every cell (gap, warmup) of rows with gap, z and bar_in_session, staged. A gap makes other sessions, a warm-up only masks rows."""
    rows = by_gap.select("root", "instrument_id", "ts", "z", "bar_in_session", "gap")
    return staged(clean_z(rows.withColumn("warmup", F.explode(F.array(*map(F.lit, warmups)))).filter("bar_in_session >= warmup")))


def with_gaps(df: DataFrame, gaps: list[int], span: int, least: int) -> DataFrame:
    """bars with the z and the place in the session that each gap (in seconds) makes, all gaps in one pass: a gap is
    part of the instrument while sessions and sigma are computed."""
    rows = df.withColumn("gap", F.explode(F.array(*map(F.lit, gaps)))).withColumn("_own", F.col("instrument_id")).withColumn("instrument_id", F.concat_ws("|", "instrument_id", "gap"))
    rows = sigma_session(rows, span, least, F.col("gap")).withColumn("z", z_score())
    return rows.select("root", F.col("_own").alias("instrument_id"), "ts", "gap", "z", "bar_in_session")


def grid_cells(grid: DataFrame, keys: list[str], minimum: int = 50) -> DataFrame:
    """fit, Kolmogorov distance, shoulder and F(2) of each cell, and whether F(2) stands still over the root's cells."""
    cell = [*keys, "gap", "warmup"]
    fits = fit_student_t(grid, cell, minimum=minimum)
    at = with_constants(fits).withColumn("f2", student_t_cdf(F.lit(2.0), F.col("nu"), F.col("loc"), F.col("scale"), F.col("t_c"))).drop("t_c")
    out = at.join(pit_diagnostics(grid, fits, cell).drop("n"), cell, "left").join(shoulder(grid, fits, cell).drop("passes"), cell, "left")
    return out.join(plateau(at, keys, "f2"), keys)


def grid_pivots(cells: DataFrame, keys: list[str], warmups: list[int], values: tuple[str, ...] = ("nu", "n", "ks")) -> DataFrame:
    """nu, rows and distance by gap, one column for each warm-up."""
    return cells.groupBy(*keys, "gap").pivot("warmup", warmups).agg(*[F.first(v).alias(v) for v in values])


def reconciled(methods: dict[str, DataFrame], keys: list[str], minimum: int = 50, heavy: float = 5.0) -> DataFrame:
    """One batched fit of every method's z (name -> rows with z), with its distance, and whether its tails are heavy (nu under ``heavy``)."""
    tagged = None
    for name, df in methods.items():
        df = df.select(*keys, "instrument_id", "ts", "z", F.lit(name).alias("method"))
        tagged = df if tagged is None else tagged.unionByName(df)
    tagged = staged(clean_z(tagged))
    fits = fit_student_t(tagged, [*keys, "method"], minimum=minimum)
    out = fits.join(pit_diagnostics(tagged, fits, [*keys, "method"]).select(*keys, "method", "ks"), [*keys, "method"], "left")
    return out.withColumn("heavy", F.col("nu") < heavy)


def skew_verdict(a: Column, b: Column) -> Column:
    """how the skewness of two variants compares; NaN (a variant that stands still) has the sign 0 and differs from all."""
    return F.when(sign(a) != sign(b), "sign flip").when(F.abs(a - b) > 0.3, "changed").when((F.abs(a) > 0.3) & (F.abs(b) > 0.3), "persistent").otherwise("moderate")


def shift(fits: DataFrame, locked: DataFrame, keys: list[str]) -> DataFrame:
    """fitted less locked parameters (keys, nu, loc, scale)."""
    old = locked.select(*keys, *[F.col(c).alias(f"old_{c}") for c in ("nu", "loc", "scale")])
    return fits.join(F.broadcast(old), keys, "left").withColumns({f"d_{c}": F.col(c) - F.col(f"old_{c}") for c in ("nu", "loc", "scale")})


def bundle(df: DataFrame, keys: list[str], z: str = "z", minimum: int = 50) -> DataFrame:
    """fit, skew, Kolmogorov distance, shoulder and quality of each group."""
    fits = fit_student_t(df, keys, z, minimum=minimum)
    skew = clean_z(df, z).groupBy(*keys).agg(F.skewness(z).alias("skew"))
    out = fits.join(skew, keys, "left").join(pit_diagnostics(df, fits, keys, z).drop("n"), keys, "left").join(shoulder(df, fits, keys, z=z), keys, "left")
    worst = F.greatest("max_dev_right", "max_dev_left")
    return out.withColumn("shoulder_max", worst).withColumn("quality", F.when((F.col("ks") < 0.05) & (worst < 0.01), "GOOD").otherwise("CHECK"))


def plateau(grid: DataFrame, keys: list[str], value: str, limit: float = 0.005) -> DataFrame:
    """whether a statistic of all grid cells stays within the limit."""
    return grid.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("spread")).withColumn("plateau", F.col("spread") < limit)


def yearly_span(fits: DataFrame, keys: list[str], limit: float = 1.0) -> DataFrame:
    """The range of yearly nu."""
    return fits.groupBy(*keys).agg((F.max("nu") - F.min("nu")).alias("nu_span")).withColumn("flagged", F.col("nu_span") > limit)
