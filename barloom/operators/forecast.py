"""Walk-forward forecasts: folds, baselines for all folds at once, boosted trees, metrics and reports."""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRED = ["fold_id", "root", "instrument_id", "ts", "target"]


def folds(df: DataFrame, first_months: int = 12, block_months: int = 2, purge_days: int = 1, strict_purge: bool = False) -> DataFrame:
    """M4: expanding folds from the first day on; a block is given only if it ends within the data.

    As in the reference rule, training ends a second before the test begins and the purge only moves the first test;
    ``strict_purge`` ends training ``purge_days`` earlier.
    """
    b = df.agg(F.date_trunc("DAY", F.min("ts")).alias("a"), F.max("ts").alias("z"))
    months = lambda c, n: F.expr(f"cast(add_months({c}, {n}) AS timestamp_ntz)")
    b = b.withColumn("first", (F.add_months("a", first_months).cast("timestamp_ntz") + F.expr(f"INTERVAL {purge_days} DAY")))
    last = F.greatest(F.floor(F.months_between("z", "first") / block_months), F.lit(0)).cast("int")
    b = b.withColumn("fold_id", F.explode(F.sequence(F.lit(0), F.coalesce(last, F.lit(0)))))
    b = b.withColumn("test_start", months("first", f"{block_months} * fold_id")).withColumn("test_end", months("first", f"{block_months} * (fold_id + 1)")).filter("test_end <= z")
    stop = F.col("test_start") - F.expr(f"INTERVAL {purge_days} DAY") if strict_purge else F.col("test_start") - F.expr("INTERVAL 1 SECOND")
    return b.select("fold_id", F.col("a").cast("timestamp_ntz").alias("train_start"), stop.alias("train_end"), "test_start", "test_end")


def training_rows(df: DataFrame, inputs: list[str], positive: list[str], target: str = "target", valid: str | None = None) -> DataFrame:
    """M2: valid rows with every input and the target, and positive HAR inputs."""
    out = df.filter(valid) if valid else df
    out = out.dropna(subset=[target, *inputs])
    for c in positive:
        out = out.filter(F.col(c) > 0)
    return out


def attrition(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """M3: rows left after each predicate in turn."""
    keep, counts = F.lit(True), []
    for name, p in steps.items():
        keep = keep & F.coalesce(p, F.lit(False))
        counts.append(F.struct(F.lit(len(counts)).alias("step"), F.lit(name).alias("name"), F.count_if(keep).alias("rows")))
    return df.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def persistence(sigma: str = "sigma_lag1", horizon: int = 12) -> Column:
    """M7: the last sigma carried over the horizon, in logs."""
    return F.ln(F.greatest(F.col(sigma), F.lit(1e-10))) + 0.5 * math.log(horizon)


@dataclass(frozen=True)
class Schedule:
    """Folds by the blocks between their bounds: training rows of a fold are a run of blocks, its test rows another.

    folds: (fold_id, train_start, train_end, test_start, test_end) in microseconds; train_end belongs to the training rows.
    """

    folds: tuple[tuple[int, int, int, int, int], ...]

    @property
    def points(self) -> list[int]:
        return sorted({p for _, a, b, c, d in self.folds for p in (a, b + 1, c, d)})

    def block(self, t: Column) -> Column:
        """How many bounds are at or before t (microseconds), by halving."""

        def within(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(t < points[mid], within(lo, mid)).otherwise(within(mid + 1, hi))

        points = self.points
        return within(0, len(points))

    def run(self, start: int, stop: int) -> range:
        """The blocks of the times from start to before stop."""
        return range(bisect_right(self.points, start), bisect_right(self.points, stop - 1) + 1)

    def parts(self) -> dict[int, tuple[range, range]]:
        """fold_id -> its blocks of training and of test rows."""
        return {f: (self.run(a, b + 1), self.run(c, d)) for f, a, b, c, d in self.folds}

    def kept(self, ids) -> Schedule:
        return Schedule(tuple(f for f in self.folds if f[0] in ids))


def micros(c: str | Column) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def schedule(table: DataFrame) -> Schedule:
    """M4 as a Schedule: one row of the table for each fold comes to the driver."""
    rows = table.select("fold_id", *[micros(c) for c in ("train_start", "train_end", "test_start", "test_end")]).orderBy("fold_id").collect()
    return Schedule(tuple(tuple(r) for r in rows))


def _merged(parts: list[tuple[float, np.ndarray, np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Running (count, means, co-moments) over blocks: sums about their own means are put together without cancelling."""
    out = [(0.0, np.zeros_like(parts[0][1]), np.zeros_like(parts[0][2]))]
    for n, m, c in parts:
        k, mean, co = out[-1]
        d, total = m - mean, k + n
        share = n / total if total else 0.0
        out.append((total, mean + d * share, co + c + np.outer(d, d) * k * share))
    return out


def walk_forward(rows: DataFrame, plan: Schedule, models: dict[str, list[str]], least_train: int = 1000, least_test: int = 100) -> DataFrame:
    """M5, M6, M8, M9: the test rows with their fold_id and the least-squares forecast of each model (name -> inputs).

    One scan adds up counts, means and co-moments of all inputs by block. Folds expand, so that a fold's training sums are
    sums of its run of blocks, taken from running sums; no row is copied into folds. Folds that are too small go.
    """
    spark, columns = rows.sparkSession, [*dict.fromkeys(c for inputs in models.values() for c in inputs), "target"]
    k, blocks = len(columns), len(plan.points) + 1
    rows = rows.withColumn("_block", plan.block(micros("ts")))
    sums = [F.covar_pop(columns[i], columns[j]) for i in range(k) for j in range(i, k)]
    got = {r[0]: r[1:] for r in rows.groupBy("_block").agg(F.count("*"), *[F.avg(c) for c in columns], *sums).collect()}  # a row for each block
    parts = []
    for b in range(blocks):
        n, *rest = got.get(b, (0, *[0.0] * (k + k * (k + 1) // 2)))
        co = np.zeros((k, k))
        co[np.triu_indices(k)] = rest[k:]
        parts.append((float(n), np.array(rest[:k]), n * (co + np.triu(co, 1).T)))
    table = []
    running: dict[int, list] = {}  # from each first block on: one, as all folds start together
    for f, (train, test) in plan.parts().items():
        n, mean, co = running.setdefault(train.start, _merged(parts[train.start :]))[len(train)]
        if n < least_train or sum(parts[b][0] for b in test) < least_test:
            continue
        betas = []
        for inputs in models.values():
            at = [columns.index(c) for c in inputs]
            beta = np.linalg.lstsq(co[np.ix_(at, at)] / n, co[at, k - 1] / n, rcond=None)[0]
            betas.append([float(mean[-1] - beta @ mean[at]), *map(float, beta)])
        table += [(b, f, betas) for b in test]
    found = F.broadcast(spark.createDataFrame(table, "_block int, fold_id int, _beta array<array<double>>"))
    out = rows.join(found, "_block")
    for i, (name, inputs) in enumerate(models.items()):
        beta = F.get("_beta", F.lit(i))
        out = out.withColumn(name, sum((F.get(beta, F.lit(j + 1)) * F.col(c) for j, c in enumerate(inputs)), F.get(beta, F.lit(0))))
    return out.drop("_block", "_beta")


def expanding_medians(rows: DataFrame, plan: Schedule, value: str = "target", steps: int = 4096) -> DataFrame:
    """(fold_id, pivot), the median of each fold's training rows, exact.

    Counts by block and step of the value's range give, for each fold, the steps that hold its two middle ranks; only the rows
    of these steps are ranked.
    """
    spark = rows.sparkSession
    lo, hi = rows.agg(F.min(value), F.max(value)).first()
    empty = spark.createDataFrame([], "fold_id int, pivot double")
    if lo is None:
        return empty
    step = F.least(F.floor((F.col(value) - lo) / max(hi - lo, 1e-300) * steps), F.lit(steps - 1)).cast("int") if hi > lo else F.lit(0)
    rows = rows.filter(F.col(value).isNotNull()).select(plan.block(micros("ts")).alias("_block"), step.alias("_step"), F.col(value).alias("_v"))
    counts = np.zeros((len(plan.points) + 1, steps), np.int64)
    for r in rows.groupBy("_block", "_step").count().collect():  # blocks x steps at most
        counts[r[0], r[1]] = r[2]
    wanted = []
    for f, (train, _) in plan.parts().items():
        ahead = counts[train.start : train.stop].sum(axis=0).cumsum()
        n = int(ahead[-1])
        for rank in ((n - 1) // 2, n // 2) if n else ():
            s = int(np.searchsorted(ahead, rank, "right"))
            wanted.append((f, train.start, train.stop, s, rank - int(ahead[s - 1] if s else 0) + 1))
    if not wanted:
        return empty
    table = spark.createDataFrame(wanted, "fold_id int, _from int, _to int, _step int, _rank int")
    held = rows.join(F.broadcast(table.select("fold_id", "_from", "_to", "_step").distinct()), "_step").filter((F.col("_block") >= F.col("_from")) & (F.col("_block") < F.col("_to")))
    held = held.withColumn("_rank", F.row_number().over(Window.partitionBy("fold_id", "_step").orderBy("_v")))
    return table.join(held.select("fold_id", "_step", "_rank", "_v"), ["fold_id", "_step", "_rank"]).groupBy("fold_id").agg(F.avg("_v").alias("pivot"))


def average_ranks(df: DataFrame, keys: list[str], values: dict[str, str], buckets: int = 256) -> DataFrame:
    """df with the rank of each value (new name -> column) in its group, ties at their mean (E10), nulls first.

    A group's rows are dealt over buckets of its range, so that a large group isn't one task; the offsets come from the
    small tables of bucket counts.
    """
    ends = df.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{f.__name__}") for n, c in values.items() for f in (F.min, F.max)])
    df = df.join(ends, keys)
    for name, c in values.items():
        low, high = F.col(f"_{name}_min"), F.col(f"_{name}_max")
        at = F.least(F.floor(F.coalesce(F.try_divide((F.col(c) - low).cast("double"), (high - low).cast("double")), F.lit(0.0)) * buckets), F.lit(buckets - 1))
        df = df.withColumn("_b", F.when(F.col(c).isNull(), -1).otherwise(at)).drop(f"_{name}_min", f"_{name}_max")
        counts = df.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
        before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
        own = Window.partitionBy(*keys, "_b")
        rank = F.col("_o") + F.rank().over(own.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, "_b", c)) - 1) / 2.0
        df = df.join(counts, [*keys, "_b"]).withColumn(name, rank).drop("_b", "_o")
    return df


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    r = average_ranks(df.select(*keys, a, b), keys, {"_a": a, "_r": b})
    spread = F.stddev_pop("_a") * F.stddev_pop("_r")
    return r.groupBy(*keys).agg(F.try_divide(F.covar_pop("_a", "_r"), spread).alias("rho"))  # null where all are tied


def metrics(preds: DataFrame, models: list[str], pivots: DataFrame, least: int = 10) -> DataFrame:
    """Rank correlation, RMSE, MAE and hit rate about the train median, pooled and by root.

    preds: (fold_id, root, target, one column per model); pivots: (fold_id, pivot).
    """
    l = preds.unpivot(["fold_id", "root", "target"], models, "model", "pred").join(F.broadcast(pivots), "fold_id")  # noqa: E741
    l = l.withColumn("slice", F.explode(F.array(F.lit("pooled"), "root")))  # noqa: E741
    keys = ["fold_id", "model", "slice"]
    e = F.col("target") - F.col("pred")
    hit = (F.signum(F.col("pred") - F.col("pivot")) == F.signum(F.col("target") - F.col("pivot"))).cast("double")
    agg = l.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(hit).alias("hit_rate"))
    out = agg.join(spearman(l, keys, "target", "pred"), keys).filter((F.col("slice") == "pooled") | (F.col("n") >= least))
    few = F.col("n") >= 2
    return out.select(*keys, "n", *[F.when(few, F.col(c)).alias(c) for c in ("rho", "rmse", "mae", "hit_rate")])


def fold_deltas(m: DataFrame, a: str, b: str) -> DataFrame:
    """Rho of model a less model b by fold."""
    return m.filter("slice = 'pooled'").groupBy("fold_id").pivot("model", [a, b]).agg(F.first("rho")).select("fold_id", (F.col(a) - F.col(b)).alias("delta"))


def success(m: DataFrame, a: str, b: str, edge: float = 0.03, share: float = 0.7, roots: int = 2) -> DataFrame:
    """Mean edge, share of folds won, and roots won."""
    d = m.groupBy("fold_id", "slice").pivot("model", [a, b]).agg(F.first("rho")).withColumn("d", F.col(a) - F.col(b))
    pooled, by_root = d.filter("slice = 'pooled'"), d.filter("slice <> 'pooled'").groupBy("slice").agg(F.avg("d").alias("d"))
    x = pooled.agg(F.avg("d").alias("edge"), F.avg((F.col("d") > 0).cast("double")).alias("won")).crossJoin(by_root.agg(F.count_if(F.col("d") > 0).alias("roots_won")))
    return x.withColumn("passes", (F.col("edge") >= edge) & (F.col("won") >= share) & (F.col("roots_won") >= roots))


def top_features(gains: DataFrame, k: int = 10) -> DataFrame:
    """The features of the highest mean gain."""
    return gains.groupBy("feature").agg(F.avg("gain").alias("mean_gain"), F.stddev_samp("gain").alias("std_gain"), F.avg("split_count").alias("mean_splits"), F.count("*").alias("n_folds")).orderBy(F.desc("mean_gain"), "feature").limit(k)


def gain_ranks(gains: DataFrame) -> DataFrame:
    return gains.withColumn("place", F.row_number().over(Window.partitionBy("fold_id").orderBy(F.desc("gain"), "feature")))


def rank_stability(gains: DataFrame, k: int = 10) -> DataFrame:
    """Spearman of gains over the union of the top k of neighbouring folds."""
    g = gain_ranks(gains).select("fold_id", "feature", "gain", "place")
    n = g.select((F.col("fold_id") - 1).alias("fold_id"), "feature", F.col("gain").alias("gain_2"), F.col("place").alias("place_2"))
    p = g.join(n, ["fold_id", "feature"]).filter((F.col("place") <= k) | (F.col("place_2") <= k))
    return spearman(p, ["fold_id"], "gain", "gain_2")


def stability_summary(ranks: DataFrame, level: float = 0.7) -> DataFrame:
    """Mean and median of the neighbours' rank correlations, and the share above ``level``."""
    return ranks.agg(F.avg("rho").alias("mean_rank_rho"), F.median("rho").alias("median_rank_rho"), F.avg((F.col("rho") > level).cast("double")).alias("share_stable"))


def top_presence(gains: DataFrame, watched: list[str], k: int = 5) -> DataFrame:
    """In how many folds each watched feature is among the top k."""
    return gain_ranks(gains).filter(F.col("feature").isin(*watched)).groupBy("feature").agg(F.count_if(F.col("place") <= k).alias("in_top"), F.count("*").alias("folds"))


def residual_report(preds: DataFrame, model: str, calendar: DataFrame) -> DataFrame:
    """Residual mean and deviation by root, by top decile of the fold's target, and by calendar day (day)."""
    high = preds.groupBy("fold_id").agg(F.percentile("target", 0.9).alias("p90"))
    r = preds.join(F.broadcast(high), "fold_id").withColumn("day", F.to_date("ts")).join(F.broadcast(calendar.withColumn("listed", F.lit(True))), "day", "left").withColumn("e", F.col("target") - F.col(model))
    regime = F.when(F.col("target") >= F.col("p90"), "regime high").otherwise("regime rest")
    listed = F.when(F.col("listed"), "calendar day").otherwise("other day")
    return r.withColumn("slice", F.explode(F.array(F.concat(F.lit("root "), "root"), regime, listed))).groupBy("slice").agg(F.count("*").alias("n"), F.avg("e").alias("bias"), F.stddev_samp("e").alias("std"))


def deciles(preds: DataFrame, models: list[str], q: int = 10) -> DataFrame:
    """Bias and deviation by quantile bin of the target within the fold: edges right-closed, repeats dropped."""
    edges = preds.groupBy("fold_id").agg(F.array_distinct(F.percentile("target", [i / q for i in range(1, q)])).alias("edges"), F.max("target").alias("top"))
    p = preds.join(F.broadcast(edges), "fold_id").withColumn("decile", F.size(F.filter("edges", lambda e: (F.col("target") > e) & (e < F.col("top")))))
    out = [x for m in models for x in (F.avg(F.col(m) - F.col("target")).alias(f"bias_{m}"), F.stddev_samp(F.col(m) - F.col("target")).alias(f"std_{m}"))]
    return p.groupBy("decile").agg(F.count("*").alias("n"), *out)


def coverage(preds: DataFrame, quantile: str) -> DataFrame:
    """The share of targets under the quantile, overall and by root."""
    return preds.rollup("root").agg(F.count("*").alias("n"), F.avg((F.col("target") <= F.col(quantile)).cast("double")).alias("coverage")).withColumn("root", F.coalesce("root", F.lit("all")))


def attribution_shares(attributions: DataFrame) -> DataFrame:
    """Mean absolute attribution of each feature and root, its share, and its place."""
    a = attributions.groupBy("root", "feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"))
    w = Window.partitionBy("root")
    return a.withColumn("share", F.try_divide("mean_abs", F.sum("mean_abs").over(w))).withColumn("place", F.row_number().over(w.orderBy(F.desc("mean_abs"), "feature")))


def family_shares(shares: DataFrame, families: dict[str, str], watched: str, least: float = 0.2, without: tuple[str, ...] = ("root",)) -> DataFrame:
    """The share of each family of features (feature -> family) in a root, without the features named, and for the
    watched family whether it reaches ``least``."""
    name = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])[F.col("feature")]
    s = shares.filter(~F.col("feature").isin(*without)).withColumn("family", F.coalesce(name, F.lit("other")))
    s = s.groupBy("root", "family").agg(F.sum("mean_abs").alias("mean_abs"))
    s = s.withColumn("share", F.try_divide("mean_abs", F.sum("mean_abs").over(Window.partitionBy("root"))))
    return s.withColumn("supported", F.when(F.col("family") == watched, F.col("share") >= least))


def target_stats(df: DataFrame, target: str = "target") -> DataFrame:
    """Count, mean, deviation, minimum, quartiles, P95 and maximum."""
    p = F.percentile(target, [0.25, 0.5, 0.75, 0.95])
    return df.agg(F.count(target).alias("n"), F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"), F.min(target).alias("min"), *[F.get(p, i).alias(x) for i, x in enumerate(("p25", "p50", "p75", "p95"))], F.max(target).alias("max"))


def sanity_flags(m: DataFrame, bounds: DataFrame) -> DataFrame:
    """OK, WARN or BLOCK of each model's rho against (model, warn_low, warn_high, block_low, block_high)."""
    r = F.col("rho")
    flag = F.when(r.isNull() | ~r.between(F.col("block_low"), F.col("block_high")), "BLOCK").when(~r.between(F.col("warn_low"), F.col("warn_high")), "WARN").otherwise("OK")
    return m.filter("slice = 'pooled'").join(F.broadcast(bounds), "model").select("fold_id", "model", "rho", flag.alias("flag"))
