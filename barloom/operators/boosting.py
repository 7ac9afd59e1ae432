"""Boosted trees of all walk-forward folds at once, from histograms of quantised inputs.

Rows are kept once. A row has one byte per input (its bin), its target, its time, and the present forecast of every fold;
to which folds it belongs follows from its time, so that no row is copied into the folds. One level of one tree of
every fold is one job: tasks add up gradients by (fold, node, input, bin), the sums of a node meet, and the best split of
each node comes back. The driver holds trees only: rounds x folds x leaves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.sources.stage import staged

#: Bin 0 holds missing values and categories that weren't seen.
BINS = 64
#: Rounds after which the forecasts of the rows are written, so that jobs apply at most as many trees to them.
WRITE_EVERY = 5


@dataclass
class Tree:
    """Nodes in arrays; ``left`` is -1 at a leaf. ``mask[node]`` has the bins that go left."""

    feature: list[int] = field(default_factory=lambda: [0])
    mask: list[np.ndarray] = field(default_factory=lambda: [np.zeros(BINS, bool)])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, mask: np.ndarray, gain: float) -> tuple[int, int]:
        a = len(self.left)
        for column, fill in ((self.feature, 0), (self.mask, np.zeros(BINS, bool)), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.rows, 0), (self.gain, 0.0)):
            column += [fill, fill]
        self.feature[node], self.mask[node], self.left[node], self.right[node], self.gain[node] = feature, mask, a, a + 1, gain
        return a, a + 1

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, mask, left, right = (np.asarray(c) for c in (self.feature, self.mask, self.left, self.right))
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            inner = left[at] >= 0
            if not inner.any():
                return at
            goes = np.where(mask[at, x[rows, feature[at]]], left[at], right[at])
            at = np.where(inner, goes, at)

    def forecast(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.nodes(x)]

    def leaf_paths(self) -> list[tuple[float, dict[int, tuple[np.ndarray, float]]]]:
        """(value, feature -> (bins that lead there, share of the parents' rows that go there)) of each leaf."""
        out, todo = [], [(0, {})]
        while todo:
            node, path = todo.pop()
            if self.left[node] < 0:
                out.append((self.value[node], path))
                continue
            for child, bins in ((self.left[node], self.mask[node]), (self.right[node], ~self.mask[node])):
                before = path.get(self.feature[node], (np.ones(BINS, bool), 1.0))
                todo.append((child, path | {self.feature[node]: (before[0] & bins, before[1] * self.rows[child] / self.rows[node])}))
        return out


@dataclass
class Fold:
    fold_id: int
    start: int
    end: int
    cut: int
    test: int
    stop: int
    first: float
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def best(self) -> int:
        """Rounds up to the least loss on the validating rows."""
        return int(np.argmin(self.losses)) if self.losses else len(self.trees)


def micros(c: str | Column) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def quantised(df: DataFrame, inputs: list[str], category: str | None = None, first: Column | None = None) -> DataFrame:
    """df staged with ``x`` (a byte for each input, then the category), ``t`` (microseconds), ``y`` and ``h`` (a hash of the row).

    The bins' edges are quantiles of the rows where ``first`` holds: of the time before any test, so that no forecast knows
    of later rows. Categories are numbered by name; their number is bounded by the bins.
    """
    known = df.filter(first) if first is not None else df
    at = [i / (BINS - 1) for i in range(1, BINS - 1)]
    cuts = known.agg(*[F.percentile_approx(F.col(c).cast("double"), at, 10000).alias(c) for c in inputs]).first()
    edges = [np.unique(np.array(cuts[c] or [0.0], float)) for c in inputs]
    names = sorted(r[0] for r in df.select(category).distinct().dropna().limit(BINS).collect()) if category else []
    if len(names) >= BINS:
        raise ValueError(f"{category} has more than {BINS - 1} values")

    def run(batches):
        place = {n: i + 1 for i, n in enumerate(names)}
        for batch in batches:
            columns = []
            for c, e in zip(inputs, edges):
                v = np.asarray(batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False), float)
                columns.append(np.where(np.isnan(v), 0, 1 + np.searchsorted(e, v, "left")).astype(np.uint8))
            if category:
                columns.append(np.array([place.get(v, 0) for v in batch.column(category).to_pylist()], np.uint8))
            x = np.stack(columns, axis=1) if len(batch) else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in x], pa.binary())], names=[*batch.schema.names, "x"])

    df = df.withColumns({"t": micros("ts"), "y": F.col("target").cast("double"), "h": F.xxhash64(*[F.col(c) for c in ("root", "instrument_id", "ts")])})
    form = ", ".join(f"`{n}` {k}" for n, k in df.dtypes) + ", x binary"
    # Later rows are in fewer folds: dealt by hash, every task has the same work.
    return staged(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h").mapInArrow(run, form))


def starts(rows: DataFrame, table: DataFrame, least_train: int, least_test: int, validate: float, tau: float | None) -> list[Fold]:
    """The folds that are large enough, each with the time after which training rows validate, and its first forecast: one scan."""
    found = table.select("fold_id", *[micros(c) for c in ("train_start", "train_end", "test_start", "test_end")]).orderBy("fold_id").collect()
    t, y = F.col("t"), F.col("y")
    sums = []
    for f, a, b, c, d in found:
        train, test = t.between(a, b), (t >= c) & (t < d)
        start = F.avg("y") if tau is None else F.percentile_approx(F.when(train, y), tau, 10000)
        start = F.avg(F.when(train, y)) if tau is None else start
        sums.append(F.struct(F.count_if(train), F.count_if(test), F.percentile_approx(F.when(train, t), 1 - validate, 10000), start).alias(f"f{f}"))
    if not sums:
        return []
    got = rows.agg(*sums).first()
    return [Fold(f, a, b, g[2] if validate else b, c, d, g[3]) for (f, a, b, c, d), g in zip(found, got) if g[0] >= least_train and g[1] >= least_test]


def loss_of(tau: float | None):
    """Gradient and loss of forecasts p of y: half the squared error, or the pinball loss at tau."""
    if tau is None:
        return (lambda y, p: p - y), (lambda y, p: 0.5 * (y - p) ** 2)
    return (lambda y, p: np.where(y > p, -tau, 1 - tau)), (lambda y, p: np.where(y > p, tau * (y - p), (1 - tau) * (p - y)))


def _drawn(h: np.ndarray, draw: int, share: float) -> np.ndarray:
    x = (h.view(np.uint64) ^ np.uint64(draw * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)).astype(float) < share * (1 << 24)


def _columns(batch) -> tuple:
    n = batch.num_rows
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(n, -1) if n else np.zeros((0, 1), np.uint8)
    f = batch.column("f").to_pylist() if "f" in batch.schema.names else None
    return x, np.asarray(batch.column("t")), np.asarray(batch.column("y")), np.asarray(batch.column("h")), np.frombuffer(b"".join(f), float).reshape(n, -1) if f is not None and n else None


def _present(f: np.ndarray | None, i: int, fold: Fold, x: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Present forecasts of the kept rows: those that are written, and the trees that the fold brings along."""
    p = np.full(int(keep.sum()), fold.first) if f is None else f[keep, i]
    for tree in fold.trees:
        p = p + tree.forecast(x[keep])
    return p


def best_split(sums: np.ndarray, least: int, categorical: bool) -> tuple[float, int, np.ndarray] | None:
    """(gain, feature, bins that go left) of sums (2, features, bins) of gradients and rows; None if nothing is gained."""
    g, n = sums
    whole, rows = g[0].sum(), n[0].sum()
    best = None
    for k in range(len(g)):
        order = np.arange(BINS)
        if categorical and k == len(g) - 1:
            order = np.argsort(np.where(n[k] > 0, g[k] / np.maximum(n[k], 1), np.inf), kind="stable")
        a, m = np.cumsum(g[k][order])[:-1], np.cumsum(n[k][order])[:-1]
        ok = (m >= least) & (rows - m >= least)
        if not ok.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, a * a / m + (whole - a) ** 2 / (rows - m) - whole * whole / rows, -np.inf)
        i = int(np.argmax(gain))
        if gain[i] > 1e-12 and (best is None or gain[i] > best[0]):
            mask = np.zeros(BINS, bool)
            mask[order[: i + 1]] = True
            best = float(gain[i]), k, mask
    return best


SPLITS = "fold int, node int, kind int, loss double, g double, n long, gain double, feature int, mask binary, left_g double, left_n long"


def _level(state: DataFrame, folds: dict[int, Fold], frontier: dict[int, list[int]], growing: dict[int, Tree], used: dict[int, np.ndarray], draw: int, sample: float, tau: float | None, least: int, categorical: bool, losses: bool):
    """The best split of each node of the frontier, and with ``losses`` the folds' loss on the validating rows: one job."""
    gradient, loss = loss_of(tau)
    shipped = state.sparkSession.sparkContext.broadcast((folds, frontier, growing, used))

    def sums(batches):
        folds, frontier, growing, used = shipped.value
        total: dict = {}
        for batch in batches:
            x, t, y, h, f = _columns(batch)
            if not len(t):
                continue
            picked = _drawn(h, draw, sample)
            for i, fold in folds.items():
                inside = (t >= fold.start) & (t <= fold.end)
                late = inside & (t > fold.cut)
                if losses and late.any():
                    at = total.setdefault((i, -1), np.zeros(2))
                    at += loss(y[late], _present(f, i, fold, x, late)).sum(), late.sum()
                keep = inside & ~late & picked
                if not frontier.get(i) or not keep.any():
                    continue
                p = _present(f, i, fold, x, keep)
                place = np.full(len(growing[i].left), -1)
                place[frontier[i]] = np.arange(len(frontier[i]))
                node, own = place[growing[i].nodes(x[keep])], x[keep]
                g, own, node = gradient(y[keep], p)[node >= 0], own[node >= 0], node[node >= 0]
                size = len(frontier[i]) * BINS
                part = np.zeros((len(frontier[i]), 2, own.shape[1], BINS))
                for k in used[i]:
                    code = node * BINS + own[:, k]
                    part[:, 0, k] = np.bincount(code, g, size).reshape(-1, BINS)
                    part[:, 1, k] = np.bincount(code, minlength=size).reshape(-1, BINS)
                for j, name in enumerate(frontier[i]):
                    at = total.setdefault((i, name), np.zeros(part.shape[1:]))
                    at += part[j]
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([TaskContext.get().partitionId()] * len(keys), pa.int32()), pa.array([total[k].tobytes() for k in keys], pa.binary())],
            names=["fold", "node", "part", "sums"],
        )

    def chosen(batches):
        parts: dict = {}
        for batch in batches:
            for i, node, part, own in zip(*(batch.column(c).to_pylist() for c in ("fold", "node", "part", "sums"))):
                parts.setdefault((i, node), []).append((part, own))
        out = []
        for (i, node), found in parts.items():
            whole = sum(np.frombuffer(own, float) for _, own in sorted(found))  # always in one order
            if node < 0:
                out.append((i, node, 0, float(whole[0] / whole[1]), None, int(whole[1]), *[None] * 5))
                continue
            used, s = shipped.value[3][i], whole.reshape(2, -1, BINS)
            g, n = float(s[0, used[0]].sum()), int(s[1, used[0]].sum())
            if (best := best_split(s[:, used], least, categorical and used[-1] == s.shape[1] - 1)) is None:
                out.append((i, node, 1, None, g, n, *[None] * 5))
            else:
                gain, k, mask = best
                out.append((i, node, 2, None, g, n, gain, int(used[k]), mask.tobytes(), float(s[0, used[k]][mask].sum()), int(s[1, used[k]][mask].sum())))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.int32(), pa.binary(), pa.float64(), pa.int64()]
        columns = zip(*out) if out else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in SPLITS.split(", ")])

    got = _met(state.mapInArrow(sums, "fold int, node int, part int, sums binary"), "fold", "node").mapInArrow(chosen, SPLITS).collect()
    shipped.destroy()
    return got


def _met(parts: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key in one task; each has as many as there are tasks before."""
    return parts.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _residual_quantiles(state: DataFrame, folds: dict[int, Fold], growing: dict[int, Tree], draw: int, sample: float, tau: float, steps: int = 1024):
    """(fold, leaf) -> the tau quantile of the residuals there, by counts in ``steps`` steps of the leaf's range: two jobs."""
    shipped = state.sparkSession.sparkContext.broadcast((folds, growing))

    def each(batches):
        folds, growing = shipped.value
        for batch in batches:
            x, t, y, h, f = _columns(batch)
            picked = _drawn(h, draw, sample)
            for i, fold in folds.items():
                keep = (t >= fold.start) & (t <= fold.end) & (t <= fold.cut) & picked
                if i in growing and keep.any():
                    yield i, growing[i].nodes(x[keep]), y[keep] - _present(f, i, fold, x, keep)

    def ranges(batches):
        total: dict = {}
        for i, leaf, r in each(batches):
            for q in np.unique(leaf).tolist():
                own = r[leaf == q]
                a = total.setdefault((i, q), [np.inf, -np.inf])
                a[0], a[1] = min(a[0], own.min()), max(a[1], own.max())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), pa.array([v[0] for v in total.values()], pa.float64()), pa.array([v[1] for v in total.values()], pa.float64())], names=["fold", "leaf", "lo", "hi"])

    ends = {(r.fold, r.leaf): (r.lo, r.hi) for r in state.mapInArrow(ranges, "fold int, leaf int, lo double, hi double").groupBy("fold", "leaf").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}

    def counts(batches):
        total: dict = {}
        for i, leaf, r in each(batches):
            for q in np.unique(leaf).tolist():
                lo, hi = ends[i, q]
                step = np.clip(((r[leaf == q] - lo) / max(hi - lo, 1e-300) * steps).astype(np.int64), 0, steps - 1)
                total[i, q] = total.get((i, q), 0) + np.bincount(step, minlength=steps)
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k].astype(np.int64).tobytes() for k in keys], pa.binary())], names=["fold", "leaf", "counts"])

    def inverted(batches):
        total: dict = {}
        for batch in batches:
            for i, q, own in zip(*(batch.column(c).to_pylist() for c in ("fold", "leaf", "counts"))):
                total[i, q] = total.get((i, q), 0) + np.frombuffer(own, np.int64)
        out = []
        for (i, q), n in total.items():
            (lo, hi), ahead = ends[i, q], np.concatenate([[0], np.cumsum(n)])
            out.append((i, q, float(lo + (hi - lo) / steps * np.interp(tau * ahead[-1], ahead, np.arange(steps + 1)))))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, (pa.int32(), pa.int32(), pa.float64()))], names=["fold", "leaf", "value"])

    got = _met(state.mapInArrow(counts, "fold int, leaf int, counts binary"), "fold", "leaf").mapInArrow(inverted, "fold int, leaf int, value double").collect()
    shipped.destroy()
    return {(r.fold, r.leaf): r.value for r in got}


def _advanced(state: DataFrame, folds: list[Fold]) -> DataFrame:
    """The rows with the forecasts of all trees so far, staged."""
    shipped = state.sparkSession.sparkContext.broadcast(folds)
    names = [c for c in state.columns if c != "f"]

    def run(batches):
        for batch in batches:
            x, t, _, _, f = _columns(batch)
            keep = np.ones(len(t), bool)
            now = np.stack([_present(f, i, fold, x, keep) for i, fold in enumerate(shipped.value)], axis=1) if len(t) else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array([r.tobytes() for r in now], pa.binary())], names=[*names, "f"])

    form = ", ".join(f"`{n}` {k}" for n, k in state.dtypes if n != "f") + ", f binary"
    return staged(state.mapInArrow(run, form))


def fit(
    rows: DataFrame, table: DataFrame, categorical: bool = False, tau: float | None = None, rounds: int = 5000, patience: int = 100, rate: float = 0.05, leaves: int = 31, depth: int = 5,
    least: int = 200, sample: float = 0.8, features: float = 0.8, redraw: int = 5, validate: float = 0.1, least_train: int = 1000, least_test: int = 100, seed: int = 7,
) -> list[Fold]:
    """M10 (or M11 with ``tau``): the trees of every fold of table (fold_id, train_start, train_end, test_start, test_end), on rows of ``quantised``.

    All folds grow together: a round takes ``depth`` jobs at most. In a level the nodes of the highest gain are split until
    the tree has ``leaves``. The last ``validate`` of a fold's training rows by time don't train; a fold whose loss on them
    hasn't improved for ``patience`` rounds stops, and ``Fold.best`` says how many of its trees count. With ``tau`` the
    gradients are those of the pinball loss, and leaves are set to the tau quantile of their residuals.
    """
    folds = starts(rows, table, least_train, least_test, validate, tau)
    state, done, active = rows.select("x", "t", "y", "h"), 0, list(range(len(folds)))
    width = len(rows.select("x").first()[0]) if folds else 0
    for turn in range(rounds + bool(validate)):
        if turn - done >= WRITE_EVERY and active:
            state, done = _advanced(state, [replace(f, trees=f.trees[done:]) for f in folds]), turn
        growing = {i: Tree() for i in active} if turn < rounds else {}
        used = {i: np.sort(np.random.default_rng([seed, folds[i].fold_id, turn]).choice(width, math.ceil(features * width), replace=False)) for i in active}
        frontier, draw = {i: [0] for i in growing}, seed + turn // redraw
        stats: dict = {}
        for level in range(depth):
            now = {i: replace(folds[i], trees=folds[i].trees[done:], losses=[]) for i in active if frontier.get(i) or level == 0}
            if not now:
                break
            got = _level(state, now, frontier, growing, used, draw, sample, tau, least, categorical, level == 0 and validate > 0)
            nodes: dict[int, list] = {}
            for r in got:
                if r.kind == 0:
                    folds[r.fold].losses.append(r.loss)
                    continue
                growing[r.fold].rows[r.node], stats[r.fold, r.node] = r.n, r.g
                if r.kind == 2:
                    nodes.setdefault(r.fold, []).append(r)
            frontier = {}
            for i, found in nodes.items():
                tree = growing[i]
                room = leaves - sum(a < 0 for a in tree.left)
                for r in sorted(found, key=lambda r: (-r.gain, r.node))[: max(0, room)]:
                    a, b = tree.split(r.node, r.feature, np.frombuffer(r.mask, bool), r.gain)
                    tree.rows[a], tree.rows[b] = r.left_n, r.n - r.left_n
                    stats[i, a], stats[i, b] = r.left_g, r.g - r.left_g
                    frontier.setdefault(i, []).extend((a, b))
            if level == 0:
                active = [i for i in active if not validate or turn - folds[i].best() < patience]
                growing = {i: t for i, t in growing.items() if i in active}
                frontier = {i: f for i, f in frontier.items() if i in active}
        if not growing:
            break
        values = _residual_quantiles(state, {i: replace(folds[i], trees=folds[i].trees[done:], losses=[]) for i in growing}, growing, draw, sample, tau) if tau is not None else {}
        for i, tree in growing.items():
            for node in range(len(tree.left)):
                if tree.left[node] < 0:
                    tree.value[node] = rate * (values.get((i, node), 0.0) if tau is not None else -stats.get((i, node), 0.0) / max(tree.rows[node], 1))
            folds[i].trees.append(tree)
    for f in folds:
        f.trees = f.trees[: f.best()] if validate else f.trees
    return folds


def forecast(rows: DataFrame, folds: list[Fold], name: str = "pred_gbt") -> DataFrame:
    """The rows that are tested in a fold, with fold_id and the fold's forecast."""
    shipped = rows.sparkSession.sparkContext.broadcast(folds)
    names = [c for c in rows.columns if c not in ("x", "t", "y", "h")]

    def run(batches):
        for batch in batches:
            x, t, _, _, _ = _columns(batch)
            for fold in shipped.value:
                at = np.flatnonzero((t >= fold.test) & (t < fold.stop))
                if len(at):
                    p = np.full(len(at), fold.first)
                    for tree in fold.trees:
                        p = p + tree.forecast(x[at])
                    part = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array([fold.fold_id] * len(at), pa.int32()), pa.array(p)], names=[*names, "fold_id", name])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", fold_id int, {name} double")


def gains(spark, folds: list[Fold], inputs: list[str]) -> DataFrame:
    """(fold_id, feature, gain, split_count, best_iteration), sums over the splits of the fold's trees."""
    out = []
    for f in folds:
        for k, name in enumerate(inputs):
            own = [t.gain[i] for t in f.trees for i in range(len(t.left)) if t.left[i] >= 0 and t.feature[i] == k]
            out.append((f.fold_id, name, float(sum(own)), len(own), len(f.trees)))
    return spark.createDataFrame(out, "fold_id int, feature string, gain double, split_count long, best_iteration long")


def _weights(m: int) -> list[float]:
    """Shapley's weight of s of m - 1 others being present."""
    return [math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)]


def path_values(x: np.ndarray, trees: list[Tree]) -> np.ndarray:
    """Each input's contribution to the trees' forecast of each row of bins, exact.

    An absent input lets a row go both ways, by the shares of the training rows. A leaf's part in that game is a product over
    the inputs of its path: ``held`` (0 or 1) for those present, ``share`` for those absent. The coefficients of the product
    of (share + held z) over the other inputs are the sums over their subsets by size, which Shapley's weights add up.
    """
    out = np.zeros((len(x), x.shape[1]))
    for tree in trees:
        for value, path in tree.leaf_paths():
            held = {k: bins[x[:, k]].astype(float) for k, (bins, _) in path.items()}
            for k in path:
                sums = [np.ones(len(x))]
                for j in path:
                    if j != k:
                        sums = _times(sums, path[j][1], held[j])
                out[:, k] += value * (held[k] - path[k][1]) * sum(w * s for w, s in zip(_weights(len(path)), sums))
    return out


def _times(sums: list[np.ndarray], share: float, held: np.ndarray) -> list[np.ndarray]:
    """The coefficients of a polynomial in z times (share + held z)."""
    return [(share * sums[i] if i < len(sums) else 0) + (held * sums[i - 1] if i else 0) for i in range(len(sums) + 1)]


def expected(fold: Fold) -> float:
    """The forecast with all inputs absent: leaves weighted by their shares of the training rows."""
    return fold.first + sum(v * math.prod(s for _, s in path.values()) for t in fold.trees for v, path in t.leaf_paths())


def attributions(rows: DataFrame, folds: list[Fold], inputs: list[str]) -> DataFrame:
    """(fold_id, root, instrument_id, ts, target, feature, attribution) of every tested row; they add up to forecast less ``expected``."""
    shipped = rows.sparkSession.sparkContext.broadcast(folds)
    keys = ["root", "instrument_id", "ts", "target"]

    def run(batches):
        for batch in batches:
            x, t, _, _, _ = _columns(batch)
            for fold in shipped.value:
                at = np.flatnonzero((t >= fold.test) & (t < fold.stop))
                if len(at):
                    part, phi = batch.take(pa.array(at)), path_values(x[at], fold.trees)
                    columns = [part.column(c).take(pa.array(np.repeat(np.arange(len(at)), len(inputs)))) for c in keys]
                    yield pa.RecordBatch.from_arrays([pa.array([fold.fold_id] * phi.size, pa.int32()), *columns, pa.array(inputs * len(at)), pa.array(phi.ravel())], names=["fold_id", *keys, "feature", "attribution"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, "fold_id int, " + ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", feature string, attribution double")
