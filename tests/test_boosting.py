"""Boosting of all folds at once against a plain numpy booster, early stopping, quantiles and exact attributions."""

from __future__ import annotations

import math
from datetime import timedelta
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import boosting as G

INPUTS = ["a", "b", "c"]
DAY = 86_400_000_000


@pytest.fixture(scope="module")
def made(spark):
    r = np.random.default_rng(3)
    n = 600
    df = pd.DataFrame({"root": r.choice(["p", "q", "s"], n), "instrument_id": "i", "a": r.normal(size=n), "b": r.normal(size=n), "c": r.integers(0, 4, n).astype(float)})
    df["ts"] = pd.Timestamp("2020-01-01") + pd.to_timedelta(np.arange(n) // 2, unit="D")
    df["target"] = np.sin(2 * df.a) + df.c * (df.root == "q") + 0.3 * r.normal(size=n)
    rows = spark.createDataFrame(df).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    day = lambda k: (pd.Timestamp("2020-01-01") + pd.Timedelta(days=k)).to_pydatetime()
    table = spark.createDataFrame([(i, day(0), day(150 + 40 * i) - timedelta(seconds=1), day(150 + 40 * i), day(190 + 40 * i)) for i in range(3)], "fold_id int, train_start timestamp, train_end timestamp, test_start timestamp, test_end timestamp")
    table = table.select("fold_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("train_start", "train_end", "test_start", "test_end")])
    return G.quantised(rows, INPUTS, "root", F.col("ts") < F.lit("2020-05-30").cast("timestamp_ntz")), table


def plain_tree(x, g, leaves, depth, least, rate):
    """One tree on rows of bins, grown level by level; returns its forecast function."""
    tree = {"rows": np.arange(len(x)), "split": None}
    level = [tree]
    count = 1
    for _ in range(depth):
        found = []
        for node in level:
            own = node["rows"]
            best = None
            for k in range(x.shape[1]):
                bins = sorted(range(G.BINS), key=lambda b: (g[own][x[own, k] == b].mean() if (x[own, k] == b).any() else math.inf)) if k == x.shape[1] - 1 else range(G.BINS)
                for cut in range(1, G.BINS):
                    go = np.isin(x[own, k], list(bins)[:cut])
                    if min(go.sum(), (~go).sum()) < least:
                        continue
                    gain = g[own][go].sum() ** 2 / go.sum() + g[own][~go].sum() ** 2 / (~go).sum() - g[own].sum() ** 2 / len(own)
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, k, frozenset(list(bins)[:cut]))
            if best:
                found.append((best, node))
        level = []
        for (gain, k, bins), node in sorted(found, key=lambda f: -f[0][0])[: leaves - count]:
            go = np.isin(x[node["rows"], k], list(bins))
            node["split"] = (k, bins)
            node["kids"] = [{"rows": node["rows"][m], "split": None} for m in (go, ~go)]
            level += node["kids"]
            count += 1

    def value(row, node=tree):
        while node["split"]:
            k, bins = node["split"]
            node = node["kids"][0 if row[k] in bins else 1]
        return -rate * g[node["rows"]].mean()

    return value


def columns(rows):
    p = rows.select("x", "t", "y", "root", "ts").toPandas()
    return np.stack([np.frombuffer(b, np.uint8) for b in p.x]), p.t.to_numpy(), p.y.to_numpy(), p


def test_equals_a_plain_booster(spark, made):
    rows, table = made
    folds = G.fit(rows, table, categorical=True, rounds=3, rate=0.3, leaves=6, depth=3, least=15, sample=1.0, features=1.0, validate=0.0, least_train=10, least_test=10)
    assert [f.fold_id for f in folds] == [0, 1, 2] and all(len(f.trees) == 3 for f in folds)
    got = G.forecast(rows, folds).toPandas().set_index(["fold_id", "ts", "root", "a"]).pred_gbt
    x, t, y, p = columns(rows.select("x", "t", "y", "root", "ts"))
    a = rows.select("a").toPandas().a.to_numpy()
    for f in folds:
        train, test = np.flatnonzero((t >= f.start) & (t <= f.end)), np.flatnonzero((t >= f.test) & (t < f.stop))
        now, then = np.full(len(train), y[train].mean()), np.full(len(test), y[train].mean())
        for _ in range(3):
            value = plain_tree(x[train], now - y[train], 6, 3, 15, 0.3)
            now, then = now + [value(r) for r in x[train]], then + [value(r) for r in x[test]]
        want = {(f.fold_id, p.ts[i], p.root[i], a[i]): v for i, v in zip(test, then)}
        assert max(abs(got[k] - v) for k, v in want.items()) < 1e-9


def test_stops_early_and_forgets_what_came_after(made):
    rows, table = made
    folds = G.fit(rows, table, categorical=True, rounds=60, patience=3, rate=1.0, leaves=12, depth=4, least=5, least_train=10, least_test=10)
    for f in folds:
        best = int(np.argmin(f.losses))
        assert len(f.trees) == best and len(f.losses) == best + 4 < 60  # three rounds without a better one
        assert f.losses[best] < f.losses[0]


def test_quantile_leaves(made):
    rows, table = made
    folds = G.fit(rows, table, categorical=True, tau=0.9, rounds=12, rate=0.3, leaves=6, depth=3, least=20, validate=0.0, least_train=10, least_test=10)
    x, t, y, _ = columns(rows)
    below = []
    for f in folds:
        train = (t >= f.start) & (t <= f.end)
        fitted = f.first + sum(tree.forecast(x[train]) for tree in f.trees)
        assert abs((y[train] <= fitted).mean() - 0.9) < 0.03
    q = G.forecast(rows, folds, "q").toPandas()
    below.append((q.target <= q.q).mean())
    assert 0.8 < np.mean(below) < 0.97


def test_attributions_are_exact(made):
    rows, table = made
    folds = G.fit(rows, table, categorical=True, rounds=4, rate=0.5, leaves=8, depth=4, least=10, validate=0.0, least_train=10, least_test=10)
    names = [*INPUTS, "root"]
    x, t, _, p = columns(rows)
    f = folds[1]
    test = np.flatnonzero((t >= f.test) & (t < f.stop))

    def worth(tree, row, present, node=0):
        if tree.left[node] < 0:
            return tree.value[node]
        a, b, k = tree.left[node], tree.right[node], tree.feature[node]
        if k in present:
            return worth(tree, row, present, a if tree.mask[node][row[k]] else b)
        return (tree.rows[a] * worth(tree, row, present, a) + tree.rows[b] * worth(tree, row, present, b)) / tree.rows[node]

    phi = G.path_values(x[test], f.trees)
    for i, row in enumerate(x[test][:25]):
        v = {s: sum(worth(tr, row, s) for tr in f.trees) for n in range(5) for s in map(frozenset, combinations(range(4), n))}
        for k in range(4):
            rest = [j for j in range(4) if j != k]
            want = sum(math.factorial(n) * math.factorial(3 - n) / 24 * (v[frozenset(s) | {k}] - v[frozenset(s)]) for n in range(4) for s in combinations(rest, n))
            assert abs(phi[i, k] - want) < 1e-9
    got = G.attributions(rows, folds, names).groupBy("fold_id", "ts", "root", "target").agg(F.sum("attribution").alias("s")).toPandas()
    made_ = G.forecast(rows, folds).toPandas().merge(got, on=["fold_id", "ts", "root", "target"])
    means = {f.fold_id: G.expected(f) for f in folds}
    assert len(made_) == len(got) and abs(made_.s - (made_.pred_gbt - made_.fold_id.map(means))).max() < 1e-9
    g = G.gains(rows.sparkSession, folds, names).toPandas()
    assert (g.groupby("fold_id").split_count.sum() == [sum(a >= 0 for tr in f.trees for a in tr.left) for f in folds]).all()
