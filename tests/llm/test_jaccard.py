import random
import re

import numpy as np
import pytest

from barloom.llm import jaccard
from barloom.llm.queries import op5_jaccard_components

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(docs):
    sets = []
    for _, t in docs:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            n, m = len(sets[i]), len(sets[j])
            if n and m and 5 * min(n, m) >= 4 * max(n, m):
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (n + m - both):
                    parent[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(docs):
        best[root(i)] = min(best.get(root(i), d), d)
    return sorted((d, len(s), best[root(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets)))


def made(seed=3):
    r = random.Random(seed)
    passage = " ".join(f"common{i}" for i in range(60))
    docs = []
    for _ in range(40):
        base = [f"w{r.randrange(500)}" for _ in range(r.randrange(1, 120))]
        for _ in range(r.randrange(1, 6)):
            t = list(base)
            for _ in range(r.randrange(0, 4)):
                t[r.randrange(len(t))] = f"e{r.randrange(9)}"
            docs.append(" ".join(t) + (" " + passage if r.random() < 0.4 else ""))
    docs += ["One two", "one  TWO", "one two three", None, "", " \t ", "É x y z a b", "é x y z a b", "a " * 50, "a " * 60, "long" * 4000]
    order = list(range(len(docs)))
    r.shuffle(order)
    return [(i, docs[k]) for i, k in enumerate(order)]


def test_against_brute_force(spark):
    docs = made()
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, key string")
    got = sorted(tuple(r) for r in jaccard.near_duplicates(df).collect())
    assert got == brute(docs)


def test_bound_holds():
    r = np.random.default_rng(0)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 3000, r.integers(1, 900)).astype(np.uint64)) for _ in range(2))
        bits = [np.frombuffer(jaccard.bitmap(x), np.uint8)[None] for x in (a, b)]
        assert jaccard.bound(np.array([len(a)]), np.array([len(b)]), *bits)[0] >= len(np.intersect1d(a, b))


def test_order_never_matters():
    s = np.sort(np.random.default_rng(1).integers(0, 2**63, 100).astype(np.uint64))
    assert len(jaccard.prefix(s, s[::3])) == len(jaccard.prefix(s, s[:0])) == 20 + jaccard.needed(100)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (41, 50), (7, 7)], "a long, b long")
    got = dict(tuple(r) for r in jaccard.components(edges).collect())
    assert got == {**{i: 0 for i in range(1, 31)}, 50: 40, 41: 40}


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "x y"), (5, "x y"), (5, "x y"), (3, "X Y")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id) for r in jaccard.near_duplicates(odd).collect()) == [(-1, 3), (3, 3), (5, 3), (5, 3)]


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001"])
def test_query_against_brute_force(spark, d):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op5_jaccard_components(spark, d).collect()) == brute(docs)


def family(n=120, words=60, seed=5):
    """Near copies of one text that differ from each other by several edits: few of them link, all share frequent shingles."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    docs = [" ".join(base)]
    for _ in range(n):
        t = list(base)
        for _ in range(r.randrange(1, 4)):
            t[r.randrange(words)] = f"e{r.randrange(10**6)}"
        docs.append(" ".join(t))
    return list(enumerate(docs))


@pytest.mark.parametrize("with_base", [True, False])
def test_tiles_of_a_family_against_brute_force(spark, monkeypatch, with_base):
    monkeypatch.setattr(jaccard, "HOT", 6)
    monkeypatch.setattr(jaccard, "TILE", 16)
    docs = family()[0 if with_base else 1 :]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.near_duplicates(df).collect()) == brute(docs)


def test_blocks_meet_once(spark):
    # Three blocks whose sets all carry shingles 1, 2 and 3, and a fourth with a set that lacks 1.
    rows = [(t, 4, b, f"{b}{i}", [1, 2, 3]) for t in (1, 2, 3) for b in "abc" for i in range(5)]
    rows += [(t, 5, "d", "d0", [1, 2, 3]) for t in (1, 2, 3)] + [(t, 5, "d", "d1", [2, 3]) for t in (2, 3)]
    held = spark.createDataFrame([(t, band, b, None, low) for t, band, b, _, low in rows], "token long, band int, block string, lone long, low array<long>")
    got = sorted(tuple(r) for r in jaccard.meetings(held).collect())
    every = [(x, y) for x in "abcd" for y in "abcd" if x <= y]
    # At 2, d's second set is told of for the first time; at 3, all have been told at 2.
    assert got == sorted([(1, x, y) for x, y in every] + [(2, x, y) for x, y in every if y == "d"])


@pytest.mark.parametrize("share", [1, 2, 4096])
def test_groups_of_hot_sets_without_a_whole_broadcast(spark, monkeypatch, share):
    monkeypatch.setattr(jaccard, "HOT_SHARE", share)
    rows = [(i, 7, b"hot" if i % 2 else b"cold%d" % (i % 6)) for i in range(60)] + [(None, 7, b"hot"), (None, 0, None), (70, 0, None), (71, 3, b"new")]
    found = [(b"hot", 1, 30)] + [(b"cold%d" % k, 100 + k, 10) for k in (0, 2, 4)]
    df = spark.createDataFrame(rows, "doc_id long, n int, key binary")
    named = spark.createDataFrame(found, "key binary, group long, copies long")
    want = sorted(((d, n, k, {a: b for a, b, _ in found}.get(k)) for d, n, k in rows), key=str)
    for few in (lambda x: x, jaccard.small):
        monkeypatch.setattr(jaccard, "small", few)
        got = [(r.doc_id, r.n, bytes(r.key) if r.key is not None else None, r.group) for r in jaccard.grouped(df, named).select("doc_id", "n", "key", "group").collect()]
        assert sorted(got, key=str) == want
