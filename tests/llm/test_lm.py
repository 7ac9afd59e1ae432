import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import lm
from barloom.llm.queries import op9_bloom_lm

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(t):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]


def brute(docs):
    """docs: (id, held, text) -> (id, held, tokens, known, N, base)."""
    c = Counter(w for _, held, t in docs if not held for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(d, held, len(w := words(t)), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for d, held, t in docs]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])) for a, b in zip(got, want))


def test_edges(spark):
    texts = ["a b a b a b", "A  b\tc", None, "", " \n", "x" * 9000, "É é", "a b a b"]
    rows = [(i, i == 1, t, "clash") for i, t in enumerate(texts)] + [(0, False, "a b a b a b", "clash"), (None, False, "q", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, held boolean, text string, block string")
    same(lm.score(docs, F.col("held")).collect(), brute([r[:3] for r in rows]))
    none = docs.filter("doc_id = 1")
    same(lm.score(none, F.lit(True)).collect(), brute([(1, True, "A  b\tc")]))
    assert lm.score(docs.limit(0), F.col("held")).count() == 0


def test_filter_levels():
    r = np.random.default_rng(0)
    keys = r.integers(0, 2**64, 4000, dtype=np.uint64)
    counts = r.integers(2, 300, 4000)
    shift, bits = 62, 1 << 18
    order = [keys >> np.uint64(shift) == b for b in range(4)]
    packed = np.frombuffer(b"".join(lm.filled(keys[m] & np.uint64(0xFFFFFFFF), counts[m], bits) for m in order), np.uint8)
    assert np.mean(lm.probed(packed, keys, shift, bits) == np.floor(np.log2(counts))) > 0.99
    assert np.all(lm.probed(packed, keys, shift, bits) >= np.floor(np.log2(counts)))
    assert np.mean(lm.probed(packed, r.integers(0, 2**64, 4000, dtype=np.uint64), shift, bits) == 0) > 0.98


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 10 == 0, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = op9_bloom_lm(spark, d).collect()
    same(got, brute(docs))
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_filter_grows_and_single_bigrams_count(spark):
    r = np.random.default_rng(1)
    for n in (100, 10_000, 300_000):
        keys, counts = r.integers(0, 2**32, n, dtype=np.uint64), r.integers(1, 9, n)
        bits = lm.range_bits(counts)
        packed = np.frombuffer(lm.filled(keys, counts, bits), np.uint8)
        assert 0.05 < np.unpackbits(packed).mean() < 0.2
        assert np.all(lm.climbed(packed, keys, 32, bits) >= np.floor(np.log2(counts)) + 1)
        assert np.mean(lm.climbed(packed, r.integers(0, 2**32, n, dtype=np.uint64), 32, bits) > 0) < 0.05
    docs = spark.createDataFrame([(1, False, "a b"), (2, True, "a b"), (3, True, "b a")], "doc_id long, held boolean, text string")
    p1, q = (1 + 0.1) / (3 + 0.1 * 4), (1 - lm.MIX) * (1 + 0.1) / (3 + 0.1 * 4)
    got = {x.doc_id: x.score for x in lm.score(docs, F.col("held")).collect()}
    assert abs(got[1] - 3 * math.log10(q + lm.MIX)) < 1e-9 and got[2] == got[1]
    assert abs(got[3] - 3 * math.log10(q)) < 1e-9 and p1 > q


def test_score_follows_exact_counts(spark):
    r = np.random.default_rng(2)
    rows = [(i, i % 5 == 0, " ".join(f"w{k}" for k in r.zipf(1.3, 60) % 400)) for i in range(1500)]
    pairs, c = Counter(), Counter(w for _, held, t in rows if not held for w in words(t))
    for _, held, t in rows:
        w = words(t)
        if not held:
            pairs.update(zip([w[-1], *w[:-1]], w))
    n, v = sum(c.values()), len(c)
    want = {}
    for d, _, t in rows:
        w, s = words(t), 0.0
        for a, b in zip([w[-1], *w[:-1]], w):
            k = pairs[a, b]
            s += math.log10((1 - lm.MIX) * (c[b] + 0.1) / (n + 0.1 * (v + 1)) + (lm.MIX * min(1, 2 ** int(math.log2(k)) / c[a]) if k else 0))
        want[d] = s
    got = {x.doc_id: x.score for x in lm.score(spark.createDataFrame(rows, "doc_id long, held boolean, text string"), F.col("held")).collect()}
    assert all(abs(got[d] - want[d]) < 0.02 * abs(want[d]) for d in want)
    assert np.mean([abs(got[d] - want[d]) < 1e-6 * abs(want[d]) for d, held, _ in rows if not held]) > 0.8


def test_counts_beyond_32_bits():
    """Two blocks of four billion each."""
    import pyarrow as pa

    rows = lambda key, count: pa.table({"kind": [0, 0], "block": [1, 2], "keys": [key] * 2, "counts": [np.array([count], np.uint32).tobytes()] * 2})
    got = lm._merge()((pa.scalar(0), pa.scalar(5)), rows(np.array([7], np.uint64).tobytes(), 4_000_000_000)).to_pylist()
    assert [np.frombuffer(r["counts"], np.int64).tolist() for r in got if r["kind"] == 0] == [[8_000_000_000]] * 2
    assert got[-1]["n"] == 8_000_000_000
    got = lm._merge()((pa.scalar(1), pa.scalar(5)), rows(np.array([7], np.uint32).tobytes(), 4_000_000_000)).to_pylist()
    assert [np.frombuffer(r["counts"], np.uint8).tolist() for r in got if r["kind"] == 1] == [[33]] * 2  # levels 0 to 32
    assert lm._level(np.array([0, 1, 2, 3, 4, 2**40 - 1, 2**40])).tolist() == [0, 0, 1, 1, 2, 39, 40]


def test_broadcast_and_dealt_filters_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ask = lambda limit: sorted(tuple(r) for r in lm.score(docs, F.col("doc_id") % 10 == 0, filter_bytes=limit).collect())
    assert ask(1 << 30) == ask(0)
