import hashlib
import re

import pytest

from barloom.llm import _common, decontam
from barloom.llm.queries import op8_winnowing

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ASCII = str.maketrans(decontam.UPPER, decontam.LOWER)


def words(t):
    return WORD.findall((t or "").translate(ASCII))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        if w and i is not None:
            for s in range(max(1, len(w) - 9)):
                wins.setdefault(tuple(w[s : s + 10]), set()).add(str(i))
    sizes = {len(k) for k in wins}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    found |= got
        out.append((d, len(w), len(hit), len(found), sorted(found)))
    return out


def check(spark, docs, items):
    a = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, text_key string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, list(r["items"])) for r in decontam.contamination(a, b).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(got, key=key) == sorted(brute(docs, items), key=key)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(25))
    items = [(1, long), (2, "Tiny item"), (3, None), (None, long), (4, ""), (5, "rep " * 14), (6, "ÉTÉ x y z a b c d e f g"), (7, "one"), (1, long), (8, " ".join(f"w{i}" for i in range(3, 14)))]
    docs = [
        (1, "say " + long.upper() + " end"),
        (2, " ".join(f"w{i}" for i in range(9))),
        (3, " ".join(f"w{i}" for i in range(5, 15)) + " tiny, ITEM one"),
        (4, None),
        (None, long),
        (5, ""),
        (6, "rep-" * 40),
        (7, "été x y z a b c d e f g"),
        (8, "ÉTÉ X y z a b c d e f g"),
        (9, long + " gap " + long),
        (9, long + " gap " + long),
        (10, "İ ıK K one"),
    ]
    check(spark, docs, items)
    check(spark, docs, items[:1])
    check(spark, docs, [])
    check(spark, [], items)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(_common, "BROADCAST_BYTES", -1)
    test_edges(spark)


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001"])
def test_query_against_brute_force(spark, d):
    read = lambda t, k: [(r[k], r.text) for r in spark.read.parquet(f"{d}/{t}.parquet").collect()]
    want = {x[0]: x for x in brute(read("documents", "doc_id"), read("benchmark", "item_id"))}
    got = op8_winnowing(spark, d).collect()
    assert len(got) == len(want)
    for r in got:
        d, n_words, n_hit, n_items, found = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n_words, n_hit, n_items, n_hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
