import random
import re

import numpy as np
import xxhash

from barloom.llm import simhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def print_of(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(prints):
    """The smallest place that each place reaches."""
    root = list(range(len(prints)))

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = of(i), of(j)
                root[max(a, b)] = min(a, b)
    return [of(i) for i in range(len(prints))]


def made(seed=2):
    r = random.Random(seed)
    docs = []
    for _ in range(40):
        base = [f"w{r.randrange(300)}" for _ in range(r.randrange(1, 500))]
        for _ in range(r.randrange(1, 6)):
            t = list(base)
            for _ in range(r.randrange(0, 3)):
                t[r.randrange(len(t))] = f"e{r.randrange(9)}"
            docs.append(" ".join(t))
    return docs + [None, "", " \t", "One two", "one\u000btwo", "É x y z", "é x y z", "a " * 50, "long" * 5000, "w " * 40000 + "end"]


def test_against_brute_force(spark):
    docs = made()
    prints = [print_of(t) for t in docs]
    want = sorted((i, f"{p:016x}", g) for i, (p, g) in enumerate(zip(prints, grouped(prints))))
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], "doc_id long, text string, fp int")
    assert sorted(tuple(x) for x in simhash.near_duplicates(df).collect()) == want
    assert len({w[2] for w in want}) < len(docs) - 20


def test_repeats_and_null_ids(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, "z"), (3, "A b c d e")]
    got = sorted(((x.doc_id, x.component_id) for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (None, 3), (3, 3), (None, None)], key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_anchors_cover_every_pair():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 32, 300, dtype=np.uint32)
    masks = [1 << i | 1 << j for i in range(32) for j in range(i + 1)]  # one or two bits
    reach = lambda v: set(simhash.anchors(np.array([v], np.uint32))[1].tolist())
    for v in x[:40].tolist():
        own = reach(v)
        assert all((a ^ v).bit_count() <= 2 for a in own)
        for m in r.choice(masks, 60).tolist():
            assert own & reach(v ^ m)
    # the definition: all codewords (with either last bit) within two bits
    words = lambda v: {v ^ m for m in [0, *masks]}
    code = lambda v: all((int(c) & v).bit_count() % 2 == 0 for c in simhash._CHECKS)
    for v in x[:20].tolist():
        assert reach(v) == {w for w in words(v) if code(w)}


def test_families_beyond_a_tile(spark):
    """Families around two centres five bits apart, strangers at the same anchors: the same components by any tile."""
    r = random.Random(4)
    centre = r.getrandbits(64)
    far = centre ^ 0b10101010100
    prints = {c ^ sum(1 << b for b in r.sample(range(64), r.randrange(4))) for c in (centre, far) for _ in range(60)}
    prints |= {(centre & 0xFFFFFFFF) | r.getrandbits(32) << 32 for _ in range(80)} | {r.getrandbits(64) for _ in range(40)}
    prints = sorted(prints)
    want = grouped(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    for tile in (simhash.TILE, 16):
        e = [tuple(x) for x in simhash.links(nodes, tile).collect()]
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in e)
        at = {p: i for i, p in enumerate(signed)}
        root = list(range(len(prints)))

        def of(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in e:
            i, j = of(at[a]), of(at[b])
            root[max(i, j)] = min(i, j)
        assert [of(i) for i in range(len(prints))] == want
