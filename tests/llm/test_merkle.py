import hashlib

import pytest
from pyspark.sql import functions as F

from barloom.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes, at):
    """The root, and the siblings of the path of one node with their side."""
    path = []
    while len(nodes) > 1:
        if at ^ 1 < len(nodes):
            path.append((at & 1, nodes[at ^ 1]))
        else:
            path.append((0, ""))
        nodes, at = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], at // 2
    return nodes[0], path


def brute(rows):
    """rows: (doc_id, key, leaf, changed or None)."""
    trees = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        trees.setdefault(r[1], []).append(r)
    keys = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    roots = [climb([r[2] for r in trees[k]], 0)[0] for k in keys]
    out = []
    for at, k in enumerate(keys):
        leaves = [r[2] for r in trees[k]]
        root, top = climb(roots, at)
        for i, r in enumerate(trees[k]):
            path = climb(leaves, i)[1] + top
            node = r[3] or r[2]
            for left, s in path:
                node = h(s, node) if left else h(node, s)
            out.append((r[0], r[2], roots[at], root, h(*[s for _, s in path]), node, node == root))
    return sorted(out, key=str)


def got(spark, rows, **kind):
    df = spark.createDataFrame(rows, "doc_id long, lang string, digest string, other string")
    return sorted((tuple(x) for x in merkle.manifest(df.withColumn("leaf", F.lit(1)), F.col("digest"), F.col("other"), **kind).collect()), key=str)


@pytest.mark.parametrize("sizes", [(1,), (70, 33, 16, 17, 1, 2), (5,) * 11])
def test_against_plain_trees(spark, sizes):
    rows = [(i * 7 % 1000, None if k == 2 else "" if k == 1 else f"k{k}", h(str((k, i))), h("x", str(i)) if i % 5 == 0 else None) for k, n in enumerate(sizes) for i in range(n)]
    want = brute(rows)
    for chunk, fanout in ((4, 2), (2, 4)):
        assert got(spark, rows, chunk=chunk, fanout=fanout) == want
    assert any(r[-1] for r in want) or len(want) < 5


def test_repeats_nulls_and_nothing(spark):
    rows = [(None, "a", h("1"), None), (None, "a", h("0"), None), (3, "a", h("2"), h("bad")), (3, "a", h("2"), h("bad")), (2, "a", h("4"), None), (1, None, h("3"), None)]
    assert got(spark, rows, chunk=2, fanout=2) == brute(rows)
    assert got(spark, []) == []


def test_digest(spark):
    df = spark.createDataFrame([(5, None, "é", ""), (None, "b", None, "x:y")], "a long, b string, c string, d string")
    assert [r[0] for r in df.select(merkle.digest(*map(F.col, "abcd"))).collect()] == [h("1:5-2:é0:"), h("-1:b-3:x:y")]
