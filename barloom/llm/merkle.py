"""Merkle manifest of a table: a digest of each row, a tree for each key, a tree over the keys, and every row's proof.

1. A row's leaf is the digest of its fields. The leaves of a key are put in order by a range shuffle; their places follow
   from the counts of its parts.
2. ``CHUNK`` leaves that follow each other, aligned, are one partition of the exchange: a whole subtree, hashed by itself.
3. Butterfly: in round r, the partitions whose numbers differ in the r-th digit only (base ``FANOUT``) swap the roots of
   their subtrees. Each hashes the ancestors from what it gets, the same ones as its partners, and so knows the siblings
   beside its own path. After the last round every partition has the root and the upper part of its proofs; nothing is
   sent down the tree. Where the last group is cut short, those that are there answer for those that are missing.
4. The roots of the keys are the leaves of one more such tree.

A node with no neighbour is hashed alone. A proof lists the siblings from the bottom up, where there is one.

Defined results: nulls are hashed as ``-``, an empty text is ``0:``; a null key is a tree of its own and comes first; rows
without an id come first in their tree; rows that repeat an id are ordered by digest, so that repeated rows are leaves
side by side; an empty table gives no rows; columns that aren't fields, key or id are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm._common import attach, small, written

#: Leaves of a partition, and partitions that swap in a round; both are powers of two.
CHUNK, FANOUT = 1024, 16


def _hash(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(n: int) -> int:
    """Levels above n leaves."""
    return (n - 1).bit_length()


def raised(nodes: list[str], times: int) -> list[str]:
    """The nodes ``times`` levels up; a last one without a neighbour is hashed alone."""
    for _ in range(times):
        nodes = [_hash(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes


def siblings(nodes: list[str], at: int, times: int) -> tuple[list[str], str]:
    """The sibling of the path of node ``at`` on each of ``times`` levels ('' if there is none), and where the path ends."""
    out = []
    for _ in range(times):
        out.append(nodes[at ^ 1] if at ^ 1 < len(nodes) else "")
        nodes, at = raised(nodes, 1), at >> 1
    return out, nodes[at]


def folded(node: str, at: int, path: list[str]) -> str:
    """The root that a node at a place leads to by the siblings of its path."""
    for s in path:
        node, at = _hash(s, node) if at & 1 else _hash(node, s), at >> 1
    return node


def digest(*fields: Column) -> Column:
    """SHA-256 of fields: ``-`` if null, else the number of bytes, a colon and the value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t), F.lit(":"), t)) for t in text]), 256)


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes with their place ``pos`` among those of their ``key`` in the given order, and how many these are (``n``).

    nodes is read twice and should be a written table. Rows are dealt by ranges, so that a large key isn't one task; only
    counts by part and key are needed to number them.
    """
    spark, first = nodes.sparkSession, [F.col(c).asc_nulls_first() for c in order]
    # Rows that agree in all else are told apart by where they are read from.
    rows = nodes.withColumn("_row", F.monotonically_increasing_id())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(rows.repartitionByRange(parts, F.col("key"), *first, F.col("_row")).withColumn("_part", F.spark_partition_id()))
    counts = rows.groupBy("key", "_part").agg(F.count("*").alias("_n"))  # parts and keys at most
    own = Window.partitionBy("key")
    before = F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = written(counts.select("key", "_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(own).alias("n")))
    within = F.row_number().over(Window.partitionBy("key", "_part").orderBy(*first, "_row"))
    return rows.join(small(counts), ["key", "_part"]).withColumn("pos", F.col("_before") + within - 1).drop("_row", "_part", "_before")


def chunked(nodes: DataFrame, order: list[str], chunk: int) -> DataFrame:
    """(key, p, n, nodes): the rows of each partition of the exchange as an array in order; written."""
    at = placed(nodes, order)
    kept = F.struct("pos", *[F.col(c) for c in nodes.columns if c != "key"])
    rows = at.groupBy("key", F.floor(F.col("pos") / chunk).alias("p")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(kept)).alias("nodes"))
    return written(rows)


def exchanged(chunks: DataFrame, chunk: int, fanout: int) -> DataFrame:
    """(key, p, node, path): the root above each partition, and the siblings of its path from its own subtree's root on."""
    low, step = levels(chunk), levels(fanout)

    def start(batches):
        for batch in batches:
            key, p, n, leaves = (batch.column(c).to_pylist() for c in ("key", "p", "n", "leaves"))
            node = [raised(x, min(low, levels(k)))[0] for x, k in zip(leaves, n)]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(p, pa.int64()), pa.array(n, pa.int64()), pa.array(node, pa.string()), pa.array([[]] * len(key), pa.list_(pa.string()))], names=["key", "p", "n", "node", "path"])

    form = "key string, p long, n long, node string, path array<string>"
    state = written(chunks.select("key", "p", "n", F.transform("nodes", lambda x: x["leaf"]).alias("leaves")).mapInArrow(start, form))
    most, done, span = state.agg(F.max("n")).first()[0] or 0, low, 1

    def hashed(batches, done):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                swapped = sorted(r.pop("swapped"), key=lambda s: s["d"])
                times = max(0, min(step, levels(r["n"]) - done))
                more, r["node"] = siblings([s["node"] for s in swapped], r.pop("own"), times)
                r["path"] = r["path"] + more
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.string()), ("p", pa.int64()), ("n", pa.int64()), ("node", pa.string()), ("path", pa.list_(pa.string()))]))

    while done < levels(most):
        parts = F.ceil(F.col("n") / chunk)
        digit, below = F.floor(F.col("p") / span) % fanout, F.col("p") % span
        first = F.col("p") - digit * span - below + F.col("d") * span  # the first partition of the partner's subtree
        asks = state.select("key", "p", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(fanout - 1).cast("long"))).alias("d")).filter(first < parts)
        # A partner's subtree has span partitions, or what is left; all of them hold its root.
        asks = asks.select("key", "p", "d", (first + below % F.least(F.lit(span), parts - first)).alias("q"))
        gets = asks.join(state.select("key", F.col("p").alias("q"), "node"), ["key", "q"])
        gets = gets.groupBy("key", "p").agg(F.collect_list(F.struct("d", "node")).alias("swapped"))
        rows = state.join(gets, ["key", "p"]).select("key", "p", "n", "path", digit.alias("own"), "swapped")
        state = written(rows.mapInArrow(lambda batches, done=done: hashed(batches, done), form))
        done, span = done + step, span * fanout
    return state.select("key", "p", "node", "path")


def tree(nodes: DataFrame, order: list[str], chunk: int = CHUNK, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """The partitions (key, p, n, nodes) and what each has learnt (key, p, node, path), of nodes (key, leaf and more), written."""
    chunks = chunked(nodes, order, chunk)
    return chunks, exchanged(chunks, chunk, fanout)


def manifest(docs: DataFrame, leaf: Column, changed: Column, key: str = "lang", row_id: str = "doc_id", chunk: int = CHUNK, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row; ``leaf`` is its digest, ``changed``
    the digest that is checked against the proof (null: the leaf itself)."""
    # Keys compare by their bytes; the mark keeps a null key apart from an empty one, and before it.
    name = F.when(F.col(key).isNull(), "").otherwise(F.concat(F.lit("="), F.col(key)))
    rows = written(docs.select(name.alias("key"), F.col(row_id).cast("long").alias("doc_id"), leaf.alias("leaf"), changed.alias("changed")))
    low, top_low = levels(chunk), levels(chunk)
    chunks, upper = tree(rows, ["doc_id", "leaf"], chunk, fanout)
    roots = written(upper.filter("p = 0").select(F.lit("").alias("key"), F.col("key").alias("name"), F.col("node").alias("leaf")))
    tops, above = tree(roots, ["name"], chunk, fanout)

    def own(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                leaves = [x["leaf"] for x in r["nodes"]]
                for i, x in enumerate(r["nodes"]):
                    path = siblings(leaves, i, min(top_low, levels(r["n"])))[0] + r["path"]
                    out.append({"key": x["name"], "root": r["node"], "at": x["pos"], "top": path})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("root", pa.string()), ("at", pa.int64()), ("top", pa.list_(pa.string()))]))

    named = tops.join(above, ["key", "p"]).select("n", "nodes", "node", "path").mapInArrow(own, "key string, root string, at long, top array<string>")
    whole = attach(chunks.join(upper.withColumnRenamed("node", "subroot"), ["key", "p"]), written(named), "key", F.col("p"))

    def proven(batches):
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
        for batch in batches:
            for k in range(batch.num_rows):
                (r,) = batch.slice(k, 1).to_pylist()
                hashes = [[x["leaf"] for x in r["nodes"]]]  # of each level within the partition
                for _ in range(min(low, levels(r["n"]))):
                    hashes.append(raised(hashes[-1], 1))
                beyond = r["path"] + r["top"]
                out = []
                for i, x in enumerate(r["nodes"]):
                    path = [(h[i >> t ^ 1] if i >> t ^ 1 < len(h) else "") for t, h in enumerate(hashes[:-1])]
                    node = folded(x["changed"] or x["leaf"], x["pos"], path + r["path"])
                    out.append((x["doc_id"], x["leaf"], r["subroot"], r["root"], _hash(*path, *beyond), folded(node, r["at"], r["top"])))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.string()) for i, c in enumerate(zip(*out))], names=names)

    shown = whole.select("n", "p", "nodes", "subroot", "path", "root", "at", "top").mapInArrow(proven, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))
