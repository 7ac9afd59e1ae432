"""Near duplicates by SimHash: 64-bit fingerprints linked at few differing bits, found at the anchors of a covering code.

1. A fingerprint's bit is 1 if more than half of the hashes of the text's four-word shingles have it. Equal fingerprints
   are one node from here on.
2. Two fingerprints at 4 or fewer differing bits differ in at most 2 bits of one of their halves (32 bits). The anchors
   of a half are a covering code: the words of the Hamming code of length 31, with the last bit free; each value is within
   one bit (``RADIUS``) of an anchor. Each fingerprint is replicated to every anchor within the radius plus its share of
   the threshold: the values of two halves that differ in two bits each reach, by one bit (``SHARE``), a value between
   them, and the anchor of that value is within RADIUS + SHARE = 2 bits of both. So every linked pair meets at an anchor.
   That is 2 or 17 anchors of 2^27 a half.
3. Fingerprints are compared per anchor. An anchor gives a forest that joins what is linked there, not all pairs. The
   fingerprints at an anchor that has more than ``tile`` of them are first compared with one that is drawn by hash; what
   these links join needs no further comparison, the others meet in tiles of blocks.
4. The links are joined into components.

Defined results: null, empty and blank texts have no shingles and the fingerprint 0, which links like any other; fewer
than four words are one shingle; repeated rows are linked; rows with a null id get the smallest id of their component
(null if there is none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm._common import attach, slices, small, whole_runs, written
from barloom.llm.jaccard import components

WIDTH, SEED, DIFFER = 4, 42, 4
RADIUS, SHARE = 1, 1
#: Fingerprints at an anchor that are compared in one go.
TILE = 4096
#: Hashes whose bits are counted at a time.
COUNTED = 1 << 14


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a text."""
    words = (text or "").encode().lower().split()  # parts at the same six characters and lowers only A-Z
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1).tolist()
    ends = ends.tolist()
    width = min(WIDTH, len(words))
    hashed = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, COUNTED):
        to = min(at + COUNTED, n)
        h = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[at:to], ends[at + width - 1 : to + width - 1])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of docs (doc_id, text); fp holds the fingerprint's bits as a signed long."""

    def run(batches):
        for part in slices(batches, "text"):
            fp = np.array([fingerprint(t.as_py()) for t in part.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _code() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: what to flip in the 31 bits to reach each codeword within 2 bits, and with the free bit flipped within 1."""
    bit = lambda i: 1 << (i - 1)
    flips, valid = np.zeros((32, 17), np.uint32), np.zeros((32, 17), bool)
    for s in range(32):
        own = [bit(s) if s else 0]
        own += [bit(i) | bit(i ^ s) for i in range(1, 32) if s and i != s and i < i ^ s]
        own += [(bit(s) if s else 0) | 1 << 31]
        flips[s, : len(own)], valid[s, : len(own)] = own, True
    return flips, valid


_FLIPS, _VALID = _code()
_CHECKS = [np.uint32(sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)) for k in range(5)]


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, anchor): every anchor within RADIUS + SHARE bits of each value of half (uint32)."""
    syndrome = sum((np.bitwise_count(half & c) & 1).astype(np.int64) << k for k, c in enumerate(_CHECKS))
    place, k = np.nonzero(_VALID[syndrome])
    return place, half[place] ^ _FLIPS[syndrome[place], k]


def replicated(nodes: DataFrame) -> DataFrame:
    """(anchor, fp): each fingerprint at all its anchors; bit 32 of the anchor tells the half."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = np.asarray(batch.column(0).slice(at, 4096), np.int64)
                halves = fp.view(np.uint32).reshape(-1, 2)
                for side in (0, 1):
                    place, anchor = anchors(halves[:, side])
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64) | side << 32), pa.array(fp[place])], names=["anchor", "fp"])

    return nodes.select("fp").mapInArrow(run, "anchor long, fp long")


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Places in the pairs (a, b) of 0 to n - 1 whose links join as much as all of them."""
    parent, keep = list(range(n)), []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        while parent[j] != j:
            parent[j] = j = parent[parent[j]]
        if i != j:
            parent[max(i, j)] = min(i, j)
            keep.append(k)
    return np.array(keep, np.int64)


def _joined(x: np.ndarray, group: np.ndarray, lead: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in x (distinct fingerprints) whose links join all that are linked and not of one group; with
    ``lead``, only pairs of one of the first ``lead`` with one of the rest."""
    n, group = len(x), np.unique(group, return_inverse=True)[1]
    found, most = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], max(1, (1 << 21) // max(n, 1))
    for at in range(0, lead or n, most):
        i = np.arange(at, min(at + most, lead or n))
        near = np.bitwise_count(x[i, None] ^ x[None]) <= DIFFER
        near &= group[i, None] != group[None]
        near &= np.arange(n)[None] >= lead if lead else np.arange(n)[None] > i[:, None]
        a, b = np.nonzero(near)
        keep = _forest(group[i[a]], group[b], n)
        found.append((i[a[keep]], b[keep]))
    a, b = (np.concatenate(f) for f in zip(*found))
    keep = _forest(group[a], group[b], n)
    return a[keep], b[keep]


def compared(rows: DataFrame) -> DataFrame:
    """Links (a, b) among rows (tile, side, fp, label) of one tile: side 0 with side 1, or all if there is no side 1; rows of one label aren't compared."""

    def run(batches):
        for table in whole_runs(batches, "tile"):
            tile, side, fp, label = (np.asarray(table.column(c)) for c in ("tile", "side", "fp", "label"))
            cuts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1], [True]]))
            two = np.flatnonzero(np.diff(cuts) == 2)  # most tiles: compared at once
            p, q = cuts[two], cuts[two] + 1
            ok = (np.bitwise_count((fp[p] ^ fp[q]).view(np.uint64)) <= DIFFER) & (label[p] != label[q])
            out = [(fp[p[ok]], fp[q[ok]])]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if j - i > 2:
                    order = i + np.argsort(side[i:j], kind="stable")
                    lead = int((side[i:j] == 0).sum()) if side[i:j].any() else 0
                    a, b = _joined(fp[order].view(np.uint64), label[order], lead)
                    out.append((fp[order[a]], fp[order[b]]))
            a, b = (np.concatenate(o) for o in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.select("tile", "side", "fp", "label").repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long")


def _tiles(crowd: DataFrame, tile: int) -> DataFrame:
    """Rows (tile, side, fp, label) of crowded anchors: blocks of about ``tile`` fingerprints, of one label or of small
    labels mixed; every two blocks of an anchor meet once, but not two of one and the same label."""
    big = written(crowd.groupBy("anchor", "label").agg(F.count("*").alias("own")).filter(F.col("own") > tile // 2))
    rows = crowd.join(small(big), ["anchor", "label"], "left")
    rest = written(rows.groupBy("anchor").agg(F.count_if(F.col("own").isNull()).alias("rest")))
    rows = rows.join(small(rest), "anchor")
    lone = F.when(F.col("own").isNotNull(), F.col("label"))
    part = F.pmod(F.xxhash64("fp"), F.ceil(F.coalesce("own", "rest") / tile))
    rows = written(rows.select("anchor", "fp", "label", lone.alias("lone"), F.concat_ws(":", F.coalesce(lone.cast("string"), F.lit("-")), part).alias("block")))
    blocks = rows.select("anchor", "block", "lone").distinct()
    x, y = (blocks.select("anchor", F.col("block").alias(k), F.col("lone").alias(f"lone_{k}")) for k in "xy")
    meet = x.join(y, "anchor").filter((F.col("x") <= F.col("y")) & ~F.coalesce(F.col("lone_x") == F.col("lone_y"), F.lit(False)))
    one, two = (F.struct(F.lit(i).alias("side"), F.col(k).alias("block")) for i, k in enumerate("xy"))
    sides = F.explode(F.when(F.col("x") == F.col("y"), F.array(one)).otherwise(F.array(one, two)))
    meet = meet.select("anchor", F.concat_ws("|", "anchor", "x", "y").alias("tile"), sides.alias("s")).select("anchor", "tile", "s.side", "s.block")
    return rows.join(meet, ["anchor", "block"]).select("tile", "side", "fp", "label")


def links(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b) of distinct fingerprints nodes (fp) whose components are those of all pairs at DIFFER or fewer bits."""
    at = written(replicated(nodes))
    shared = at.groupBy("anchor").agg(F.count("*").alias("k"), F.min(F.struct(F.xxhash64("fp").alias("draw"), "fp")).alias("head")).filter(F.col("k") > 1)
    shared = written(shared.select("anchor", "k", F.col("head.fp").alias("head")))
    rows = written(at.join(shared, "anchor"))
    found = written(compared(rows.filter(F.col("k") <= tile).select(F.col("anchor").alias("tile"), F.lit(0).alias("side"), "fp", F.col("fp").alias("label"))).distinct())
    crowd = rows.filter(F.col("k") > tile)
    if crowd.isEmpty():
        return found
    star = crowd.filter((F.col("fp") != F.col("head")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("head"))) <= DIFFER)).select(F.col("head").alias("a"), F.col("fp").alias("b"))
    known = written(found.unionByName(star).distinct())
    labels = components(known).withColumnRenamed("node", "fp").withColumnRenamed("root", "label")
    crowd = written(crowd.select("anchor", "fp").join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    return known.unionByName(compared(_tiles(crowd, tile)))


def near_duplicates(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of docs (doc_id, text)."""
    prints = written(fingerprints(docs))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(links(nodes, tile)).withColumnRenamed("node", "fp")
    named = nodes.join(groups, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(named.select("fp", "root").join(least, "root").select("fp", "component_id"))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return attach(prints, named, "fp", F.col("doc_id")).select("doc_id", shown, "component_id")
