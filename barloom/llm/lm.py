"""Language-model scoring with a log-frequency Bloom filter of quantised bigram counts.

Counting is one shuffle. Blocks of documents send the hashes of their words and bigrams, sorted, with training
counts, to buckets of hash ranges; a bucket adds them up, sets the bits of its own range of the filter, and tells each
block the training counts of its words and the levels of its bigrams. A bigram seen c >= 1 times is entered once for
each level from 0 to floor(log2(c)), so that probing levels until one is missing gives 2^level <= c. A range has
``ENTRY_BITS`` to twice as many bits for each of its entries: the filter grows with the input, and the share of set
bits, hence of false hits, stays the same. A filter of at most ``FILTER_BYTES`` is broadcast to the workers that score, and
probed there, text by text. A larger one stays dealt over the buckets, whose number grows with the documents; each range is
probed in its bucket for the blocks that ask. Both give the same levels. Counts are kept in 64 bits, and a filter has as
many levels as its largest count needs.

p(w | v) = (1 - MIX) * p1(w) + MIX * 2^level(v, w) / c(v), with p1 the add-0.1 unigram of the base score, and 0 for
the last term if the bigram is at no level; each text is read as end, words, end. Word counts are exact: they travel
with the blocks and are not in the filter.

Defined results: a null, empty or blank text is one end token; rows with a null id train and are not held out;
repeated rows count and score like any others; if nothing trains, every count is 0 and the base is the uniform
add-0.1 estimate; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm._common import ship, slices, written
from barloom.llm.jaccard import mixed, word_hashes

#: Bits of a range for each of its entries, at least; with three hashes at most 17 % of the bits are set.
ENTRY_BITS = 16
HASHES = 3
#: Bytes of the whole filter up to which it is broadcast.
FILTER_BYTES = 64 << 20
MIX = 0.05
ADD = 0.1
#: Documents and bytes of text of a block, at most.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Documents for each bucket, about; the number of buckets is a power of two, 64 at least.
DOCS_PER_BUCKET = 20_000
END = np.uint64(0x656E64)

_EMPTY = np.zeros(0, np.uint64)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's words, then of the end."""
    return np.append(word_hashes(text), END)


def bigrams(t: np.ndarray) -> np.ndarray:
    """A hash for each token with the one before it; the end stands before the first."""
    before = np.concatenate([t[-1:], t[:-1]])
    return mixed(before * np.uint64(0xD6E8FEB86659FD93) + mixed(t ^ np.uint64(0x5851F42D4C957F2D)))


def _places(keys: np.ndarray, level: int, bits: int | np.ndarray) -> list[np.ndarray]:
    """The bits of each key at a level, inside a range of ``bits`` (a power of two, for all keys or for each)."""
    mask = np.asarray(bits).astype(np.uint64) - np.uint64(1)
    x = mixed(keys + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    y = mixed(x) | np.uint64(1)
    return [((x + np.uint64(j) * y) & mask).astype(np.int64) for j in range(HASHES)]


def filled(keys: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """The packed bits of one range: each key at the levels up to floor(log2(count))."""
    out = np.zeros(bits, bool)
    levels = _level(counts)
    for level in range(int(levels.max(initial=0)) + 1):
        for at in _places(keys[levels >= level], level, bits):
            out[at] = True
    return np.packbits(out, bitorder="little").tobytes()


def _level(counts: np.ndarray) -> np.ndarray:
    """floor(log2(count)), exact for whole numbers below 2**53; 0 for a count of 0."""
    return np.frexp(np.maximum(counts, 1).astype(float))[1].astype(np.int64) - 1


def probed(filter_bytes: np.ndarray, keys: np.ndarray, shift: int, bits: int) -> np.ndarray:
    """The level of each key by repeated probes, 0 also for a key that was never entered; bucket = key >> shift names its range."""
    return np.maximum(climbed(filter_bytes, keys, shift, bits), 1) - np.uint8(1)


def climbed(filter_bytes: np.ndarray, keys: np.ndarray, shift: int, bits: int) -> np.ndarray:
    """In how many levels, from 0 on, each key is found: 0 for a key that was never entered."""
    return _climbed(filter_bytes, keys, (keys >> np.uint64(shift)).astype(np.int64) * bits, np.full(len(keys), bits))


def _climbed(filter_bytes: np.ndarray, keys: np.ndarray, base: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """As climbed, with the first bit and the number of bits of each key's range."""
    found, active = np.zeros(len(keys), np.uint8), np.arange(len(keys))
    short = keys & np.uint64(0xFFFFFFFF)
    for step in range(64):
        hit = np.ones(len(active), bool)
        for at in _places(short[active], step, bits[active]):
            at += base[active]
            hit &= (filter_bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        active = active[hit]
        if not len(active):
            break
        found[active] = step + 1
    return found


class Filter:
    """The whole filter: the ranges of all buckets one after the other."""

    def __init__(self, shift: int, parts: dict[int, bytes]):
        self.shift, n = shift, 1 << (64 - shift)
        self.bits = np.array([8 * len(parts.get(b, b"")) for b in range(n)], np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.bits)[:-1]])
        self.bytes = np.frombuffer(b"".join(parts.get(b, b"") for b in range(n)), np.uint8)

    def climbed(self, keys: np.ndarray) -> np.ndarray:
        """As the function, for full hashes; a bucket without a range holds none."""
        bucket, out = (keys >> np.uint64(self.shift)).astype(np.int64), np.zeros(len(keys), np.uint8)
        known = self.bits[bucket] > 0
        out[known] = _climbed(self.bytes, keys[known], self.base[bucket[known]], self.bits[bucket[known]])
        return out


def range_bits(counts: np.ndarray) -> int:
    """The bits of a range that holds keys with these counts: a power of two."""
    entries = int(_level(counts).sum()) + len(counts)
    return 1 << max(3, math.ceil(math.log2(ENTRY_BITS * max(1, entries))))


def _blocks(batches):
    """(block id, doc ids, held, tokens of each document) of consecutive documents.

    The id holds a digest of the block's tokens beside its place, so that two scans that differ can't be mistaken for each other.
    """
    part, k = TaskContext.get().partitionId(), 0
    for piece in slices(batches, 2, BLOCK, BLOCK_BYTES):
        found = [tokens(t.as_py()) for t in piece.column(2)]
        digest = sum(int(t.sum(dtype=np.uint64)) * (2 * i + 1) for i, t in enumerate(found)) & 0xFFFFFFFF
        yield part << 48 | k << 32 | digest, piece.column(0), np.asarray(piece.column(1).to_pylist(), bool), found
        k += 1


def _gather(rows: DataFrame, shift: int) -> DataFrame:
    """(kind, bucket, block, keys, counts): words (kind 0) and bigrams (kind 1) of each block by hash range, with training counts."""
    buckets = 1 << (64 - shift)
    edges = (np.arange(1, buckets, dtype=np.uint64)) << np.uint64(shift)

    def run(batches):
        for block, _, held, found in _blocks(batches):
            sizes = [len(t) for t in found]
            trains = np.repeat(~held, sizes)
            words, inverse = np.unique(np.concatenate(found), return_inverse=True)
            counts = np.bincount(inverse, trains, len(words)).astype(np.uint32)
            pairs, inverse = np.unique(np.concatenate([bigrams(t) for t in found]), return_inverse=True)
            times = np.bincount(inverse, trains, len(pairs)).astype(np.uint32)
            out = []
            for kind, keys, n in ((0, words, counts), (1, pairs, times)):
                cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                for b in np.flatnonzero(np.diff(cuts)):
                    s = slice(cuts[b], cuts[b + 1])
                    packed = keys[s].tobytes() if kind == 0 else keys[s].astype(np.uint32).tobytes()
                    out.append((kind, int(b), block, packed, n[s].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["kind", "bucket", "block", "keys", "counts"])

    return rows.mapInArrow(run, "kind int, bucket int, block long, keys binary, counts binary")


MERGED = "kind int, bucket int, block long, counts binary, n long, v long"


def _merge():
    """Adds up one bucket: a row for each block, of counts for words and of levels for bigrams, and one of totals.

    Totals (n, v) are tokens and distinct words of training for words (kind 2), bits and set bits of the bucket's
    range of the filter for bigrams (kind 3), with the range itself as ``counts``.
    """
    fields = [("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("counts", pa.binary()), ("n", pa.int64()), ("v", pa.int64())]

    def run(key, rows):
        kind, bucket = (k.as_py() for k in key)
        packed = rows.column("keys").to_pylist()
        keys = np.frombuffer(b"".join(packed), np.uint64 if kind == 0 else np.uint32)
        unique, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint32), len(unique)).astype(np.int64)  # whole up to 2**53
        if kind == 1:
            keep, short = total >= 1, unique.astype(np.uint64)
            bits = range_bits(total[keep])
            part = np.frombuffer(filled(short[keep], total[keep], bits), np.uint8)
            told, sums = climbed(part, short, 32, bits), (part.tobytes(), bits, int(np.bitwise_count(part).sum(dtype=np.int64)))
        else:
            told, sums = total, (None, int(total.sum(dtype=np.int64)), int((total > 0).sum()))
        ends = np.cumsum([len(p) // keys.itemsize for p in packed])
        out = [(kind, bucket, block, told[inverse[e - len(p) // keys.itemsize : e]].tobytes(), None, None) for block, p, e in zip(rows.column("block").to_pylist(), packed, ends)]
        out.append((kind + 2, bucket, -1, *sums))
        return pa.table({name: pa.array(c, t) for (name, t), c in zip(fields, zip(*out))})

    return run


def hash_shift(rows: DataFrame) -> int:
    """The bits of a hash below those that name its bucket."""
    buckets = max(64, 1 << math.ceil(math.log2(max(1, rows.count() / DOCS_PER_BUCKET))))
    return 65 - buckets.bit_length()


def merged_blocks(rows: DataFrame, shift: int | None = None) -> DataFrame:
    """The table of ``_merge``, written, of rows (doc_id, held, text)."""
    return written(_gather(rows, hash_shift(rows) if shift is None else shift).groupBy("kind", "bucket").applyInArrow(_merge(), MERGED))


def set_share(merged: DataFrame) -> tuple[int, float]:
    """The bits of the whole filter, and the share of them that is set."""
    n, v = merged.filter("kind = 3").agg(F.sum("n"), F.sum("v")).first()
    return n or 0, (v or 0) / max(1, n or 0)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Base and model log10 probabilities of every text; rows where held_out (a boolean Column) holds don't train."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).cast("string").alias("text"))
    shift = hash_shift(rows)
    merged = merged_blocks(rows, shift)
    total = merged.filter("kind = 2").agg(F.sum("n"), F.sum("v")).first()
    n, v = total[0] or 0, total[1] or 0
    below = n + ADD * (v + 1)
    shipped = None
    if set_share(merged)[0] <= 8 * filter_bytes:
        parts = merged.filter("kind = 3").select("bucket", "counts").toLocalIterator()  # one range at a time
        shipped = ship(docs.sparkSession, Filter(shift, {r.bucket: bytes(r.counts) for r in parts}))

    def coded(batches):
        for block, ids, held, found in _blocks(batches):
            words, inverse = np.unique(np.concatenate(found), return_inverse=True)
            ends = np.cumsum([len(t) for t in found])
            codes = [inverse[e - len(t) : e].astype(np.uint32).tobytes() for t, e in zip(found, ends)]
            first = [words.tobytes(), *[b""] * (len(found) - 1)]  # the block's words, once
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int64()), ids, pa.array(held), pa.array(codes, pa.binary()), pa.array(first, pa.binary())], names=["block", "doc_id", "held", "codes", "words"])

    def scored(left, right):
        if left.num_rows and not right.num_rows:
            raise RuntimeError("two scans of the documents gave different rows: write them as a table first")
        parts = sorted(zip(*(right.column(c).to_pylist() for c in ("kind", "bucket", "counts"))))
        count, told = (np.frombuffer(b"".join(p for k, _, p in parts if k == kind), dtype) for kind, dtype in ((0, np.int64), (1, np.uint8)))
        count = count.astype(float)
        one = (count + ADD) / below
        words = np.frombuffer(b"".join(left.column("words").to_pylist()), np.uint64)
        coded = [np.frombuffer(c, np.uint32) for c in left.column("codes").to_pylist()]
        pairs, inverse = np.unique(np.concatenate([_EMPTY, *(bigrams(words[c]) for c in coded)]), return_inverse=True)
        found = told if shipped is None else shipped.value.climbed(pairs)
        levels = np.split(found[inverse], np.cumsum([len(c) for c in coded[:-1]]))
        out = []
        for doc, held, c, q in zip(left.column("doc_id").to_pylist(), left.column("held").to_pylist(), coded, levels):
            before = count[np.concatenate([c[-1:], c[:-1]])]
            two = np.where(q > 0, np.exp2(q - 1.0), 0) / np.maximum(before, 1)
            p = (1 - MIX) * one[c] + MIX * np.minimum(two, 1)
            out.append((doc, held, len(c), int((count[c] > 0).sum()), n, float(np.log10(one[c]).sum()), float(np.log10(p).sum())))
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = [x.split()[0] for x in SCORES.split(", ")]
        return pa.table({name: pa.array(col, k) for name, k, col in zip(names, kinds, zip(*out) if out else [[]] * 7)})

    codes = rows.mapInArrow(coded, "block long, doc_id long, held boolean, codes binary, words binary")
    told = merged.filter("kind < 2" if shipped is None else "kind = 0").select("kind", "block", "bucket", "counts")
    return codes.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(scored, SCORES)
