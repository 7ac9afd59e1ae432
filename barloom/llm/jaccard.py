"""N-gram Jaccard join over sets of five-word shingles, and its connected groups.

1. Equal sets are one set from the start; its smallest document id stands for it.
2. Two sets of Jaccard similarity 0.8 or more share ``m`` of the first ``n - ceil(0.8 n) + m`` shingles of each, in
   any fixed order; m grows with the set (``needed``), so that long sets meet by more than one chance. Shingles that a sample of the documents shows to be frequent come last in that order, which
   keeps common passages out of the joins; the order changes the work only, never the result.
3. Sets that share such a shingle are first paired with one of them, drawn by hash from a few draws by shingle (stars:
   a group of thousands of near copies costs a few pairs for each member), verified, and joined into groups.
4. Then pairs that share a shingle across two groups are looked at; pairs within one group need no further proof. The
   sets that share a frequent shingle (over ``HOT`` of them) are dealt into blocks of one size band, and blocks of the
   same or neighbouring bands meet in tiles. In a tile, counts of the bits set in one hashed bitmap and not in the other
   bound every overlap from above; only pairs that the bound lets through become rows, so that a family of thousands of
   sets that don't link makes no quadratic number of rows. Blocks of one and the same group don't meet, and blocks whose
   sets all share a smaller frequent shingle meet at that one only: a family that shares dozens is compared once.
5. Whatever pairs remain are bounded by the bitmaps in the same way and have their sorted arrays intersected.

Defined results: a null, empty or blank text has no shingles and links with nothing; fewer words than five are one
shingle; repeated rows and ids are linked like other copies; rows with a null id get the smallest id of their group
(null if there is none); an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm._common import ship, slices, small, written

WIDTH = 5
BITMAP_BITS = 1024
#: One in this many documents is sampled to order the shingles; those seen in SEEN of them count as frequent.
SAMPLE, SEEN = 16, 3
#: Frequent shingles that are broadcast, at most (8 bytes each): the most frequent ones.
FREQUENT = 1 << 20
#: Sets drawn by hash as centres of the stars over one family of near copies.
STARS = 8
#: Sets that share a shingle up to which their pairs are joined; more meet in tiles of blocks of about TILE sets.
HOT, TILE = 64, 1024
#: Of a set's shared shingles, the smallest ones that it carries into a tile, so that a pair is told once, not at each shingle.
LOW = 8
#: A set that more than one in HOT_SHARE documents hold is hot; so there are fewer than HOT_SHARE of these, and they are broadcast.
HOT_SHARE = 4096

_R = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(_R, -1, 1 << 64)
        for name, base in (("p", _R), ("q", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["p"], _POWERS["q"]


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of a text, A-Z lower-cased, in order."""
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    p, q = _powers(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * p[: len(raw)])])
    return mixed((sums[ends] - sums[starts]) * q[starts])


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    h = word_hashes(text)
    n = len(h)
    if not n:
        return h
    if n < width:
        at, total = np.arange(1, n + 1, dtype=np.uint64), np.uint64(n)
        return mixed((h * (at * np.uint64(2) + np.uint64(1)) * np.uint64(_R)).sum(keepdims=True) + total)
    out = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        out = out * np.uint64(_R) + h[j : n - width + 1 + j]
    return np.unique(mixed(out + np.uint64(width)))


def bitmap(s: np.ndarray) -> bytes:
    bits = np.zeros(BITMAP_BITS, bool)
    bits[(s & np.uint64(BITMAP_BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def bound(n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An upper bound of each overlap: a bit set on one side only stands for a member that the other side lacks."""
    only = lambda x, y: np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64)
    return np.minimum(n_a - only(a, b), n_b - only(b, a))


def linked(overlap, n_a, n_b):
    return 100 * overlap >= 80 * (n_a + n_b - overlap)


def needed(n: int) -> int:
    """How many shingles of its prefix a set of n must share with any set that links with it and is not smaller."""
    return 1 + n // 50


def prefix(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order: infrequent ones, then by hash."""
    n = len(s)
    length = n - (4 * n + 4) // 5 + needed(n)
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
        s = np.concatenate([s[~late][:length], s[late][:length]])
    return s[:length]


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that many documents share, judged by a sample; at most FREQUENT of them."""

    def run(batches):
        for part in slices(batches, 0):
            found = [shingles(t.as_py()) for t in part.column(0)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(SAMPLE)) == 0).select("text")
    counted = written(sample.mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= SEEN))
    sizes = counted.groupBy(F.floor(F.log2("count") * 16).alias("level")).count().orderBy(F.desc("level")).collect()  # under 1000 levels
    total, least = 0, None
    for r in sizes:
        total += r["count"]
        if total > FREQUENT:
            break
        least = r.level
    if least is None:
        return np.zeros(0, np.uint64)
    rows = counted.filter(F.floor(F.log2("count") * 16) >= least).select("h").collect()
    return np.sort(np.array([r.h for r in rows], np.int64).view(np.uint64))


def sets(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(doc_id, n, key, bitmap, prefix) of each document; key is a digest of the set, null if it is empty."""
    shipped = ship(docs.sparkSession, frequent)

    def run(batches):
        late = shipped.value
        for part in slices(batches, 1):
            found = [shingles(t.as_py()) for t in part.column(1)]
            first = [prefix(s, late).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in found]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in first])])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in found], pa.int32()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in found], pa.binary()),
                    pa.array([bitmap(s) for s in found], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(first) if first else np.zeros(0, np.int64))),
                ],
                names=["doc_id", "n", "key", "bitmap", "prefix"],
            )

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, n int, key binary, bitmap binary, prefix array<long>")


def keys(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key) as in sets()."""

    def run(batches):
        for batch in slices(batches, 1):
            found = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None) for s in (shingles(t.as_py()) for t in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int32()), pa.array([k for _, k in found], pa.binary())], names=["doc_id", "n", "key"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n int, key binary")


def _arrays(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, members): the sorted shingles of the documents named in ids (rep)."""

    def run(batches):
        for part in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py()).tobytes() for t in part.column(1)], pa.binary())], names=["rep", "members"])

    source = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    return source.join(small(written(ids)), "rep", "left_semi").mapInArrow(run, "rep long, members binary").dropDuplicates(["rep"])


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, of candidate pairs (a, b)."""

    def by_bits(batches):
        for batch in batches:
            n_a, n_b = (np.asarray(batch.column(i), np.int64) for i in (2, 4))
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), np.uint8) for i in (3, 5))
            most = bound(n_a, n_b, a, b)
            yield batch.select([0, 1]).filter(pa.array(linked(most, n_a, n_b)))

    def by_sets(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                keep.append(bool(linked(int((both[1:] == both[:-1]).sum()), len(a), len(b))))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    # The second of a pair is joined first: a star's head is the first, and its set then needs no copy for each pair.
    side = lambda k: reps.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("bitmap").alias(f"bits_{k}"))
    tile = _band(F.col("n_a"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    near = written(near.repartition(tile, F.pmod("b", F.lit(1024))).mapInArrow(by_bits, "a long, b long"))
    held = written(_arrays(docs, near.select(F.explode(F.array("a", "b")).alias("rep")).distinct()))
    member = lambda k: held.select(F.col("rep").alias(k), F.col("members").alias(f"members_{k}"))
    return near.join(member("b"), "b").join(member("a"), "a").select("a", "b", "members_a", "members_b").mapInArrow(by_sets, "a long, b long")


def enough(shared: DataFrame, part: int = 1, beside: Column | None = None) -> DataFrame:
    """The distinct pairs (a, b) of rows (a, b, n_a, n_b), one for each shared shingle, that share as many as linked sets
    must. With ``part``, of rows that show only a part of what is shared: that fraction of the number will do. ``beside``:
    how many more shingles the two may share that have no rows here, which the number is lowered by."""
    least = 1 + F.floor(F.least("n_a", "n_b") / (50 * part))
    keys = ["a", "b", "n_a", "n_b"]
    counted = shared.groupBy(*keys).agg(F.count("*").alias("count"), F.first(F.lit(0) if beside is None else beside).alias("beside"))
    return counted.filter(F.col("count") >= least - F.col("beside")).select("a", "b")


def _band(n: Column) -> Column:
    """Linked sets are in the same or in neighbouring bands: their sizes differ by a factor of at most 1.25."""
    return F.floor(F.log(n) / F.log(F.lit(1.25))).cast("int")


def meetings(held: DataFrame) -> DataFrame:
    """(token, block_x, block_y): where the blocks of rows held (token, band, block, lone, low) meet.

    ``always`` are the shingles that all sets of a block carry. Where two blocks have a smaller one in common, each of
    their pairs is told at that shingle or at a smaller one, so they needn't meet here.
    """
    common = F.aggregate(F.collect_list("low"), F.first("low"), F.array_intersect)  # a block has about TILE sets
    blocks = held.groupBy("token", "band", "block", "lone").agg(common.alias("always"))
    x, y = (blocks.select("token", *[F.col(c).alias(f"{c}_{k}") for c in ("band", "block", "lone", "always")]) for k in "xy")
    earlier = F.exists(F.array_intersect("always_x", "always_y"), lambda t: t < F.col("token"))
    return x.join(y, "token").filter(
        (F.col("block_x") <= F.col("block_y")) & (F.abs(F.col("band_x") - F.col("band_y")) <= 1) & ~F.coalesce(F.col("lone_x") == F.col("lone_y"), F.lit(False)) & ~earlier
    ).select("token", "block_x", "block_y")


def tiled(hot: DataFrame, reps: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) across groups that the bitmaps let through, of rows hot (token, rep, n, group)."""
    hot = hot.select("token", "rep", "n", "group", _band(F.col("n")).alias("band"))
    big = written(hot.groupBy("token", "band", "group").agg(F.count("*").alias("k")).filter(F.col("k") > TILE // 2).withColumnRenamed("k", "own"))
    hot = hot.join(small(big), ["token", "band", "group"], "left")
    rest = written(hot.groupBy("token", "band").agg(F.count_if(F.col("own").isNull()).alias("rest")))
    hot = hot.join(small(rest), ["token", "band"])
    parts = F.ceil(F.coalesce("own", "rest") / TILE)
    lone = F.when(F.col("own").isNotNull(), F.col("group"))
    dealt = F.pmod(F.xxhash64(F.when(lone.isNotNull(), F.col("rep")).otherwise(F.col("group"))), parts)
    low = hot.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list("token")), 1, LOW).alias("low"))
    held = hot.select("token", "band", "rep", "n", "group", lone.alias("lone"), dealt.alias("part")).join(low, "rep").join(reps.select("rep", "bitmap"), "rep")
    held = written(held.withColumn("block", F.concat_ws(":", "band", F.coalesce(F.col("lone").cast("string"), F.lit("-")), "part")))
    meet = meetings(held)
    tiles = meet.select("token", F.concat_ws("|", "block_x", "block_y").alias("tile"), F.explode(F.array_distinct(F.array("block_x", "block_y"))).alias("block"), (F.col("block_x") == F.col("block_y")).alias("alone"))
    rows = held.join(tiles, ["token", "block"]).select("token", "tile", "alone", "block", "rep", "n", "group", "low", "bitmap")

    def compared(key, table):
        token, order = key[0].as_py(), np.argsort(np.asarray(table.column("block").to_pylist()), kind="stable")
        rep, n, group = (np.asarray(table.column(c), np.int64)[order] for c in ("rep", "n", "group"))
        bits = np.frombuffer(b"".join(table.column("bitmap").to_pylist()), np.uint64).reshape(len(rep), -1)[order]
        names, low = np.asarray(table.column("block").to_pylist())[order], table.column("low").to_pylist()
        cut = 0 if table.column("alone")[0].as_py() else int(np.searchsorted(names, names[0], "right"))
        found: list[tuple[int, int]] = []
        for at in range(0, cut or len(rep), 64):
            i = np.arange(at, min(at + 64, cut or len(rep)))
            j = np.arange(cut or at + 1, len(rep))
            both = np.minimum(n[i, None] - np.bitwise_count(bits[i, None] & ~bits[None, j]).sum(axis=2, dtype=np.int64), n[None, j] - np.bitwise_count(bits[None, j] & ~bits[i, None]).sum(axis=2, dtype=np.int64))
            ok = linked(both, n[i, None], n[None, j]) & (group[i, None] != group[None, j]) & (j[None] > i[:, None])
            for u, v in zip(*np.nonzero(ok)):
                a, b = int(i[u]), int(j[v])
                if not any(t < token for t in set(low[order[a]]) & set(low[order[b]])):
                    found.append((min(rep[a], rep[b]), max(rep[a], rep[b])))
        return pa.table({c: pa.array([int(f[k]) for f in found], pa.int64()) for k, c in enumerate("ab")})

    return rows.groupBy("token", "tile").applyInArrow(compared, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches; roots themselves are left out.

    Alternates large and small stars until nothing changes; each round is a table in the shared folder.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = mark(e)
        if after == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    reps = sets(docs, frequent_shingles(docs)).filter("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "n", "bitmap", "prefix")).alias("s"), F.count("*").alias("copies"))
    reps = written(reps.select("key", "copies", F.col("s.doc_id").alias("rep"), "s.n", "s.bitmap", "s.prefix"))
    entries = reps.select("rep", "n", F.explode("prefix").alias("token"))
    draw = F.xxhash64("rep", F.pmod("token", F.lit(STARS)))
    heads = entries.groupBy("token").agg(F.min(F.struct(draw.alias("draw"), "n", "rep")).alias("head"), F.count("*").alias("k")).filter("k > 1").select("token", "head")
    shared = written(entries.join(heads, "token"))
    near = lambda x, y: (5 * F.least(x, y) >= 4 * F.greatest(x, y))
    star = shared.filter((F.col("head.rep") != F.col("rep")) & near(F.col("n"), F.col("head.n")))
    star = written(enough(star.select(F.col("head.rep").alias("a"), F.col("rep").alias("b"), F.col("head.n").alias("n_a"), F.col("n").alias("n_b")), 2 * STARS))
    groups = components(verified(star, reps, docs))
    # Across groups: only shingles that sets of several groups share, and only pairs that weren't tried.
    labelled = shared.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("token", "rep", "n", F.coalesce("root", "rep").alias("group"))
    mixed_up = labelled.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count("*").alias("k")).filter("lo <> hi").select("token", "k")
    labelled = written(labelled.join(mixed_up, "token"))
    hot = labelled.filter(F.col("k") > HOT)
    often = hot.groupBy("rep").agg(F.count("*").alias("often"))
    cool = labelled.filter(F.col("k") <= HOT).join(often, "rep", "left").select("token", "rep", "n", "group", F.coalesce("often", F.lit(0)).alias("often"))
    x, y = cool.alias("x"), cool.alias("y")
    across = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.group") < F.col("y.group")) & near(F.col("x.n"), F.col("y.n")))
    across = across.select(
        F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"), F.least("x.n", "y.n").alias("n_a"), F.greatest("x.n", "y.n").alias("n_b"), F.least("x.often", "y.often").alias("often")
    )
    across = enough(across, beside=F.col("often")).unionByName(tiled(hot, reps)).distinct()
    across = written(across.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    if not across.isEmpty():
        more = verified(across, reps, docs)
        groups = components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    named = written(reps.select("key", "rep", "copies").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("root", "rep").alias("group"), "copies"))
    return grouped(keys(docs), named).select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("group")).alias("component_id")
    )


def grouped(rows: DataFrame, named: DataFrame) -> DataFrame:
    """rows (doc_id, n, key) with the ``group`` of their key, of named (key, group, copies); a null key has none.

    Sets that many documents hold are found by a broadcast (fewer than HOT_SHARE of them by their definition). The other
    rows are shuffled by key, if they aren't few; rows that look for nothing any more are dealt by their id.
    """
    least = (named.agg(F.sum("copies")).first()[0] or 0) // HOT_SHARE
    every = named.select("key", "group")
    if (few := small(every)) is not every:
        return rows.join(few, "key", "left")
    hot = F.broadcast(named.filter(F.col("copies") > least).select("key", F.col("group").alias("hot_group")))
    done = F.col("key").isNull() | F.col("hot_group").isNotNull()
    dealt = F.when(done, F.xxhash64("doc_id").cast("string").cast("binary")).otherwise(F.concat(F.lit(b"k"), F.col("key")))
    found = every.select(F.concat(F.lit(b"k"), F.col("key")).alias("dealt"), "group")
    near = rows.join(hot, "key", "left").withColumn("dealt", dealt).join(found, "dealt", "left")
    return near.select("doc_id", "n", "key", F.coalesce("hot_group", "group").alias("group"))
