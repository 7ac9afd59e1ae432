"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words of a text are hashed in runs of ``K``; of every ``SPAN - K + 1`` consecutive run hashes the least is kept.
Two texts that share ``SPAN`` words in a row share such a stretch of hashes and so a kept one: joining the kept
hashes of documents and benchmark items finds every shared span. One scan of the documents counts their words and
marks the texts that share a kept hash; only those are read again. Each hit is then extended word by word along its
diagonal (document position less item position), which makes the result exact. Items of fewer than ``SPAN`` words are
looked for by the hashes of whole word runs of their length, in the same scan.

Whatever is broadcast is measured first (``BROADCAST_BYTES``); beyond that the same join is shuffled.

Defined results: a null text has no words; an item without words or with a null id or text never hits; texts are
matched by content (their MD5), so repeated rows and rows with a null id get the results of their text; several rows
of one item id count as one item; an empty table of either kind gives no hits; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm._common import attach, small, written

SPAN = 10
K = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column, exact: bool = True) -> Column:
    """The words of a text, A-Z lower-cased; not exact: as they are."""
    lowered = F.translate(text, UPPER, LOWER) if exact else text
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), SEPARATORS_ANY_CASE if not exact else SEPARATORS), "")


#: The same for texts that aren't lower-cased.
SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def run_hashes(w: Column, k: int = K) -> Column:
    """The hash of each run of k words, in order; none in shorter texts."""
    runs = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(runs, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))


def hashed(df: DataFrame, *keep: str) -> DataFrame:
    """The ``keep`` columns and hs, the run hashes of the words in column w; a column of its own, so that lambdas don't recompute the words."""
    return df.select(*keep, run_hashes(F.col("w")).alias("hs"))


def kept_hashes(h: Column, window: int = SPAN - K + 1) -> Column:
    """The distinct least hashes of all windows of consecutive run hashes."""
    starts = F.when(F.size(h) >= window, F.sequence(F.lit(0), F.size(h) - window)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.least(*[F.get(h, i + j) for j in range(window)])))


def kept_places(h: Column, window: int = SPAN - K + 1) -> Column:
    """The distinct (hash, place) of the last least hash of each window."""
    starts = F.when(F.size(h) >= window, F.sequence(F.lit(0), F.size(h) - window)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(
        F.transform(starts, lambda i: F.array_min(F.array(*[F.struct(F.get(h, i + j).alias("h"), (-i - j).alias("back")) for j in range(window)])))
    )


def marks(w: Column, hs: Column, short: list[int]) -> Column:
    """The hashes by which a text is found: the kept ones of its runs, and those of all runs of the short lengths."""
    return F.array_distinct(F.concat(kept_hashes(hs), *[run_hashes(w, n) for n in short])) if short else kept_hashes(hs)


def scanned(docs: DataFrame, wanted: DataFrame, short: list[int], *ids: str) -> DataFrame:
    """(ids, text_key, n_words, n_rows, near) of the distinct (ids, text) of docs, written; near: a mark is in wanted (h).

    Letters beyond A-Z are lower-cased word by word on both sides here, which lets no equal words differ.
    """
    rows = docs.select(*ids, F.md5("text").alias("text_key"), words(F.col("text"), exact=False).alias("w"))
    rows = rows.select(*ids, "text_key", F.size("w").cast("long").alias("n_words"), F.transform("w", lambda x: F.lower(x)).alias("w"))
    rows = rows.select(*ids, "text_key", "n_words", "w", run_hashes(F.col("w")).alias("hs"))
    rows = rows.select(*ids, "text_key", "n_words", F.posexplode_outer(marks(F.col("w"), F.col("hs"), short)).alias("pos", "h"))
    rows = rows.join(small(wanted.select("h", F.lit(True).alias("found"))), "h", "left")
    first = F.when(F.coalesce("pos", F.lit(0)) == 0, 1)
    return written(rows.groupBy(*ids, "text_key").agg(F.max("n_words").alias("n_words"), F.count(first).alias("n_rows"), F.max(F.coalesce("found", F.lit(False))).alias("near")))


def _items(items: DataFrame) -> tuple[DataFrame, list[int]]:
    """(item_id, iw), and the lengths under SPAN that occur."""
    items = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", words(F.col("text")).alias("iw")).filter(F.size("iw") > 0).distinct()
    items = written(items)
    return items, sorted(r[0] for r in items.filter(F.size("iw") < SPAN).select(F.size("iw")).distinct().collect())  # under SPAN values


def _wanted(items: DataFrame, short: list[int]) -> DataFrame:
    """(h): the distinct marks of the items; short items have only the run of their own length."""
    lowered = items.select(F.transform("iw", lambda x: F.lower(x)).alias("w"))
    of = hashed(lowered.filter(F.size("w") >= SPAN)).select(F.explode(kept_hashes(F.col("hs"))).alias("h"))
    for n in short:
        of = of.unionByName(lowered.filter(F.size("w") == n).select(F.explode(run_hashes(F.col("w"), n)).alias("h")))
    return written(of.distinct())


def _occurrences(near: DataFrame, items: DataFrame, short: list[int]) -> DataFrame:
    """(text_key, item_id, start, length): every occurrence of an item's window in the texts near (text_key, w)."""
    long = items.filter(F.size("iw") >= SPAN)
    i_at = hashed(long.select("item_id", F.col("iw").alias("w")), "item_id").select("item_id", F.explode(kept_places(F.col("hs"))).alias("p"))
    i_at = i_at.select("item_id", F.col("p.h").alias("h"), F.col("p.back").alias("i_back"))
    # Every run of these few texts meets the items' kept hashes: cheaper than choosing the kept ones again, with their places.
    hits = hashed(near, "text_key").select("text_key", F.posexplode("hs").alias("d_at", "h")).join(small(i_at), "h")
    hits = written(hits.select("text_key", "item_id", (F.col("i_back") + F.col("d_at")).alias("shift")).distinct())
    # Of the document only the words beside the item's are kept, from the item's word "lo" on.
    both = near.join(small(hits.join(small(long), "item_id")), "text_key")
    lo = F.greatest(-F.col("shift"), F.lit(0))
    both = both.select("text_key", "item_id", "shift", "iw", lo.alias("lo"), F.slice("w", F.greatest("shift", F.lit(0)) + 1, F.size("iw") - lo).alias("beside"))
    same = F.transform("iw", lambda x, j: F.coalesce(F.get("beside", j - F.col("lo")) == x, F.lit(False)))
    both = both.select("text_key", "item_id", "shift", same.alias("same"))
    # "same" is named twice so that the optimizer computes it once a row, not once a start.
    whole = F.filter(F.sequence(F.lit(0), F.size("same") - SPAN), lambda s: F.forall(F.slice("same", s + 1, SPAN), lambda x: x))
    out = both.select("text_key", "item_id", "shift", F.explode(whole).alias("s")).select("text_key", "item_id", (F.col("shift") + F.col("s")).alias("start"), F.lit(SPAN).alias("length"))
    for n in short:
        runs = items.filter(F.size("iw") == n).select("item_id", "iw", F.get(run_hashes(F.col("iw"), n), 0).alias("h"))
        at = near.select("text_key", "w", F.posexplode(run_hashes(F.col("w"), n)).alias("start", "h")).select("text_key", "h", "start", F.slice("w", F.col("start") + 1, n).alias("run"))
        out = out.unionByName(at.join(small(runs), "h").filter("run = iw").select("text_key", "item_id", "start", F.lit(n).alias("length")))
    return out


def matches(docs: DataFrame, items: DataFrame, *ids: str) -> tuple[DataFrame, DataFrame]:
    """The scanned rows of docs (ids, text), and (text_key, item_id, start, length): every occurrence of an item's window in their texts.

    items: (item_id, text). Both tables are written.
    """
    items, short = _items(items)
    rows = scanned(docs, _wanted(items, short), short, *ids)
    keys = rows.filter("near").select("text_key").distinct()
    texts = docs.select("text", F.md5("text").alias("text_key")).join(small(keys), "text_key", "left_semi").dropDuplicates(["text_key"])
    near = written(texts.select("text_key", words(F.col("text")).alias("w")))
    return rows, written(_occurrences(near, items, short).distinct())


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (doc_id, text) with n_words, n_hit, n_items, the sorted item ids, and whether anything hits."""
    rows, found = matches(docs.select("doc_id", "text"), items, "doc_id")
    places = F.explode(F.sequence("start", F.col("start") + F.col("length") - 1))
    n_hit = found.select("text_key", places.alias("at")).distinct().groupBy("text_key").agg(F.count("*").alias("n_hit"))
    named = found.select("text_key", F.col("item_id").cast("string").alias("item")).distinct().groupBy("text_key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    hits = written(n_hit.join(named, "text_key"))
    out = attach(rows, hits, "text_key", F.col("doc_id")).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no window of an item."""
    _, found = matches(docs.select("text"), items)
    hit = written(found.select("text_key").distinct())
    few = small(hit)
    if few is not hit:
        return docs.join(few, F.md5(docs["text"]) == few["text_key"], "left_anti")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.md5("text").alias("text_key"))
    marked = attach(rows, hit.withColumn("hit", F.lit(True)), "text_key", F.col("row"))
    return marked.filter("hit IS NULL").select(*[F.col(f"row.`{c}`") for c in docs.columns])
