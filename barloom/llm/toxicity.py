"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, all texts nobody labelled are the unlabelled set, and the share of toxic rows
among the labelled ones is the class prior. The positives may be a bounded sample (``POSITIVES``); the unlabelled set
is whole: each of its rows is in one shard of about ``SHARD`` rows, as a pattern of feature words with a count, and
each shard trains a linear classifier in numpy against all positives drawn, with the non-negative risk estimator (the
corrected negative risk may not fall below zero). The model is the mean of the shards' classifiers, so that its size
doesn't grow. Feature words are those whose share in the positives exceeds their share in all texts by far more than
chance. A text's score is the probability over all its words.

Defined results: a null or empty text, or one without letters, gets the score of the bias alone; repeated rows
are scored alike; several labels of one id count as toxic if any is; null labels count as no label; without any
positive or unlabelled text every score is 0; only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm._common import ship, slices, written

#: Confirmed positives to learn from, drawn by hash of the id (expected number), and unlabelled rows of a shard, about.
POSITIVES = 4_000
SHARD = 20_000
#: Words of the positives that are counted in all texts, the most frequent ones, and words that a classifier weighs.
CANDIDATES = 1 << 14
FEATURES = 1_024
#: Standard errors by which a word's share in the positives must exceed chance; many words are tried, and labels may be wrong.
EVIDENCE = 6.0
STEPS = 400

_LETTERS = re.compile(r"[^\W\d_]+")


def words_in(text: str | None) -> set[str]:
    return set(_LETTERS.findall(text.lower())) if text else set()


def chosen(in_p: dict[str, int], in_all: dict[str, int], n_p: int, n_all: int, features: int = FEATURES) -> list[str]:
    """The words that mark positives, from how many positives and how many texts hold each."""
    least = max(4, n_p // 200)

    def lift(w: str) -> float:
        p, q = (in_p[w] + 0.5) / (n_p + 1), (in_all.get(w, 0) + 0.5) / (n_all + 1)
        r = (in_p[w] + in_all.get(w, 0) + 1) / (n_p + n_all + 2)
        return (p - q) / np.sqrt(r * (1 - r) * (1 / n_p + 1 / n_all) + 1e-12)

    scored = sorted((-lift(w), w) for w, c in in_p.items() if c >= least)
    return [w for z, w in scored[:features] if z < -EVIDENCE]


def matrix(patterns: list, width: int) -> np.ndarray:
    x = np.zeros((len(patterns), width), np.float32)
    for i, s in enumerate(patterns):
        x[i, list(s)] = 1
    return x


def descend(xp: np.ndarray, cp: np.ndarray, xu: np.ndarray, cu: np.ndarray, prior: float, steps: int = STEPS) -> np.ndarray:
    """Weights, and the bias last: logistic loss, Adam, and gradient ascent on the negative risk where it is below zero.

    Rows are patterns of the positives (p) and the unlabelled (u) with their counts.
    """
    cp, cu = cp / cp.sum(), cu / cu.sum()
    theta = np.zeros(xp.shape[1] + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        w, b = theta[:-1].astype(np.float32), theta[-1]
        fp, fu = xp @ w + b, xu @ w + b
        negative = np.logaddexp(0, fu) @ cu - prior * (np.logaddexp(0, fp) @ cp)
        # d/df of -log(sigmoid(f)) is sigmoid(f) - 1, of -log(sigmoid(-f)) is sigmoid(f).
        gp_pos, gp_neg, gu_neg = prior * (sig(fp) - 1) * cp, -prior * sig(fp) * cp, sig(fu) * cu
        if negative >= 0:
            gp, gu = gp_pos + gp_neg, gu_neg
        else:
            gp, gu = -gp_neg, -gu_neg
        g = np.append(xp.T @ gp.astype(np.float32) + xu.T @ gu.astype(np.float32) + 1e-4 * prior * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta


def fit_member(positive: list[set[str]], unlabelled: list[set[str]], prior: float, features: int = FEATURES, steps: int = STEPS):
    """(words, weights, bias) from word sets: one classifier, with its feature words chosen from the same sets."""
    n_p, n_u = len(positive), len(unlabelled)
    if not n_p or not n_u:
        return [], np.zeros(0), 0.0
    in_p = Counter(w for s in positive for w in s)
    words = chosen(in_p, Counter(w for s in unlabelled for w in s if w in in_p), n_p, n_u, features)
    place = {w: i for i, w in enumerate(words)}
    xp, xu = (matrix([[place[w] for w in s if w in place] for s in sets], len(words)) for sets in (positive, unlabelled))
    theta = descend(xp, np.ones(n_p), xu, np.ones(n_u), prior, steps)
    return words, theta[:-1], float(theta[-1])


def _word_counts(docs: DataFrame, words: set[str] | None) -> DataFrame:
    """(word, n): in how many texts of docs (text) each word occurs; only the given words, if any are given."""
    shipped = ship(docs.sparkSession, words)

    def run(batches):
        wanted, seen = shipped.value, Counter()
        for part in slices(batches, 0):
            for t in part.column(0):
                found = words_in(t.as_py())
                seen.update(found if wanted is None else found & wanted)
            if len(seen) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _patterns(docs: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, pattern): the numbers of the words that each text holds, in order."""
    shipped = ship(docs.sparkSession, {w: i for i, w in enumerate(words)})

    def run(batches):
        place = shipped.value
        names = set(place)
        for part in slices(batches, 1):
            found = [sorted(place[w] for w in names & words_in(t.as_py())) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "pattern"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, pattern array<int>")


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, shard: int = SHARD, members: int = 1):
    """(word -> weight, bias), each in an array of one; ``members`` is the least number of shards.

    docs: (doc_id, text) that may be learned from; labels: (doc_id, toxic). To the driver come at most CANDIDATES words
    with counts, FEATURES weights, and the patterns of the positives drawn.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    kind = F.when(F.col("toxic") == 1, 1).when(F.col("toxic").isNull(), 0).otherwise(-1)
    ids = docs.select("doc_id").join(known, "doc_id", "left").withColumn("kind", kind)
    n = {r.kind: r["count"] for r in ids.groupBy("kind").count().collect()}
    n_p, n_u, n_known = n.get(1, 0), n.get(0, 0), n.get(1, 0) + n.get(-1, 0)
    if not n_p or not n_u:
        return {}, []
    prior = min(max(n_p / n_known, 1e-3), 0.9)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, positives / n_p) * (1 << 30))
    sample = written(ids.filter((F.col("kind") == 1) & drawn).select("doc_id").distinct())  # about ``positives`` rows at most
    in_p = _word_counts(docs.join(F.broadcast(sample), "doc_id", "left_semi"), None).orderBy(F.desc("n"), "word").limit(CANDIDATES)
    in_p = {r.word: r.n for r in in_p.collect()}
    in_all = {r.word: r.n for r in _word_counts(docs, set(in_p)).collect()}
    taken = max(sample.count(), *in_p.values(), 1)
    words = chosen(in_p, in_all, taken, sum(n.values()))
    shards = max(members, -(-n_u // shard))
    rows = _patterns(docs, words).join(known, "doc_id", "left").withColumn("kind", kind).filter((F.col("kind") == 0) | ((F.col("kind") == 1) & drawn))
    dealt = F.when(F.col("kind") == 0, F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(shards))).otherwise(-1)
    counted = written(rows.groupBy(dealt.alias("shard"), "pattern").agg(F.count("*").alias("n")))
    own = counted.filter("shard = -1").select("pattern", "n").collect()
    shipped = ship(docs.sparkSession, ([r.pattern for r in own], [r.n for r in own]))

    def member(pdf: pd.DataFrame) -> pd.DataFrame:
        patterns, counts = shipped.value
        theta = descend(matrix(patterns, len(words)), np.array(counts, float), matrix(list(pdf.pattern), len(words)), pdf.n.to_numpy(float), prior)
        return pd.DataFrame({"place": np.arange(len(theta)), "weight": theta, "n": float(pdf.n.sum())})

    told = counted.filter("shard >= 0").groupBy("shard").applyInPandas(member, "place int, weight double, n double")
    mean = {r.place: r.weight for r in told.groupBy("place").agg((F.sum(F.col("weight") * F.col("n")) / F.sum("n")).alias("weight")).collect()}
    return {w: np.array([mean[i]]) for i, w in enumerate(words)}, [mean[len(words)]]


def scores_of(texts, model) -> np.ndarray:
    """The score of each text of an Arrow column."""
    weights, bias = model
    bias, vocabulary, out = np.array(bias), set(weights), np.zeros(len(texts))
    for i, t in enumerate(texts):
        if len(bias):
            f = bias.copy()
            for w in sorted(vocabulary & words_in(t.as_py())):
                f += weights[w]
            out[i] = np.mean(1 / (1 + np.exp(-np.clip(f, -40, 40))))
    return np.round(out, 9)


def accepted(docs: DataFrame, model, cutoff: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores under the cut-off."""
    shipped, place = ship(docs.sparkSession, model), docs.columns.index("text")

    def run(batches):
        for part in slices(batches, place):
            yield part.filter(pa.array(scores_of(part.column(place), shipped.value) < cutoff))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score) of every whole text; docs: (doc_id, text)."""
    shipped = ship(docs.sparkSession, model)

    def run(batches):
        for part in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores_of(part.column(1), shipped.value))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
