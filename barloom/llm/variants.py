"""Spelling variants: pairs of words one edit apart, by finite-state composition, and the form that each word is a variant of.

1. Tasks count the words of whole texts; words are summed by a shuffle.
2. The acceptor of the vocabulary is composed with a transducer of exactly one edit and with itself. Before the edit
   both sides of the composition read the same letters and so are in one state: the state behind a prefix. All pairs
   that part behind that prefix lie in the words that begin with it, so prefixes cut the composition into parts that
   share no pair. A part of at most ``bound`` words is built as a minimised acceptor in one task and composed there.
3. A larger part takes one step of the composition as a join. Pairs whose edit is the letter behind the prefix agree in
   all letters but that one (``stepped``); the others go on to the prefix that is one letter longer.
4. Of the words near a word, the most frequent one is its form, if it is at least ``factor`` times as frequent. Forms are
   followed to the last one by doubling; frequencies at least double at each step, so that there are no circles.

Defined results: null and empty texts have no words; a null id counts as no text before the colon of its checksums;
repeated rows count each time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm._common import slices, small, whole_runs, written

LEAST_LENGTH, LEAST_COUNT, FACTOR = 5, 3, 2
#: Words of a part that one task composes.
BOUND = 8192
#: Prefix lengths that are looked at together.
STEPS = 16
#: Words that a task counts before it hands them on.
COUNTED = 1 << 18

# One byte a letter: A-Z in lower case, a-z and U+00C0 to U+00FF stay, all else parts words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs_of(text: str | None) -> list[bytes]:
    """The runs of letters of a text in lower case, one byte (Latin-1) a letter."""
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def altered(doc_id: int | None, runs: list[bytes], modulus: int) -> list[bytes]:
    """The runs, with one letter deleted from those whose checksum ``modulus`` divides."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    sums = [zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start) for w in runs]
    for i, h in enumerate(sums):
        if not h % modulus:
            w, at = runs[i], h % len(runs[i])
            runs[i] = w[:at] + w[at + 1 :]
    return runs


def vocabulary(docs: DataFrame, modulus: int = 97) -> DataFrame:
    """(word, n): the words of docs (doc_id, text) that are long and frequent enough."""

    def given(counts):
        words = [w for w in counts if len(w) >= LEAST_LENGTH]
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array([counts[w] for w in words], pa.int64())], names=["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for part in slices(batches, "text"):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                counts.update(altered(doc_id, runs_of(text.as_py()), modulus))
                if len(counts) > COUNTED:
                    yield given(counts)
                    counts.clear()
        yield given(counts)

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def acceptor(words: list[str]) -> tuple[list[tuple[bool, tuple]], int]:
    """The minimal acceptor of distinct sorted words: states (final, ((letter, next), ...)), those after a state before it, and the start."""
    known: dict[tuple, int] = {}
    states: list[tuple] = []
    path: list[list] = [[False, []]]
    last = ""

    def settle(length: int) -> None:
        while len(path) > length + 1:
            node = path.pop()
            state = (node[0], tuple(node[1]))
            if (i := known.get(state)) is None:
                i = known[state] = len(states)
                states.append(state)
            path[-1][1].append((last[len(path) - 1], i))

    for w in words:
        n = next((k for k, (a, b) in enumerate(zip(w, last)) if a != b), min(len(w), len(last)))
        settle(n)
        path.extend([False, []] for _ in w[n:])
        path[-1][0] = True
        last = w
    settle(0)
    states.append((path[0][0], tuple(path[0][1])))
    return states, len(states) - 1


def _moved(pairs: np.ndarray, i: int, j: int) -> np.ndarray:
    return pairs + np.array([i, j])


def composed(words: list[str]) -> np.ndarray:
    """The pairs (i, j) of places in ``words`` (distinct, sorted) whose words are one edit apart, each pair once."""
    states, start = acceptor(words)
    final = [s[0] for s in states]
    arcs = [dict(s[1]) for s in states]
    size, skip = [], []  # accepted words of a state; how many of them come before those of each letter
    for f, out in states:
        at, before = int(f), {}
        for letter, q in out:
            before[letter] = at
            at += size[q]
        size.append(at)
        skip.append(before)
    # One edit is taken, then both sides read the same: q and r must have words in common.
    edits = [[(arcs[q][a], skip[q][a], arcs[q][b], skip[q][b]) for a in arcs[q] for b in arcs[q] if a < b] for q in range(len(states))]
    longer = [[(a, p, skip[q][a]) for a, p in arcs[q].items()] for q in range(len(states))]
    both: dict[tuple[int, int], np.ndarray | None] = {}
    todo = [(min(p, r), max(p, r)) for e in edits for p, _, r, _ in e if p != r]
    # The letter taken out isn't the one read next by the shorter word, else a later edit gives the same pair.
    todo += [(min(arcs[p][b], r), max(arcs[p][b], r)) for q in range(len(states)) for a, p, _ in longer[q] for b, r in arcs[q].items() if b != a and b in arcs[p] and arcs[p][b] != r]
    while todo:
        pair = todo.pop()
        if pair not in both:
            both[pair] = None
            p, r = arcs[pair[0]], arcs[pair[1]]
            todo += [(min(p[a], r[a]), max(p[a], r[a])) for a in p.keys() & r.keys() if p[a] != r[a]]

    def common(p: int, r: int) -> np.ndarray | None:
        if p == r:
            return np.repeat(np.arange(size[p])[:, None], 2, axis=1)
        found = both[min(p, r), max(p, r)]
        return found if p < r or found is None else found[:, ::-1]

    for p, r in sorted(both, key=sum):  # what follows a state has a smaller number
        found = [np.zeros((1, 2), np.int64)] if final[p] and final[r] else []
        for a in arcs[p].keys() & arcs[r].keys():
            if (c := common(arcs[p][a], arcs[r][a])) is not None:
                found.append(_moved(c, skip[p][a], skip[r][a]))
        both[p, r] = np.concatenate(found) if found else None
    near: list[np.ndarray | None] = []
    for q in range(len(states)):
        found = [_moved(near[p], skip[q][a], skip[q][a]) for a, p in arcs[q].items() if near[p] is not None]
        found += [_moved(c, i, j) for p, i, r, j in edits[q] if (c := common(p, r)) is not None]
        for a, p, i in longer[q]:
            if final[p] and final[q]:
                found.append(np.array([[i, 0]]))
            for b, r in arcs[q].items():
                if b != a and b in arcs[p] and (c := common(arcs[p][b], r)) is not None:
                    found.append(_moved(c, i + skip[p][b], skip[q][b]))
        near.append(np.concatenate(found) if found else None)
    return np.zeros((0, 2), np.int64) if near[start] is None else near[start]


def _best(n: Column, word: Column) -> Column:
    """Compares as: the most frequent first, then in code-point order."""
    return F.struct((-n).alias("m"), word.alias("word"))


def partitions(vocab: DataFrame, bound: int) -> tuple[DataFrame | None, DataFrame]:
    """(word, n, d) for each prefix (length d) of a word that begins more than ``bound`` words; (prefix, word, n): the parts below."""
    length, base, todo, levels = F.length("word"), 0, vocab, None
    while True:
        lengths = F.sequence(F.lit(base), F.least(F.lit(base + STEPS - 1), length))
        each = todo.filter(length >= base).select("word", "n", F.explode(lengths).alias("d")).withColumn("prefix", F.expr("substring(word, 1, d)"))
        hot = written(each.groupBy("prefix").agg(F.count("*").alias("k")).filter(F.col("k") > bound).select("prefix"))
        if hot.isEmpty():
            break
        at = written(each.join(small(hot), "prefix").select("word", "n", "d"))
        levels = at if levels is None else levels.unionByName(at)
        base += STEPS
        todo = at.filter(F.col("d") == base - 1).select("word", "n")
        if todo.isEmpty():
            break
    if levels is None:
        return None, vocab.select(F.lit("").alias("prefix"), "word", "n")
    depth = levels.groupBy("word").agg(F.count("*").cast("int").alias("depth"))
    rest = vocab.join(depth, "word", "left").withColumn("depth", F.coalesce("depth", F.lit(0))).filter(F.col("depth") <= length)
    return levels, rest.select(F.expr("substring(word, 1, depth)").alias("prefix"), "word", "n")


def stepped(levels: DataFrame) -> DataFrame:
    """(word, n_near, best) by edits of the letter at d alone: words that agree without that letter, at most one for each letter."""
    letter = F.expr("substring(word, d + 1, 1)")
    without = F.when(F.col("d") < F.length("word"), F.expr("concat(substring(word, 1, d), substring(word, d + 2))"))
    held = levels.select("d", F.explode(F.filter(F.array(without, F.col("word")), lambda x: x.isNotNull())).alias("rest"), F.struct("word", "n", letter.alias("letter")).alias("x"))
    groups = held.groupBy("d", "rest").agg(F.collect_list("x").alias("g")).filter(F.size("g") > 1)
    pairs = groups.select("g", F.explode("g").alias("x")).select("x", F.explode("g").alias("y")).filter(F.col("x.letter") != F.col("y.letter"))
    return pairs.groupBy(F.col("x.word").alias("word")).agg(F.count("*").alias("n_near"), F.min(_best(F.col("y.n"), F.col("y.word"))).alias("best"))


def inside(parts: DataFrame) -> DataFrame:
    """(word, n_near, best) by composition within each part (prefix, word, n)."""

    def run(batches):
        for table in whole_runs(batches, "prefix"):
            prefix, words, n = (np.asarray(table.column(c).to_pylist(), object if c != "n" else np.int64) for c in ("prefix", "word", "n"))
            cuts = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1], [True]]))
            out: tuple[list, list, list, list] = ([], [], [], [])
            for i, j in zip(cuts[:-1], cuts[1:]):
                if j - i < 2:
                    continue
                k = len(prefix[i])
                order = i + np.argsort(words[i:j], kind="stable")
                pairs = composed([w[k:] for w in words[order]])
                if not len(pairs):
                    continue
                a, b = order[np.concatenate([pairs, pairs[:, ::-1]]).T]
                # the best near word first: most frequent, then in order (order is sorted, so places in it do)
                place = np.empty(j - i, np.int64)
                place[order - i] = np.arange(j - i)
                at = np.lexsort((place[b - i], -n[b], a))
                a, b = a[at], b[at]
                first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                out[0].extend(words[a[first]])
                out[1].extend(np.diff(np.append(first, len(a))).tolist())
                out[2].extend((-n[b[first]]).tolist())
                out[3].extend(words[b[first]])
            best = pa.StructArray.from_arrays([pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=["m", "word"])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), best], names=["word", "n_near", "best"])

    return parts.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(run, "word string, n_near long, best struct<m: long, word: string>")


def near_words(vocab: DataFrame, bound: int = BOUND) -> DataFrame:
    """(word, n_near, best): how many words of vocab (word, n) are one edit from each word that has any, and the best of them."""
    levels, parts = partitions(vocab, bound)
    found = inside(parts) if levels is None else inside(parts).unionByName(stepped(levels))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): the last form that each word of forms (word, form) leads to; each round doubles the steps taken."""
    at = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        then = written(at.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if then.filter("_moved").isEmpty():
            return then.select("word", "root")
        at = then.select("word", "root")


def variants(docs: DataFrame, bound: int = BOUND, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs (doc_id, text)."""
    vocab = written(vocabulary(docs))
    rows = vocab.join(near_words(vocab, bound), "word", "left")
    chosen = -F.col("best.m") >= factor * F.col("n")
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("best.word")).alias("form"), F.when(chosen, -F.col("best.m")).alias("form_n")))
    roots = last_forms(rows.filter("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
