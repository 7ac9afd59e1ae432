"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum
over all its segmentations into pieces, found by the forward algorithm; a text's is the product over its words.
The piece probabilities come from expectation-maximisation over the words of a bounded, documented sample of
labelled texts; scoring covers every whole text.

Units: maximal runs of non-white-space (of any length, never cut), with the vocabulary's word mark in front. A
character that is no piece counts as one unknown piece of the same probability in each language. New words are scored
together: sorted, so that words with a common start share its forward sums, and against a trie of the reversed pieces,
so that only pieces that end at a place are looked at. Words of over ``SHORT`` characters are summed in logarithms.

Defined results: a null text or one without letters (by ``str.isalpha``) is ``und`` with score 0, as is every text when no labelled
text was given; ties go to the language that sorts first; repeated rows are scored alike; rows with a null
language or text teach nothing; only the named columns are read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm._common import ship, slices

#: Expected number of texts drawn by hash for each language to learn from.
TEXTS_PER_LANGUAGE = 2_000
ROUNDS = 3
#: Characters of a word up to which plain products stay above the least double.
SHORT = 31
UNKNOWN = 1e-8
SMOOTH = 0.1
CACHE_WORDS = 200_000

_LETTER = re.compile(r"[^\W\d_]")
MARK = "▁"


def has_letter(text: str) -> bool:
    """Whether any character is a letter; the pattern also finds numerals such as fractions."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def read_pieces(path: str) -> dict[str, int]:
    """piece -> number, of the vocabulary's ordinary pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    odd = [i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)]
    found = [sp.id_to_piece(i) for i in sorted(set(range(n)) - set(odd))]
    return {p: i for i, p in enumerate(dict.fromkeys(found))}


def lattice(words: list[str], pieces: dict[str, int]) -> np.ndarray:
    """[word, end, length - 1] -> piece number; len(pieces) for none, one more for an unknown character. Words of one length."""
    none, n = len(pieces), len(words[0])
    get, deep = pieces.get, min(max(map(len, pieces)), n)
    out = np.full((len(words), n + 1, deep), none, np.int32)
    spans = [(e, k, e - k - 1) for e in range(1, n + 1) for k in range(min(deep, e))]
    flat = [get(w[s:e], none) for w in words for e, k, s in spans]
    ends, lengths = np.array([e for e, _, _ in spans]), np.array([k for _, k, _ in spans])
    out[:, ends, lengths] = np.array(flat, np.int32).reshape(len(words), -1)
    single = out[:, 1:, 0]
    single[single == none] = none + 1
    return out


def forward(edges: np.ndarray, p: np.ndarray) -> np.ndarray:
    """alpha[word, position, ...]: summed probability of all segmentations up to each position."""
    n = edges.shape[1] - 1
    alpha = np.zeros((edges.shape[0], n + 1, *p.shape[1:]))
    alpha[:, 0] = 1
    for e in range(1, n + 1):
        for k in range(min(edges.shape[2], e)):
            alpha[:, e] += alpha[:, e - k - 1] * p[edges[:, e, k]]
    return alpha


def expect(edges: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts over all segmentations, words weighed by their counts."""
    n, deep = edges.shape[1] - 1, edges.shape[2]
    alpha, beta = forward(edges, p), np.zeros((edges.shape[0], n + 1))
    beta[:, n] = 1
    for s in range(n - 1, -1, -1):
        for k in range(min(deep, n - s)):
            beta[:, s] += p[edges[:, s + k + 1, k]] * beta[:, s + k + 1]
    share, out = weight / alpha[:, n], np.zeros(len(p))
    for e in range(1, n + 1):
        for k in range(min(deep, e)):
            i = edges[:, e, k]
            out += np.bincount(i, alpha[:, e - k - 1] * p[i] * beta[:, e] * share, len(p))
    return out


def long_edges(word: str, pieces: dict[str, int], deep: int) -> list[list[tuple[int, int]]]:
    """For each end, the (start, piece number) of every piece that ends there."""
    none = len(pieces)
    out = []
    for e in range(1, len(word) + 1):
        found = [(s, pieces[word[s:e]]) for s in range(max(0, e - deep), e - 1) if word[s:e] in pieces]
        out.append([*found, (e - 1, pieces.get(word[e - 1], none + 1))])
    return out


def long_forward(edges: list[list[tuple[int, int]]], logs: np.ndarray) -> np.ndarray:
    """[position, ...]: logarithms of the forward sums of one word of any length."""
    alpha = np.full((len(edges) + 1, *logs.shape[1:]), -np.inf)
    alpha[0] = 0
    for e, into in enumerate(edges, 1):
        alpha[e] = np.logaddexp.reduce([alpha[s] + logs[i] for s, i in into])
    return alpha


def long_expect(edges: list[list[tuple[int, int]]], p: np.ndarray, weight: float) -> np.ndarray:
    """expect() of one word of any length."""
    with np.errstate(divide="ignore"):
        logs = np.log(p)
    alpha, n, out = long_forward(edges, logs), len(edges), np.zeros(len(p))
    beta = np.full(n + 1, -np.inf)
    beta[n] = 0
    for e in range(n, 0, -1):
        for s, i in edges[e - 1]:
            beta[s] = np.logaddexp(beta[s], logs[i] + beta[e])
            out[i] += weight * np.exp(alpha[s] + logs[i] + beta[e] - alpha[n])
    return out


def learn(words: list[str], counts: np.ndarray, pieces: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    """Probability of each piece by expectation-maximisation, smoothed; the last two are 'none' and 'unknown'."""
    p, deep = np.append(np.full(len(pieces), 1 / len(pieces)), [0, UNKNOWN]), max(map(len, pieces))
    sized: dict[int, tuple[list[str], list[float]]] = {}
    long = []
    for w, c in zip(words, counts):
        if len(w) < SHORT:
            group = sized.setdefault(len(w), ([], []))
            group[0].append(MARK + w)
            group[1].append(c)
        else:
            long.append((long_edges(MARK + w, pieces, deep), float(c)))
    lattices = [(lattice(u[i : i + 20_000], pieces), np.array(c[i : i + 20_000], float)) for u, c in sized.values() for i in range(0, len(u), 20_000)]
    for _ in range(rounds):
        found = sum((expect(e, p, c) for e, c in lattices), np.zeros(len(p))) + sum((long_expect(e, p, c) for e, c in long), np.zeros(len(p)))
        found = found[:-2] + SMOOTH
        p = np.append(found / found.sum(), [0, UNKNOWN])
    return p


def word_lists(texts: pa.Array) -> pa.ListArray:
    return pc.utf8_split_whitespace(pc.fill_null(texts, ""))


def fit(docs: DataFrame, pieces: dict[str, int], texts: int = TEXTS_PER_LANGUAGE):
    """(languages, log prior, piece probabilities [piece, language]); docs: (doc_id, text, lang) to learn from."""
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    n = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(n)
    if not langs:
        return [], np.zeros(0), np.zeros((len(pieces) + 2, 0))
    spark = docs.sparkSession
    share = spark.createDataFrame([(k, texts / v) for k, v in n.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.join(F.broadcast(share), "lang").filter(draw < F.col("share"))

    def words(batches):
        for part in slices(batches, 1):
            found = word_lists(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pc.list_parent_indices(found)), found.flatten()], names=["lang", "word"])

    counted = sample.select("lang", "text").mapInArrow(words, "lang string, word string").filter("word <> ''").groupBy("lang", "word").count()
    shipped = ship(spark, pieces)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word")
        p = learn(list(pdf.word), pdf["count"].to_numpy(), shipped.value)
        return pd.DataFrame({"lang": [pdf.lang.iloc[0]], "p": [p.astype("<f8").tobytes()]})

    found = {r.lang: np.frombuffer(r.p, "<f8") for r in counted.groupBy("lang").applyInPandas(one, "lang string, p binary").collect()}
    langs = sorted(found)
    total = np.array([n[k] for k in langs], float)
    return langs, np.log(total / total.sum()), np.stack([found[k] for k in langs], axis=1)


class Trie:
    """The reversed pieces as a trie: a hash table from (state, character) to the next state, and the piece that each state spells."""

    def __init__(self, pieces: dict[str, int]):
        states: dict[int, int] = {}
        spelt = {}
        for piece, number in pieces.items():
            state = 0
            for c in reversed(piece):
                state = states.setdefault(state << 21 | ord(c), len(states) + 1)
            spelt[state] = number
        self.piece = np.full(len(states) + 1, -1)
        self.piece[list(spelt)] = list(spelt.values())
        bits = max(4, (4 * len(states)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.next = np.full(1 << bits, -1), np.full(1 << bits, -1)
        keys = np.array(list(states), np.int64)
        for k, slot, state in zip(keys.tolist(), self.slots(keys).tolist(), states.values()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.next[slot] = k, state

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The next states, -1 for none."""
        keys = states << 21 | chars
        slots = self.slots(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.next[slots], -1)
        again = np.flatnonzero((held != keys) & (held >= 0))
        while len(again):
            slots[again] = (slots[again] + 1) & self.mask
            held = self.keys[slots[again]]
            out[again] = np.where(held == keys[again], self.next[slots[again]], -1)
            again = again[(held != keys[again]) & (held >= 0)]
        return out


class Scorer:
    """Log probabilities of words in each language, with a bounded cache."""

    def __init__(self, pieces: dict[str, int], p: np.ndarray):
        self.pieces, self.p = pieces, p
        self.trie, self.deep = Trie(pieces), max(map(len, pieces))
        with np.errstate(divide="ignore"):
            self.logs = np.log(p)
        self.place: dict[str, int] = {}
        self.rows = np.zeros((CACHE_WORDS, p.shape[1]))

    def _score(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.p.shape[1]))
        for i in (i for i, w in enumerate(words) if len(w) >= SHORT):
            out[i] = long_forward(long_edges(MARK + words[i], self.pieces, self.deep), self.logs)[-1]
        order = sorted((i for i, w in enumerate(words) if len(w) < SHORT), key=words.__getitem__)
        if order:
            out[order] = np.log(self._shared([MARK + words[i] for i in order]))
        return out

    def _shared(self, words: list[str]) -> np.ndarray:
        """The summed probability of each of the sorted words; nodes are their distinct beginnings, level by level."""
        sizes = np.array([len(w) for w in words])
        wide = int(sizes.max())
        text = np.array(words, f"<U{wide}").view(np.uint32).reshape(len(words), wide).astype(np.int64)
        fresh = np.ones(text.shape, bool)
        fresh[1:] = np.logical_or.accumulate(text[1:] != text[:-1], axis=1)
        unknown = len(self.pieces) + 1
        out = np.zeros((len(words), self.p.shape[1]))
        # The node of each word at the levels before, newest first: its number in the level, for the levels' sums.
        alphas, chars, parents = [np.ones((1, self.p.shape[1]))], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        at = np.zeros(len(words), np.int64)
        live = np.arange(len(words))
        for level in range(1, wide + 1):
            first = fresh[live, level - 1]
            first[0] = True
            parent, char = at[live[first]], text[live[first], level - 1]
            at[live] = np.cumsum(first) - 1
            chars.append(char)
            parents.append(parent)
            alpha = np.zeros((len(char), self.p.shape[1]))
            node = np.arange(len(char))  # who is still walking back, where it is, and in what state
            here, state = node, np.zeros(len(char), np.int64)
            for back in range(min(level, self.deep)):
                state = self.trie.step(state, chars[level - back][here])
                before = parents[level - back][here]
                found = state >= 0
                piece = np.where(found, self.trie.piece[state], -1)
                if back == 0:
                    piece = np.where(piece < 0, unknown, piece)
                hit = np.flatnonzero(piece >= 0)
                alpha[node[hit]] += alphas[level - back - 1][before[hit]] * self.p[piece[hit]]
                node, here, state = node[found], before[found], state[found]
                if not len(node):
                    break
            alphas.append(alpha)
            ended = live[sizes[live] == level]
            out[ended] = alpha[at[ended]]
            live = live[sizes[live] > level]
            if not len(live):
                break
        return out

    def of(self, words: list[str]) -> np.ndarray:
        get = self.place.get
        at = np.array([get(w, -1) for w in words], np.int64)
        missing = np.flatnonzero(at < 0)
        fresh = [words[i] for i in missing]
        made = self._score(fresh)
        out = self.rows[np.maximum(at, 0)]
        out[missing] = made
        if len(self.place) + len(fresh) > CACHE_WORDS:
            self.place.clear()
        if len(fresh) <= CACHE_WORDS:
            start = len(self.place)
            self.rows[start : start + len(fresh)] = made
            self.place.update(zip(fresh, range(start, start + len(fresh))))
        return out


_LOADED: dict[str, Scorer] = {}


def predict(docs: DataFrame, pieces: dict[str, int], model) -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language and its posterior; docs: (doc_id, text)."""
    import uuid

    shipped, key = ship(docs.sparkSession, (pieces, *model)), uuid.uuid4().hex

    def run(batches):
        pieces, langs, prior, p = shipped.value
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = Scorer(pieces, p)
        scorer = _LOADED[key]
        for part in slices(batches, 1, 4096, 2 << 20):
            texts = part.column(1).to_pylist()
            lists = word_lists(part.column(1))
            words = lists.flatten().dictionary_encode()
            table = scorer.of(words.dictionary.to_pylist())
            codes, ends = np.asarray(words.indices), np.cumsum(np.asarray(pc.list_value_length(lists)))
            sums = np.concatenate([np.zeros((1, len(langs))), np.cumsum(table[codes], axis=0)]) if langs else None
            tags, scores, start = [], [], 0
            for t, end in zip(texts, ends):
                if t and langs and has_letter(t):
                    f = sums[end] - sums[start] + prior
                    best = int(np.argmax(np.round(f, 6)))
                    tags.append(langs[best])
                    scores.append(round(float(1 / np.exp(np.minimum(f - f[best], 700)).sum()), 9))
                else:
                    tags.append("und")
                    scores.append(0.0)
                start = end
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tags, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
