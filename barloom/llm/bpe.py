"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

The words of all texts are counted once; the most frequent ones (about ``LEXICON_WORDS``, found by a histogram of
counts, so that only they reach the driver) are merged there and compiled into a shared-suffix automaton whose arcs
carry word numbers, so a walk yields the place of the word's token ids. The automaton is one byte string of bounded
size; each Python worker memory-maps it from a file without a name, which goes with the worker. Words that it doesn't
hold are merged exactly by rank. Walks and merges run over all new words of a slice of texts at once, in numpy.

Defined results: a null or empty text has no tokens; repeated rows are encoded alike; only the id and text
columns are read, so other columns and their names don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import tempfile
import unicodedata
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm._common import ship, slices, written

#: Words in the transducer, about at most. With at most 48 bytes of word each, it stays under about 20 MB.
LEXICON_WORDS = 1 << 16
LEXICON_BYTES = 48
#: Entries of a worker's word cache and of a counting table before it is emptied.
CACHE_WORDS = 100_000
#: Bytes of text that are encoded at a time.
SLICE = 1 << 20
#: Words of more bytes are merged one by one, with a heap.
LONG_WORD = 96
#: Words merged at once, few enough for the processor's cache.
MERGED_AT_ONCE = 4096

_GENERAL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The same classes written out for texts without characters above U+00FF.
_LATIN = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    "|[^\x09-\x0d \x85\xa0A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"
)
_WIDE = re.compile("[^\x00-\xff]")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """A tokenizer file's merges and ids, with exact merging of one word."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.letters = byte_letters()
        self.table = str.maketrans({chr(b): c for b, c in self.letters.items()})
        names = {i: s for s, i in (self.ids | self.special).items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.size = len(self.names)
        merges = sorted((self.ids[a] * self.size + self.ids[b], r, self.ids[a + b]) for (a, b), r in self.ranks.items())
        self.pairs, self.pair_ranks, joined = (np.array([m[i] for m in merges], np.int64) for i in range(3))
        self.joined = np.zeros(len(self.ranks), np.int64)
        self.joined[self.pair_ranks] = joined
        self.inner, self.last = (np.array([self.ids.get(self.letters[b] + end, -1) for b in range(256)], np.int64) for end in ("", self.suffix))

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; the number of merges for none."""
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.pair_ranks[at], len(self.ranks))

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers. In each round every word has its first pair of the best rank merged."""
        if not words:
            return []
        if not len(self.pairs) or any(len(w) > LONG_WORD for w in words):
            return [np.array(self.merge(w.decode()), "<i4").tobytes() for w in words]
        if len(words) > MERGED_AT_ONCE:
            return [x for i in range(0, len(words), MERGED_AT_ONCE) for x in self.merge_all(words[i : i + MERGED_AT_ONCE])]
        sizes = np.array([len(w) for w in words], np.int64)
        flat, of = np.frombuffer(b"".join(words), np.uint8), np.repeat(np.arange(len(words)), sizes)
        ids, ends = self.inner[flat], np.cumsum(sizes) - 1
        ids[ends] = self.last[flat[ends]]
        top, done = len(self.ranks), []
        rank = np.full(len(ids), top)
        rank[:-1] = np.where(of[1:] == of[:-1], self._ranks_of(ids[:-1], ids[1:]), top)
        while len(ids):
            new = np.concatenate([[True], of[1:] != of[:-1]])
            best = np.minimum.reduceat(rank, np.flatnonzero(new))
            word = np.cumsum(new) - 1
            best = best[word]
            if (ended := best == top).any():
                done.append((of[ended], ids[ended]))
                live = ~ended
                of, ids, rank, best, word = of[live], ids[live], rank[live], best[live], word[live]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == best)
            at = at[np.concatenate([[True], word[at][1:] != word[at][:-1]])]
            ids[at] = self.joined[rank[at]]
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            shift = np.cumsum(kept) - 1
            of, ids, rank, at = of[kept], ids[kept], rank[kept], shift[at]
            near = np.unique(np.concatenate([at, np.maximum(at - 1, 0)]))
            right = np.minimum(near + 1, len(ids) - 1)
            rank[near] = np.where((of[right] == of[near]) & (right > near), self._ranks_of(ids[near], ids[right]), top)
        of, ids = (np.concatenate(x) for x in zip(*done))
        ids = ids[np.argsort(of, kind="stable")].astype("<i4").tobytes()
        cuts = (4 * np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words)))])).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def merge(self, word: str) -> list[int]:
        parts = list(word.encode().decode("latin-1").translate(self.table))
        parts[-1] += self.suffix
        ranks, top = self.ranks, len(self.ranks)
        if len(parts) > 200:
            return self._merge_long(parts)
        while len(parts) > 1:
            found = [ranks.get(p, top) for p in zip(parts, parts[1:])]
            best = min(found)
            if best == top:
                break
            a, b = parts[(i := found.index(best))], parts[i + 1]
            joined, out, n = a + b, parts[:i], len(parts)
            while i < n:
                if parts[i] == a and i + 1 < n and parts[i + 1] == b:
                    out.append(joined)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [self.ids[p] for p in parts]

    def _merge_long(self, parts: list[str]) -> list[int]:
        """The same merges with a heap over a linked list: n log n for words of any length."""
        import heapq

        n, ranks = len(parts), self.ranks
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, p) for i, p in enumerate(zip(parts, parts[1:])) if (r := ranks.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], nxt[i] = a + b, False, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (r := ranks.get(p := (parts[i], parts[nxt[i]]))) is not None:
                    heapq.heappush(heap, (r, i, p))
            if prv[i] >= 0 and (r := ranks.get(p := (parts[prv[i]], parts[i]))) is not None:
                heapq.heappush(heap, (r, prv[i], p))
        return [self.ids[p] for p, live in zip(parts, alive) if live]


def words_of(segment: str) -> list[str]:
    """Normalised words of a text without special tokens."""
    text = segment if segment.isascii() else unicodedata.normalize("NFC", segment)
    text = text.replace("Σ", "σ").lower()
    return (_GENERAL if _WIDE.search(text) else _LATIN).findall(text)


class Lexicon:
    """A minimal acyclic automaton over the words' bytes; a path's arc numbers add up to the word's number."""

    @staticmethod
    def build(entries: dict[bytes, list[int]]) -> bytes:
        words = sorted(entries)
        states: list[list] = [[False, []]]  # final, [(label, target)]
        register: dict[tuple, int] = {}
        path = [0]

        def close(down_to: int) -> None:
            while len(path) > down_to + 1:
                child = path.pop()
                key = (states[child][0], tuple(states[child][1]))
                kept = register.setdefault(key, child)
                if kept != child:
                    arcs = states[path[-1]][1]
                    arcs[-1] = (arcs[-1][0], kept)

        last = b""
        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            close(same)
            for c in word[same:]:
                states.append([False, []])
                states[path[-1]][1].append((c, len(states) - 1))
                path.append(len(states) - 1)
            states[path[-1]][0] = True
            last = word
        close(0)
        order, number = [0], {0: 0}
        for s in order:
            for _, t in states[s][1]:
                if t not in number:
                    number[t] = len(order)
                    order.append(t)
        size: dict[int, int] = {}
        stack = [0]
        while stack:
            s = stack[-1]
            todo = [t for _, t in states[s][1] if t not in size]
            if todo:
                stack.extend(todo)
            else:
                size[s] = int(states[s][0]) + sum(size[t] for _, t in states[s][1])
                stack.pop()
        arcs_at, targets, adds, finals = array("q"), array("i"), array("i"), bytearray()
        for place, s in enumerate(order):
            final, arcs = states[s]
            passed = int(final)
            for c, t in arcs:
                arcs_at.append(place << 8 | c)
                targets.append(number[t])
                adds.append(passed)
                passed += size[t]
            finals.append(final)
        at, ids = array("i", [0]), array("i")
        for word in words:
            ids.extend(entries[word])
            at.append(len(ids))
        parts = [arcs_at.tobytes(), bytes(finals), targets.tobytes(), adds.tobytes(), at.tobytes(), ids.tobytes()]
        head = np.array([len(p) for p in parts], np.int64).tobytes()
        pad = lambda p: p + bytes(-len(p) % 8)
        return head + b"".join(map(pad, parts))

    def __init__(self, blob: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(self.map, np.int64, 6)
        starts = 48 + np.concatenate([[0], np.cumsum((sizes + 7) // 8 * 8)])
        part = lambda i, kind: np.frombuffer(self.map, kind, int(sizes[i]) // np.dtype(kind).itemsize, int(starts[i]))
        self.arcs, self.finals = part(0, np.int64), part(1, np.uint8)
        self.targets, self.adds, self.at = (part(i, np.int32) for i in (2, 3, 4))
        self.ids = memoryview(self.map)[int(starts[5]) : int(starts[5] + sizes[5])]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for words that the automaton doesn't hold: all walks advance together, an arc at a time."""
        out = np.full(len(words), -1)
        if not len(self.arcs):
            return out
        sizes = np.array([len(w) for w in words], np.int64)
        flat, start = np.frombuffer(b"".join(words) or bytes(1), np.uint8), np.cumsum(sizes) - sizes
        live, state, number, step = np.flatnonzero(sizes <= LEXICON_BYTES), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
        while len(live):
            ended = live[sizes[live] == step]
            ended = ended[self.finals[state[ended]] == 1]
            out[ended] = number[ended]
            live = live[sizes[live] > step]
            keys = state[live] << 8 | flat[start[live] + step]
            arc = np.minimum(np.searchsorted(self.arcs, keys), len(self.arcs) - 1)
            found = self.arcs[arc] == keys
            live, arc, step = live[found], arc[found], step + 1
            number[live] += self.adds[arc]
            state[live] = self.targets[arc]
        return out

    def get(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian 32-bit integers."""
        number = int(self.numbers([word])[0])
        return None if number < 0 else self.entry(number)

    def entry(self, number: int) -> bytes:
        return bytes(self.ids[4 * int(self.at[number]) : 4 * int(self.at[number + 1])])


class Encoder(dict):
    """word -> its ids as bytes; filled from the transducer, else by exact merging; when it is full, merged words go."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        super().__init__()
        self.vocabulary, self.lexicon, self.listed = vocabulary, lexicon, {}
        self.split = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None

    def learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        numbers = self.lexicon.numbers(raw) if self.lexicon else np.full(len(raw), -1)
        unseen = []
        for w, r, n in zip(words, raw, numbers.tolist()):
            if n >= 0:
                self[w] = self.listed[w] = self.lexicon.entry(n)
            else:
                unseen.append((w, r))
        for some in ([x for x in unseen if len(x[1]) <= LONG_WORD], *([x] for x in unseen if len(x[1]) > LONG_WORD)):
            if some:
                self.update(zip((w for w, _ in some), self.vocabulary.merge_all([r for _, r in some])))

    def parts(self, text: str | None) -> list[str]:
        """The words of a text, and its special tokens as such."""
        if not text:
            return []
        if self.split is None or "<" not in text or not self.split.search(text):
            return words_of(text)
        return [w for part in self.split.split(text) for w in ([part] if part in self.vocabulary.special else words_of(part))]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        lists = [self.parts(t) for t in texts]
        every = set().union(*lists)
        new = every - self.keys()
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
            self.update(self.listed)
            new = every - self.keys()
        special = self.vocabulary.special
        self.update((w, np.array([special[w]], "<i4").tobytes()) for w in new & special.keys())
        self.learn(sorted(new - special.keys()))
        return [b"".join(map(self.__getitem__, words)) for words in lists]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


_LOADED: dict = {}


def _encoder(key: str, content, blob) -> Encoder:
    """One encoder for each worker process and lexicon."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(Vocabulary(content.value), Lexicon(blob.value))
    return _LOADED[key]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def word_counts(docs: DataFrame, content: bytes, text: str = "text") -> DataFrame:
    """(word, n): how often each normalised word occurs in all texts; partly summed before the shuffle."""
    special = sorted(Vocabulary(content).special)

    def count(batches):
        split = regex.compile("|".join(map(regex.escape, special))) if special else None
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                if t := t.as_py():
                    for part in split.split(t) if split and "<" in t else (t,):
                        seen.update(words_of(part))
                    if len(seen) >= CACHE_WORDS:
                        yield flush()
        yield flush()

    return docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, content: bytes, words: int = LEXICON_WORDS, text: str = "text") -> bytes:
    """The transducer of about the ``words`` most frequent words that occur twice or more.

    A histogram of counts on a log scale (under 1000 levels) gives the level at which the number is reached; of that
    level a share drawn by hash is taken. Only the words taken reach the driver.
    """
    counted = word_counts(docs, content, text).filter((F.octet_length("word") <= LEXICON_BYTES) & (F.col("n") > 1))
    counted = written(counted.select("word", F.floor(F.log2("n") * 16).cast("int").alias("level")))
    left, least, share = words, 1 << 30, 0.0
    for r in counted.groupBy("level").count().orderBy(F.desc("level")).collect():
        least, share, left = r.level, min(1.0, left / r["count"]), left - r["count"]
        if left <= 0:
            break
    drawn = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))
    top = counted.filter((F.col("level") > least) | ((F.col("level") == least) & drawn)).select("word").collect()
    vocabulary = Vocabulary(content)
    raw = sorted(r.word.encode() for r in top)
    ids = vocabulary.merge_all(raw)
    return Lexicon.build({w: np.frombuffer(i, "<i4").tolist() for w, i in zip(raw, ids)})


def _texts(ids: pa.ListArray, names: pa.Array) -> pa.Array:
    """The tokens' strings joined by spaces, as a file without a decoder asks for."""
    ends = np.asarray(ids.offsets, np.int64)
    tokens = pa.LargeListArray.from_arrays(pa.array(ends - ends[0], pa.int64()), names.take(ids.flatten()))
    return pc.binary_join(tokens, pa.scalar(" ", pa.large_string())).cast(pa.string())


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", words: int = LEXICON_WORDS, decoded: bool = False) -> DataFrame:
    """(doc_id, ids): the token ids of each whole text; with ``decoded``, also what decode() gives for them, in one pass."""
    spark, raw = docs.sparkSession, read_vocabulary(path)
    compiled = compile_lexicon(docs, raw, words, text)
    content, blob, key = ship(spark, raw), ship(spark, compiled), hashlib.sha256(raw + compiled).hexdigest()

    def run(batches):
        encoder = _encoder(key, content, blob)
        names = pa.array(encoder.vocabulary.names, pa.large_string())
        for part in slices(batches, 1, size=SLICE):
            found = encoder.encode_all(part.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
            out = {"doc_id": part.column(0), "ids": ids} | ({"decoded": _texts(ids, names)} if decoded else {})
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the tokens' strings joined by spaces."""
    named = ship(encoded.sparkSession, Vocabulary(read_vocabulary(path)).names)

    def run(batches):
        names = pa.array(named.value, pa.large_string())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _texts(part.column(1), names)], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
