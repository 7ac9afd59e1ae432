"""Token counts by offset-mapped attribution.

A whole document is encoded once. Each token's character span is then joined to the document's sections (sorted,
disjoint, or overlapping character intervals) by a merge over both sorted lists, and a token that crosses a
boundary is given out by an explicit rule:

``start``    to the section that holds the token's first character
``end``      to the section that holds its last character
``largest``  to the section that holds most of its characters, the first of equals
``split``    to every section that it touches, in shares by characters

A token made of part of a character's bytes spans that character. Characters outside every section belong to
none: tokens there count only in ``outside``.

Defined results: a null or empty text has no tokens, and each of its sections has 0; empty or null sections get
0; repeated rows are counted alike; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm._common import ship

RULES = ("start", "end", "largest", "split")
_LOADED: dict = {}


def _encoding(key: str, content: bytes, pattern: str):
    if key not in _LOADED:
        import tiktoken

        _LOADED.clear()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            sizes[i] = len(token)
        _LOADED[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _LOADED[key]


def token_spans(text: str, encoding, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first character, end character) of each token of a whole text."""
    ids = np.array(encoding.encode_ordinary(text), np.int64)
    ends = np.cumsum(sizes[ids]) if len(ids) else np.zeros(0, np.int64)
    starts = ends - sizes[ids] if len(ids) else ends
    if text.isascii():
        return ids, starts, ends
    raw = np.frombuffer(text.encode(), np.uint8)
    lead = np.cumsum((raw & 0xC0) != 0x80)  # number of characters begun up to and with each byte
    return ids, lead[starts] - 1, lead[ends - 1]


def allocate(starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, stop: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(tokens, crossing tokens) of each sorted disjoint section, and the number of tokens outside all of them."""
    n = len(begin)
    tokens, crossing = np.zeros(n), np.zeros(n, np.int64)
    if not n or not len(starts):
        return tokens, crossing, len(starts)
    # Sections that a token touches: from the first that ends after its start to the last that begins before its end.
    lo, hi = np.searchsorted(stop, starts, "right"), np.searchsorted(begin, ends, "left") - 1
    inside = (lo == hi) & (begin[np.minimum(lo, n - 1)] <= starts) & (stop[np.minimum(lo, n - 1)] >= ends) & (lo < n)
    tokens += np.bincount(lo[inside], minlength=n)
    outside = int(np.sum(lo > hi))
    for k in np.flatnonzero((lo <= hi) & ~inside):
        span = np.arange(lo[k], hi[k] + 1)
        shared = np.minimum(stop[span], ends[k]) - np.maximum(begin[span], starts[k])
        span, shared = span[shared > 0], shared[shared > 0]
        if not len(span):
            outside += 1
            continue
        crossing[span] += 1
        if rule == "split":
            tokens[span] += shared / (ends[k] - starts[k])
        elif rule == "largest":
            tokens[span[np.argmax(shared)]] += 1
        elif rule == "start" and begin[span[0]] <= starts[k]:
            tokens[span[0]] += 1
        elif rule == "end" and stop[span[-1]] >= ends[k]:
            tokens[span[-1]] += 1
        else:
            outside += 1
    return tokens, crossing, outside


def line_sections(text: str | Column = "text") -> Column:
    """The lengths of a text's lines, each with the line break that ends it: sections that follow one another."""
    col = F.col(text) if isinstance(text, str) else text
    return F.transform(F.split(F.coalesce(col, F.lit("")), "\n", -1), lambda x: F.length(x) + 1)


def attribute(docs: DataFrame, vocabulary: str, pattern: str, sections: Column, rule: str = "start") -> DataFrame:
    """(doc_id, section, begin, stop, n_tokens, n_crossing, doc_tokens, outside), one row per section.

    docs: (doc_id, text); sections: per row, an array of section lengths in characters that follow one another
    from character 0, or an array of structs (begin, stop) in order without overlap.
    """
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {RULES}")
    with open(vocabulary, "rb") as f:
        raw = f.read()
    content, key = ship(docs.sparkSession, raw), hashlib.sha256(raw + pattern.encode()).hexdigest()
    names = ["doc_id", "section", "begin", "stop", "n_tokens", "n_crossing", "doc_tokens", "outside"]

    def run(batches):
        encoding, sizes = _encoding(key, content.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, texts, bounds = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()
                out: list[list] = [[] for _ in names]
                for i, t, b in zip(ids, texts, bounds):
                    t = t or ""
                    _, starts, ends = token_spans(t, encoding, sizes)
                    if b and isinstance(b[0], dict):
                        begin, stop = np.array([x["begin"] for x in b], np.int64), np.array([x["stop"] for x in b], np.int64)
                    else:
                        stop = np.cumsum(np.array(b or [], np.int64))
                        begin = stop - np.array(b or [], np.int64)
                    begin, stop = np.minimum(begin, len(t)), np.minimum(stop, len(t))
                    tokens, crossing, outside = allocate(starts, ends, begin, stop, rule)
                    n = len(begin)
                    for column, values in zip(out, ([i] * n, range(n), begin, stop, tokens, crossing, [len(starts)] * n, [outside] * n)):
                        column.extend(values)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), sections.alias("_sections"))
    return source.mapInArrow(run, "doc_id long, section int, begin long, stop long, n_tokens double, n_crossing long, doc_tokens long, outside long")
