import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from barloom.llm import bpe
from barloom.llm.queries import op7_bpe_transducer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None,
    "",
    "It's A TEST don't we'LL Été é x² 12345 !!??..",
    "a<|endoftext|>B <|startoftext|><|endoftext|> <|endof",
    "ΣΑΣ İstanbul 漢字かな \U0001f600\U0001f600 ١٢  x y\u0085z",
    "a" * 5000 + " " + "xyz" * 700,
    "tab\tnew\nline \x1c\x1f​ end",
    "the the the",
]


def expected(texts):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts], t


def test_matches_library(spark):
    want, t = expected(ODD)
    rows = [(i, x, "clash") for i, x in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    for words in (0, 3, 1000):
        got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, PATH, words=words), PATH).collect()}
        for i, ids in enumerate(want):
            assert got[i].ids == ids, (i, words)
            assert got[i].decoded == t.decode(ids, skip_special_tokens=False)


def test_query_against_library(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op7_bpe_transducer(spark, d).collect()}
    assert got.keys() == docs.keys()
    want, t = expected(docs.values())
    for k, ids in zip(docs, want):
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert got[k].decoded_sha256 == sha(t.decode(ids, skip_special_tokens=False))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, PATH).count() == 0


def test_lexicon_numbers():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["tap", "taps", "top", "tops", "a", "zebra"])}
    lex = bpe.Lexicon(bpe.Lexicon.build(words))
    import numpy as np

    for w, ids in words.items():
        assert list(np.frombuffer(lex.get(w), "<i4")) == ids
    assert lex.get(b"ta") is None and lex.get(b"tapz") is None and lex.get(b"") is None


def test_merges_and_walks_of_many_words_at_once(spark):
    vocabulary = bpe.Vocabulary(bpe.read_vocabulary(PATH))
    words = sorted({w for t in ODD if t for w in bpe.words_of(t)} | {"a", "aaaa", "aaaaaaa", "ababab", "ñandú", "é" * 40, "x" * 300})
    want = [np.array(vocabulary.merge(w), "<i4").tobytes() for w in words]
    raw = [w.encode() for w in words]
    assert vocabulary.merge_all(raw) == want and vocabulary.merge_all([r for r in raw if len(r) <= bpe.LONG_WORD]) == [x for x, r in zip(want, raw) if len(r) <= bpe.LONG_WORD]
    assert vocabulary.merge_all([]) == []
    held = {r: np.frombuffer(x, "<i4").tolist() for r, x in list(zip(raw, want))[::2] if len(r) <= bpe.LEXICON_BYTES}
    lexicon = bpe.Lexicon(bpe.Lexicon.build(held))
    assert [None if n < 0 else np.frombuffer(lexicon.entry(n), "<i4").tolist() for n in lexicon.numbers(raw).tolist()] == [held.get(r) for r in raw]
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    one, two = bpe.encode(docs, PATH, words=9, decoded=True), bpe.decode(bpe.encode(docs, PATH, words=9), PATH)
    assert sorted(map(tuple, one.collect()), key=lambda r: r[0]) == sorted(map(tuple, two.collect()), key=lambda r: r[0])


def test_lexicon_leaves_no_file(tmp_path, monkeypatch):
    monkeypatch.setattr("tempfile.tempdir", str(tmp_path))
    lexicon = bpe.Lexicon(bpe.Lexicon.build({b"the": [5, 6], b"then": [7]}))
    assert not list(tmp_path.iterdir())
    assert [lexicon.get(w) for w in (b"the", b"then", b"th")] == [np.array(x, "<i4").tobytes() if x else None for x in ([5, 6], [7], None)]
