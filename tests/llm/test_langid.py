import itertools

import numpy as np
import public_tokenizers

from barloom.llm import langid
from barloom.llm.queries import op4_marginal_unigrams


def test_forward_is_the_sum_over_segmentations():
    pieces = {p: i for i, p in enumerate(["a", "b", "ab", "ba", "aba", "▁", "▁a"])}
    p = np.append(np.random.default_rng(0).dirichlet(np.ones(len(pieces))), [0, langid.UNKNOWN])
    for word in ["▁abab", "▁baac", "c"]:
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, last = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(word[last:i])
                    last = i
            total += np.prod([p[pieces[x]] if x in pieces else (langid.UNKNOWN if len(x) == 1 else 0) for x in parts])
        assert np.isclose(langid.forward(langid.lattice([word], pieces), p)[0, -1], total)


def test_em_raises_likelihood():
    pieces = {p: i for i, p in enumerate(["a", "b", "ab", "▁", "▁ab"])}
    words, counts = ["ab", "abab", "ba"], np.array([5, 3, 1])
    like = lambda p: sum(c * np.log(langid.forward(langid.lattice(["▁" + w], pieces), p)[0, -1]) for w, c in zip(words, counts))
    assert like(langid.learn(words, counts, pieces, 1)) < like(langid.learn(words, counts, pieces, 3))


def test_edges(spark):
    pieces = langid.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rows = [(1, "the house and the garden " * 5, "en"), (2, "das haus und der garten " * 5, "de"), (3, None, "en"), (4, "", None), (5, "12 34 !!", "en"), (6, "x" * 3000, None), (6, "☃" * 60 + "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(docs, pieces, langid.fit(docs, pieces)).collect()
    by = {r.doc_id: r for r in got}
    assert (by[1].lang_pred, by[2].lang_pred) == ("en", "de") and len(got) == 7
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (3, 4, 5))
    assert all(0 <= r.score <= 1 for r in got)
    none = langid.fit(docs.filter("lang = 'xx'"), pieces)
    assert {r.lang_pred for r in langid.predict(docs, pieces, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), pieces, none).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = op4_marginal_unigrams(spark, d).join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97


def test_shared_sums_are_those_of_single_words():
    pieces = {p: i for i, p in enumerate(["a", "b", "ab", "ba", "aba", "▁", "▁a", "bbbb", "ü"])}
    p = np.random.default_rng(2).dirichlet(np.ones(len(pieces)), 3).T
    p = np.vstack([p, np.zeros(3), np.full(3, langid.UNKNOWN)])
    words = ["", "a", "ab", "abab", "abb", "b" * 30, "b" * 31, "b" * 90, "ba", "baac", "c", "ü", "üb", "ab" * 40, "a" * 29 + "c", "☃" * 60]
    scorer = langid.Scorer(pieces, p)
    with np.errstate(divide="ignore"):
        want = [langid.long_forward(langid.long_edges(langid.MARK + w, pieces, scorer.deep), np.log(p))[-1] for w in words]
    assert np.allclose(scorer.of(words), want)
    assert np.allclose(scorer.of(words[::-1]), want[::-1])
    counts, edges = np.array([2.0]), langid.lattice(["▁abab"], pieces)
    assert np.allclose(langid.expect(edges, p[:, 0], counts), langid.long_expect(langid.long_edges("▁abab", pieces, scorer.deep), p[:, 0], 2.0))


def test_letters():
    assert langid.has_letter("1½ ²a") and langid.has_letter("字") and not any(map(langid.has_letter, ["½ ²", "12 _ !", "", "Ⅷ"]))


def test_clashing_columns_ties_repeats_and_long_texts(spark):
    pieces = {p: i for i, p in enumerate(["▁", "a", "b", "▁a", "▁b", "ab"])}
    rows = [(1, "a ab a", "xx", 0.5, "q"), (1, "a ab a", "xx", 0.5, "q"), (2, "b b ba", "yy", 0.1, None), (3, "ab " * 40_000, None, None, None), (4, "a" * 50_000, None, None, None), (5, "c", None, None, None), (None, "a ab", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    model = langid.fit(docs, pieces)
    got = langid.predict(docs, pieces, model).collect()
    assert len(got) == 7 and langid.predict(docs, pieces, model).columns == ["doc_id", "lang_pred", "score"]
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 1}) == 1
    assert all(0 <= r.score <= 1 and r.lang_pred in ("xx", "yy") for r in got)
    same = spark.createDataFrame([(1, "a b", "yy"), (2, "a b", "xx")], "doc_id long, text string, lang string")
    tied = langid.predict(same, pieces, langid.fit(same, pieces)).collect()
    assert {r.lang_pred for r in tied} == {"xx"} and all(abs(r.score - 0.5) < 1e-9 for r in tied)
