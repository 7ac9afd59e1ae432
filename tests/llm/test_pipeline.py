import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from barloom.llm import toxicity  # noqa: E402
from barloom.llm._common import fold, table  # noqa: E402
from test_bpe import expected  # noqa: E402
from test_decontam import brute as contaminated  # noqa: E402
from test_jaccard import brute as linked  # noqa: E402


def test_stages_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents").cache()
    learn = docs.select("doc_id", "text").filter(fold("doc_id", 3) != 1)
    bad = {r.doc_id for r in toxicity.score(docs, toxicity.fit(learn, table(spark, d, "labels"))).collect() if r.score >= 0.7}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in bad]
    keep = {i for i, _, c in linked(rows) if i == c}
    rows = [r for r in rows if r[0] in keep]
    items = [(r.item_id, r.text) for r in table(spark, d, "benchmark").collect()]
    clean = {i for i, _, hit, _, _ in contaminated(rows, items) if not hit}
    step = docs
    for name, f in pipeline.STAGES[:3]:
        step = f(spark, step, d)
        assert step.columns == docs.columns, name
    step = step.cache()
    assert {r.doc_id for r in step.collect()} == clean
    redacted = pipeline.STAGES[3][1](spark, step, d)
    texts = {r.doc_id: r.text for r in redacted.collect()}
    assert redacted.columns == docs.columns and texts.keys() == clean
    got = {r.doc_id: r.ids for r in pipeline.STAGES[4][1](spark, redacted, d).collect()}
    assert [got[i] for i in texts] == expected(texts.values())[0]


def test_edges(spark, tmp_path):
    d = str(tmp_path)
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, "en", "a", 62), (1, text, "en", "a", 62), (1, "another text under the same id that is quite long", "en", "a", 9), (None, text, None, None, None), (None, "only here and without any id at all", "en", "a", 3),
            (2, None, None, None, None), (3, "", "en", "a", 0), (4, "mail me at jo@example.com please", "en", "b", 32), (5, "x " * 30_000, "en", "b", 60_000)]
    docs = spark.createDataFrame([(*r, i, "clash") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, key int, text_key string")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "seven words of a benchmark item here now ok yes sure")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    step = docs
    for name, f in pipeline.STAGES[:-1]:
        step = f(spark, step, d)
        assert step.columns == docs.columns, name
    got = sorted((r.doc_id or 0, r.text or "") for r in step.collect())
    want = sorted([(1, text), (1, rows[2][1]), (0, rows[4][1]), (2, ""), (3, ""), (4, "mail me at <EMAIL> please"), (5, rows[8][1])])
    assert got == want
    assert {r.n_chars for r in step.collect() if r.doc_id == 4} == {len("mail me at <EMAIL> please")}
    assert pipeline.STAGES[-1][1](spark, step, d).count() == len(want)
    empty = docs.limit(0)
    for _, f in pipeline.STAGES:
        empty = f(spark, empty, d)
    assert empty.count() == 0
