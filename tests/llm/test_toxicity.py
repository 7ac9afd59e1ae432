import numpy as np

from barloom.llm import toxicity
from barloom.llm.queries import op1_nnpu_toxicity


def test_risk_estimator_separates():
    rng = np.random.default_rng(1)
    filler = [f"w{i}" for i in range(300)]
    draw = lambda bad: set(rng.choice(filler, 40)) | ({f"bad{rng.integers(3)}"} if bad else set())
    pos, unl = [draw(True) for _ in range(200)], [draw(i % 10 == 0) for i in range(1000)]
    words, weights, bias = toxicity.fit_member(pos, unl, 0.1)
    assert {"bad0", "bad1", "bad2"} <= set(words)
    f = lambda s: bias + sum(w for x, w in zip(words, weights) if x in s)
    assert np.mean([f(draw(True)) > 0.85 for _ in range(200)]) > 0.95
    assert np.mean([f(draw(False)) < 0 for _ in range(200)]) > 0.95


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "fine words"), (3, "fine words")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0.0] * 4
    odd = spark.createDataFrame([(None, 1), (3, None), (3, 1), (3, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, odd, members=1)).orderBy("doc_id").collect()
    assert len(got) == 4 and got[0].score == got[1].score and got[2].score == got[3].score
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = op1_nnpu_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    agree = (got.predicted == got.toxic).mean()
    assert agree > 0.97, agree
    assert got.predicted[got.toxic == 1].mean() >= 0.8 and got.predicted[got.toxic == 0].mean() <= 0.005


def test_all_unlabelled_rows_train_in_shards(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(900):
        bad = i % 9 == 0
        rows.append((i, " ".join([f"w{j}" for j in rng.integers(0, 200, 30)] + ["vile"] * bad), "clash"))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (None, "a row without an id", "x"), (5, rows[5][1], "a repeated row"), (901, "long " * 50_000, "x")], "doc_id long, text string, score string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    weights, bias = toxicity.fit(docs, known, shard=150)
    assert set(weights) == {"vile"} and len(bias) == 1
    got = toxicity.score(docs, (weights, bias)).collect()
    assert len(got) == 903
    assert all((r.score >= 0.7) == (r.doc_id is not None and r.doc_id < 900 and r.doc_id % 9 == 0) for r in got)
    assert toxicity.accepted(docs, (weights, bias)).columns == docs.columns
    patterns = {r.doc_id: list(r.pattern) for r in toxicity._patterns(docs, ["vile", "w1"]).collect() if r.doc_id == 9}
    assert patterns[9][0] == 0


def test_scores_and_risk_against_plain_sums(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{j}" for j in rng.integers(0, 40, 15)) + " vile" * (i % 7 == 0) for i in range(400)] + ["", None, "VILE, w1! w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(0, 400, 2)], "doc_id long, toxic int")
    weights, bias = toxicity.fit(docs, known)
    for r in toxicity.score(docs, (weights, bias)).collect():
        f = bias[0] + sum(w[0] for x, w in weights.items() if x in toxicity.words_in(texts[r.doc_id]))
        assert abs(r.score - 1 / (1 + np.exp(-f))) < 1e-8
    # Where the descent ends, no small step lowers the risk.
    xp, xu = (rng.random((n, 3)) < p for n, p in ((60, [0.5, 0.3, 0.5]), (300, [0.3, 0.2, 0.5])))
    xp, xu, prior = xp.astype(np.float32), xu.astype(np.float32), 0.15
    theta = toxicity.descend(xp, np.ones(60), xu, np.ones(300), prior, 4000)

    def risk(t):
        fp, fu = xp @ t[:-1] + t[-1], xu @ t[:-1] + t[-1]
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        return prior * np.logaddexp(0, -fp).mean() + max(negative, 0.0) + 0.5e-4 * prior * (t[:-1] ** 2).sum()

    for i in range(4):
        for step in (-0.2, 0.2):
            assert risk(theta + step * np.eye(4)[i]) > risk(theta) - 1e-6
