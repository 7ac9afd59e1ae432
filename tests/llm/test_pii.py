import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import _common, pii
from barloom.llm.queries import op6_weak_supervision

FIXED = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile("[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile("\\+[0-9][\x20().0-9-]+[0-9]"),
}


def good(kind, v):
    d = [int(c) for c in v if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
    return 10 <= len(d) <= 15 if kind == "phone" else True


def brute(text):
    found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(FIXED.items()) for m in p.finditer(text or "") if good(k, m[0])]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


TEXTS = [
    None, "", "no data", "a@b.c_d@e.f x@y z@@q.r %@a-.b..c me.x+1@mail-7.example.com.", "\U0001f600é 1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 12 3 1", "+1 (974) 555-3436 +49 30 12 +123456789012345678 +1.2.3.4.5.6.7.8.9.10 +",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and ' + "x" * 30, "9" * 30_000, "a." * 20_000 + "@", "a@b." + "c." * 9000, "+1" * 5000, "1 " * 8000,
]


def test_base_spans(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*TEXTS, *TEXTS])], "doc_id long, text string, kind string")
    for r in pii.examine(docs).collect():
        assert [f"{s.kind}:{s.start}:{s.stop}" for s in r.spans if s.base] == brute(([*TEXTS, *TEXTS])[r.doc_id])


def test_secrets_and_redaction(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'say token = "{key[i:]}{key[:i]}" now' for i in range(20)] + ["plain " + "word" * 8, "mail a.b@c.org or 10.0.0.1", "é +1 (974) 555-3436 x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("_cuts", F.lit(1))
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[0].text == 'say token = "<SECRET>" now' and got[20].text == texts[20] and got[0]._cuts == 1
    assert got[21].text == "mail <EMAIL> or <IP>" and got[22].text == "é <PHONE> x"


def test_reliabilities():
    import random

    r = random.Random(0)
    true_sens, seen = [0.9, 0.7, 0.8, 0.6, 0.95], {}
    for _ in range(20_000):
        y = r.random() < 0.4
        votes = tuple(int(y if r.random() < s else not y) if r.random() < 0.8 else None for s in true_sens)
        seen[votes] = seen.get(votes, 0) + 1
    prior, sens, spec, _ = pii.reliabilities(list(seen.items()))
    assert abs(prior - 0.4) < 0.05
    assert all(abs(a - b) < 0.05 for a, b in zip(sens, true_sens)) and all(abs(a - b) < 0.05 for a, b in zip(spec, true_sens))


def mixed_base(**seen):
    out = 0
    for name, values in pii.FEATURES.items():
        out = out * values + seen.get(name, 0)
    return out


def test_features_of_span_and_context(spark):
    rows = [("email", "A.b@c.org", "Mail: "), ("secret", "0" * 20 + "aB3", "key='"), ("phone", "+49 30 12", ""), ("card", "1 2", "é"), ("ip", "1.2.3.4", "host7(")]
    made = [(str(i), k, 0, len(v), v, before, "") for i, (k, v, before) in enumerate(rows)]
    schema = "text_key string, kind string, start long, stop long, value string, before string, after string"
    got = [r.code for r in pii.judged(spark.createDataFrame(made, schema)).orderBy("text_key").collect()]
    words = [r.h for r in spark.createDataFrame([(w,) for w in ("mail", "key", "é", "host")], "w string").select((1 + F.pmod(F.xxhash64("w"), F.lit(16))).alias("h")).collect()]
    assert got == [
        mixed_base(valid=1, size=3, shape=6, parts=3, variety=1, edge=1, word=words[0]),
        mixed_base(valid=1, size=4, shape=7, variety=0, edge=2, word=words[1]),
        mixed_base(size=3, shape=1, parts=3, variety=1),
        mixed_base(size=1, shape=1, parts=1, variety=0, edge=3, word=words[2]),
        mixed_base(valid=1, size=2, shape=1, parts=3, variety=0, edge=4, word=words[3]),
    ]


def test_classifier_decides_where_labelers_abstain(spark):
    import random

    r, rows = random.Random(1), []
    for i in range(6000):
        y = r.random() < 0.5
        word = r.choice((3, 4, 5) if y else (6, 7, 8)) if r.random() < 0.95 else r.randrange(17)
        silent = i % 3 == 0
        votes = [None if silent or r.random() < 0.3 else int(y if r.random() < 0.8 else not y) for _ in pii.LABELERS]
        rows.append(("secret", *votes, mixed_base(size=r.randrange(6), word=word), y, silent))
    names = ", ".join(f"{x} int" for x in pii.LABELERS)
    votes = spark.createDataFrame(rows, f"kind string, {names}, code int, y boolean, silent boolean").cache()
    weights = pii.fit(votes)
    judged = votes.withColumn("p", pii.probability(weights)).collect()
    silent = [x for x in judged if x.silent]
    # The label model gives all silent candidates one probability: it is right about half of them.
    assert sum((x.p >= 0.5) == x.y for x in silent) > 0.93 * len(silent)
    x = pii.indicators(np.array([x.code for x in judged]))
    assert np.allclose(1 / (1 + np.exp(-x @ weights["secret"])), [x.p for x in judged], atol=1e-12)
    other = spark.createDataFrame([("ip", 0)], "kind string, code int")
    assert other.select(pii.probability(weights)).first()[0] == -1 and other.select(pii.probability({})).first()[0] == -1


def test_classifier_is_at_the_minimum():
    rng = np.random.default_rng(0)
    codes, counts, p = rng.integers(0, pii.CODES, 200), rng.integers(1, 1000, 200).astype(float), rng.random(200)
    w, x = pii.classifier(codes, counts, p), pii.indicators(codes)
    slope = x.T @ (counts * (1 / (1 + np.exp(-x @ w)) - p)) + np.r_[1e-3, np.ones(len(w) - 1)] * w
    assert np.abs(slope).max() < 1e-6


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.examine(docs).count() == 0 and pii.redact(docs).count() == 0


@pytest.mark.parametrize("d", ["/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, d):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op6_weak_supervision(spark, d).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), docs[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in FIXED]
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_spans_of_rare_texts_are_not_broadcast(spark, monkeypatch):
    """What is broadcast stays under HOT_SHARE texts, however many texts have spans."""
    docs = spark.createDataFrame([(i, f"write to name{i}@mail{i}.org" if i % 4 else "call +49 30 1234567 now") for i in range(200)], "doc_id long, text string")
    want = {(r.doc_id, str(r.spans)) for r in pii.examine(docs).collect()}
    monkeypatch.setattr(_common, "HOT_SHARE", 10)
    sent, attach = [], _common.attach
    monkeypatch.setattr(_common, "attach", lambda rows, found, *a: (sent.append(found.count()), attach(rows, found, *a))[1])
    assert {(r.doc_id, str(r.spans)) for r in pii.examine(docs).collect()} == want and len(want) == 200
    assert sent == [1]
