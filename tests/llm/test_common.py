import pyarrow as pa

from barloom.llm import _common
from pyspark.sql import functions as F


def test_slices_keep_rows_in_order_and_bounds():
    texts = [None, "", "a" * 10, "b" * 500, "c", "d" * 90, "e" * 20, None, "f"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], names=["i", "t"])
    parts = list(_common.slices([batch, batch.slice(0, 0)], 1, rows=3, size=100))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(9))
    assert all(p.num_rows <= 3 for p in parts)
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 100 for p in parts)


def test_attach_by_broadcast_and_by_salt(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else (None if i % 2 else f"k{i}")) for i in range(300)], "doc_id long, key string")
    found = spark.createDataFrame([("hot", [1, 2]), ("k3", [3])], "key string, v array<int>")
    want = {(r.doc_id, tuple(r.v or ())) for r in rows.join(found, "key", "left").collect()}
    for limit in (1 << 20, -1):
        monkeypatch.setattr(_common, "BROADCAST_BYTES", limit)
        got = _common.attach(rows, found, "key", F.col("doc_id"))
        assert sorted(got.columns) == ["doc_id", "key", "v"]
        assert {(r.doc_id, tuple(r.v or ())) for r in got.collect()} == want and got.count() == 300


def test_attach_shuffled_broadcasts_hot_keys_only(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else (None if i % 2 else f"k{i}")) for i in range(300)], "doc_id long, key string")
    found = spark.createDataFrame([("hot", [1, 2])] + [(f"k{i}", [i]) for i in range(0, 300, 3)], "key string, v array<int>")
    want = {(r.doc_id, tuple(r.v or ())) for r in rows.join(found, "key", "left").collect()}
    sent, attach = [], _common.attach
    monkeypatch.setattr(_common, "attach", lambda rows, found, *a: (sent.append([r.key for r in found.collect()]), attach(rows, found, *a))[1])
    for share, size in ((100, 1), (2, 1), (4096, 51)):  # keys of more than 3, more than 150 and more than 0 rows
        monkeypatch.setattr(_common, "HOT_SHARE", share)
        got = _common.attach_shuffled(rows, found, "key", F.col("doc_id"))
        assert sorted(got.columns) == ["doc_id", "key", "v"]
        assert {(r.doc_id, tuple(r.v or ())) for r in got.collect()} == want and got.count() == 300
        assert len(sent[-1]) == size
