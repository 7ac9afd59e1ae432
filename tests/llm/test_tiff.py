import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import tiff
from barloom.llm.queries import op2_tiff_pages


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 40))
def test_codecs(data, times):
    data = data * times
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_lzw_known_stream():
    # The example of the format's specification: 7 7 7 8 8 7 7 6 6 -> 256 7 258 8 8 258 6 6 257.
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    stream = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(stream) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == stream


@pytest.mark.parametrize("compression", [1, 5, 8, 32946, 32773])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_pages(compression, predictor, tile, order):
    rng = np.random.default_rng(0)
    pages = [rng.integers(0, 5, s).astype(np.uint8) for s in [(70, 50), (1, 1), (33, 40, 3)]]
    data = tiff.write_pages(pages, compression, predictor, tile, rows=16, order=order)
    got = [tiff.read_page(data, *d) for d in tiff.directories(data)]
    assert len(got) == 3
    for a, b in zip(pages, got):
        assert np.array_equal(a.reshape(b.shape), b)


def test_rows(spark):
    two = tiff.write_pages([np.zeros((2, 3), np.uint8), np.ones((4, 5), np.uint8)])
    loop = bytearray(tiff.write_pages([np.zeros((2, 3), np.uint8)]))
    loop[-4:] = loop[4:8]
    files = spark.createDataFrame([(1, bytearray(two), "x"), (2, bytearray(b"junk"), "x"), (3, None, "x"), (4, loop, "x"), (5, bytearray(two[:90]), "x")], "doc_id long, media binary, page string")
    got = sorted((r.doc_id, r.page, r.width, r.error is None) for r in tiff.read_pages(files).collect())
    assert got[:2] == [(1, 0, 3, True), (1, 1, 5, True)]
    assert {g[0] for g in got if not g[3]} == {2, 3, 4, 5}
    assert tiff.read_pages(files.limit(0)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op2_tiff_pages(spark, d).collect()
    assert {r.doc_id for r in rows} == docs.keys() and len(rows) == len(docs)
    for r in rows:
        raw = docs[r.doc_id].encode()
        padded = raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-32:])
        n, media = tiff.store(docs[r.doc_id])
        assert r.media_sha256 == hashlib.sha256(media).hexdigest() and r.media_bytes == len(media)
    assert tiff.store(None)[0] == 0


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind", ["f2", "f4", "f8"])
@pytest.mark.parametrize("depth", [1, 3])
def test_floating_point_predictor(order, kind, depth):
    """Rows built by hand: bytes of the samples in planes, most significant first, then differences ``depth`` bytes apart."""
    rng, (h, w) = np.random.default_rng(1), (5, 7)
    page = rng.normal(size=(h, w, depth)).astype(kind)
    size, raw = page.dtype.itemsize, b""
    for row in page:
        big = row.reshape(-1).astype(">" + kind).tobytes()
        planes = b"".join(big[k::size] for k in range(size))
        raw += bytes((planes[i] - (planes[i - depth] if i >= depth else 0)) % 256 for i in range(len(planes)))
    tags = {tiff.WIDTH: [w], tiff.HEIGHT: [h], tiff.BITS: [8 * size] * depth, tiff.SAMPLES: [depth], tiff.COMPRESSION: [8], tiff.PREDICTOR: [3], tiff.SAMPLE_FORMAT: [3] * depth, tiff.STRIP_OFFSETS: [0], tiff.ROWS_PER_STRIP: [h]}
    data = zlib.compress(raw)
    got = tiff.read_page(data, order, tags | {tiff.STRIP_BYTES: [len(data)]})
    assert np.array_equal(got, page) and tiff.features(got).startswith(f"{w}x{h};mean=")
