"""TIFF media columns: writing 8-bit pages, and reading any of the common encodings, one row per page.

The reader walks the chain of image directories in either byte order, decodes uncompressed, PackBits, LZW and
deflate strips or tiles, undoes horizontal differencing and the floating-point predictor, and returns each page's samples row by row. The writer
uses the same four encodings; ``store`` picks one by the payload's checksum, so that equal payloads give equal
files and every decoder works on a share of the table.

Defined results: a null payload is an empty one; repeated rows give equal files; bytes that aren't a TIFF, loop
in their directories or end early give one row with page -1 and the reason in ``error``; an empty table gives
no rows; only the named columns are read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: tag numbers and compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}

UNIT = 576


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more become two bytes, all else goes in literals of up to 128."""
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return b""
    edges = np.flatnonzero(np.diff(x)) + 1
    starts = np.concatenate([[0], edges])
    lengths = np.diff(np.concatenate([starts, [len(x)]]))
    out, literal = bytearray(), 0

    def flush(end: int) -> None:
        nonlocal literal
        while literal < end:
            n = min(128, end - literal)
            out.append(n - 1)
            out.extend(data[literal : literal + n])
            literal += n

    for k in np.flatnonzero(lengths >= 3):
        at, n = int(starts[k]), int(lengths[k])
        flush(at)
        while n > 1:
            m = min(128, n)
            out.extend((257 - m, data[at]))
            at, n = at + m, n - m
        literal = at
    flush(len(x))
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        c = data[i]
        if c < 128:
            out.append(data[i + 1 : i + 2 + c])
            i += 2 + c
        elif c > 128:
            out.append(data[i + 1 : i + 2] * (257 - c))
            i += 2
        else:
            i += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first, widths from 9 to 12, one code early, as the format asks."""
    fresh = {bytes((i,)): i for i in range(256)}
    table, nxt, width, out, bits, held = dict(fresh), 258, 9, bytearray(), 9, 256
    prefix = b""
    for i in range(len(data)):
        c = data[i : i + 1]
        longer = prefix + c
        if longer in table:
            prefix = longer
            continue
        held, bits = held << width | table[prefix], bits + width
        table[longer] = nxt
        nxt += 1
        if nxt > (1 << width) - 1:
            width += 1
        if nxt > 4093:
            held, bits = held << min(width, 12) | 256, bits + min(width, 12)
            table, nxt, width = dict(fresh), 258, 9
        if bits > 4096:
            spare = bits & 7
            out += (held >> spare).to_bytes(bits >> 3, "big")
            held, bits = held & ((1 << spare) - 1), spare
        prefix = c
    if prefix:
        held, bits = held << width | table[prefix], bits + width
        nxt += 1
        if nxt > (1 << width) - 1 and width < 12:
            width += 1
    held, bits = held << width | 257, bits + width
    spare = -bits % 8
    return bytes(out) + (held << spare).to_bytes((bits + spare) >> 3, "big")


def lzw_decode(data: bytes) -> bytes:
    fresh = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, out, last = list(fresh), 9, [], None
    held = bits = at = 0
    while True:
        if bits < width:
            more = data[at : at + 6]
            if not more:
                break
            held, bits, at = held << 8 * len(more) | int.from_bytes(more, "big"), bits + 8 * len(more), at + 6
            if bits < width:
                break
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(fresh), 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(entry)
        last = entry
    return b"".join(out)


def _pack(data: bytes, compression: int) -> bytes:
    if compression == LZW:
        return lzw_encode(data)
    if compression == PACKBITS:
        return pack_bits(data)
    return zlib.compress(data, 1) if compression in (DEFLATE, OLD_DEFLATE) else data


def _unpack(data: bytes, compression: int) -> bytes:
    if compression == LZW:
        return lzw_decode(data)
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if compression == NONE:
        return data
    raise ValueError(f"compression {compression}")


def write_pages(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, rows: int = 64, order: str = "<") -> bytes:
    """A file of 8-bit pages of shape (height, width) or (height, width, samples); tile: (height, width)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        page = page[:, :, None] if page.ndim == 2 else page
        h, w, s = page.shape
        th, tw = tile or (min(rows, h), w)
        blocks = []
        for y in range(0, h, th):
            for x in range(0, w, tw):
                part = page[y : y + th, x : x + tw]
                if tile and part.shape[:2] != (th, tw):
                    part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
                blocks.append(_pack(np.ascontiguousarray(part).tobytes(), compression))
        offsets = []
        for b in blocks:
            offsets.append(len(out))
            out += b
        sizes = [len(b) for b in blocks]
        tags: dict[int, tuple[int, list[int]]] = {WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [8] * s), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [1 if s < 3 else 2]), SAMPLES: (3, [s]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        tags |= {TILE_WIDTH: (4, [tw]), TILE_HEIGHT: (4, [th]), TILE_OFFSETS: (4, offsets), TILE_BYTES: (4, sizes)} if tile else {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [th]), STRIP_BYTES: (4, sizes)}
        fields = b""
        for tag in sorted(tags):
            kind, values = tags[tag]
            packed = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(packed) > 4:
                out += bytes(len(out) & 1)
                place = struct.pack(order + "I", len(out))
                out += packed
            else:
                place = packed.ljust(4, b"\0")
            fields += struct.pack(order + "HHI", tag, kind, len(values)) + place
        out += bytes(len(out) & 1)
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(tags)) + fields
        link = len(out)
        out += bytes(4)
    return bytes(out)


def directories(data: bytes):
    """(byte order, tag -> values) of each image directory in turn."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen:
            raise ValueError("directories in a loop")
        seen.add(at)
        tags: dict[int, list] = {}
        count = struct.unpack_from(order + "H", data, at)[0]
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            size = TYPE_SIZES.get(kind, 1) * n
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            form = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}.get(kind)
            if form:
                tags[tag] = list(struct.unpack_from(f"{order}{n}{form}", data, place))
        yield order, tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def unplaned(raw: bytes, rows: int, width: int, depth: int, size: int) -> bytes:
    """Undoes the floating-point predictor: each row holds its samples' first bytes, then their second ones and so on,
    most significant first, as differences of bytes ``depth`` apart. Gives big-endian samples."""
    x = np.frombuffer(raw, np.uint8, rows * width * depth * size).reshape(rows, size * width, depth)
    x = np.cumsum(x, axis=1, dtype=np.uint8).reshape(rows, size, width * depth)
    return np.ascontiguousarray(x.transpose(0, 2, 1)).tobytes()


def read_page(data: bytes, order: str, tags: dict[int, list]) -> np.ndarray:
    """Samples of shape (height, width, samples per pixel)."""
    one = lambda tag, default: tags.get(tag, [default])[0]
    w, h, s, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1)
    floats = one(SAMPLE_FORMAT, 1) == 3
    if bits not in ((16, 32, 64) if floats else (8, 16, 32)):
        raise ValueError(f"{bits} bits")
    kind = np.dtype(f"{order}{'f' if floats else 'u'}{bits // 8}")
    tiled = TILE_OFFSETS in tags
    th, tw = (one(TILE_HEIGHT, h), one(TILE_WIDTH, w)) if tiled else (min(one(ROWS_PER_STRIP, h), h), w)
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    planes = s if one(PLANAR, 1) == 2 else 1
    depth = 1 if planes > 1 else s
    out = np.zeros((h, w, s), kind.newbyteorder("="))
    across, down = -(-w // tw), -(-h // th)
    for k in range(planes * across * down):
        plane, rest = divmod(k, across * down)
        y, x = rest // across * th, rest % across * tw
        rows = th if tiled else min(th, h - y)
        raw = _unpack(data[offsets[k] : offsets[k] + sizes[k]], one(COMPRESSION, 1))
        if one(PREDICTOR, 1) == 3:
            raw, kind = unplaned(raw, rows, tw, depth, bits // 8), kind.newbyteorder(">")
        part = np.frombuffer(raw, kind, rows * tw * depth).reshape(rows, tw, depth).astype(out.dtype)
        if one(PREDICTOR, 1) == 2 and not floats:
            part = np.cumsum(part, axis=1, dtype=out.dtype)
        elif one(PREDICTOR, 1) == 3 and floats:
            pass
        elif one(PREDICTOR, 1) != 1:
            raise ValueError(f"predictor {one(PREDICTOR, 1)}")
        part = part[: h - y, : w - x]
        to = slice(plane, plane + 1) if planes > 1 else slice(None)
        out[y : y + part.shape[0], x : x + part.shape[1], to] = part
    return out


def features(page: np.ndarray) -> str:
    """Size, mean, deviation, entropy and a 64-bit block-mean hash of a page's samples; floats are first scaled to bytes."""
    flat = page.reshape(-1)
    if flat.dtype.kind == "f":
        flat = np.nan_to_num(flat.astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0)
        flat = (flat - flat.min(initial=0)) / max(np.ptp(flat) if len(flat) else 0.0, 1e-300) * 255
        flat = np.clip(flat, 0, 255)
    flat = flat.astype(np.uint8)
    if not len(flat):
        return "0x0"
    counts = np.bincount(flat, minlength=256)
    level = np.arange(256.0)
    mean = float(counts @ level) / len(flat)
    spread = np.sqrt(max(0.0, float(counts @ (level * level)) / len(flat) - mean * mean))
    p = counts[counts > 0] / len(flat)
    cut = flat[: len(flat) // 64 * 64].reshape(64, -1).mean(axis=1) if len(flat) >= 64 else np.zeros(64)
    bits = int.from_bytes(np.packbits(cut > cut.mean()).tobytes(), "big")
    return f"{page.shape[1]}x{page.shape[0]};mean={mean:.4f};std={spread:.4f};entropy={-float(p @ np.log2(p)):.4f};hash={bits:016x}"


def store(text: str | None) -> tuple[int, bytes]:
    """(unpadded bytes, file): the text's bytes and padding as one page of 576 samples a row."""
    raw = (text or "").encode()
    padded = raw + b"\xff" * (UNIT - len(raw) % UNIT if len(raw) % UNIT or not raw else 0)
    page = np.frombuffer(padded, np.uint8).reshape(-1, UNIT)
    way = zlib.crc32(padded) % 8
    if way == 0:
        return len(raw), write_pages([page], LZW, rows=256)
    if way in (1, 2):
        return len(raw), write_pages([page], PACKBITS, rows=256)
    if way == 3:
        return len(raw), write_pages([page], DEFLATE, predictor=2, tile=(64, 192), order=">")
    return len(raw), write_pages([page], DEFLATE, predictor=2 if way == 4 else 1, rows=256)


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a TIFF file."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [store(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


PAGE = "page int, width int, height int, samples_per_pixel int, compression int, samples binary, feature string, error string"


def read_pages(files: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and one row per page of each file; 16-bit samples are little-endian."""
    names = [x.split()[0] for x in PAGE.split(", ")]
    source = files.select(*keep, F.col(media).alias("_media"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_media"), PAGE])

    def pages(data: bytes | None):
        k = -1
        try:
            for k, (order, tags) in enumerate(directories(data or b"")):
                page = read_page(data, order, tags)
                yield k, page.shape[1], page.shape[0], page.shape[2], tags.get(COMPRESSION, [1])[0], page.tobytes(), features(page), None
        except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
            yield -1, None, None, None, None, None, None, f"{type(e).__name__}: {e}"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows, of = [], []
                for i, m in enumerate(part.column(part.num_columns - 1)):
                    for row in pages(m.as_py()):
                        rows.append(row)
                        of.append(i)
                take = pa.array(of, pa.int32())
                kept = [c.take(take) for c in part.columns[:-1]]
                made = [pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int32()] * 5, pa.binary(), pa.string(), pa.string()))] if rows else []
                if rows:
                    yield pa.RecordBatch.from_arrays([*kept, *made], names=[*keep, *names])

    return source.mapInArrow(run, schema)
