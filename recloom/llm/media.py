"""Media columns: Netpbm and BMP bytes to numpy arrays, area resizing by integral images, NPY tiles, difference hashes.

Every step is a function of one row, so the work is a scan with no shuffle; what an image needs in memory is bounded by
the row itself: sizes that a header declares are held against the bytes that are there before anything is allocated.

Edge cases: null bytes, bytes in no known format, truncated ones, sizes or samples out of range and a side of 0 give null
features and an ``error``; repeated rows give equal features; an empty table an empty one; columns named in ``keep`` pass
through, others are left out.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def encode_pgm(a: np.ndarray) -> bytes:
    h, w = a.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(a, np.uint8).tobytes()


def encode_bmp(a: np.ndarray) -> bytes:
    """8-bit grey BMP: palette of 256 greys, rows from the bottom, padded to 4 bytes."""
    h, w = a.shape
    stride = (w + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, :w] = a[::-1]
    palette = np.zeros((256, 4), np.uint8)
    palette[:, :3] = np.arange(256)[:, None]
    start = 14 + 40 + 1024
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + palette.tobytes() + rows.tobytes()


#: What the decoders raise on bytes that are no image.
BROKEN = (ValueError, IndexError, OverflowError, MemoryError, struct.error)


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, fields = data[:2], 2, []
    while len(fields) < (2 if kind in (b"P1", b"P4") else 3):
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end - at < 10 and data[end : end + 1].isdigit():
            end += 1
        if not data[at:end] or data[end : end + 1].isdigit():
            raise ValueError("Netpbm header")
        fields.append(int(data[at:end]))
        at = end
    w, h, top = (*fields, 1)[:3]
    planes = 3 if kind in (b"P3", b"P6") else 1
    if not 1 <= top <= 65535:
        raise ValueError(f"a largest sample of {top}")
    if w * h * planes > 8 * len(data):
        raise ValueError(f"{w} x {h} pixels in {len(data)} bytes")
    if kind in (b"P2", b"P3"):
        a = np.array([int(x) for x in data[at:].split()[: w * h * planes]])
    elif kind == b"P1":
        a = 1 - np.array([c - 48 for c in data[at:] if c in b"01"][: w * h])
    elif kind == b"P4":
        a = 1 - np.unpackbits(np.frombuffer(data, np.uint8, (w + 7) // 8 * h, at + 1).reshape(h, -1), axis=1)[:, :w]
    else:
        a = np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h * planes, at + 1)
    a = a.reshape((h, w, 3) if planes == 3 else (h, w))
    if top == 255 and a.dtype == np.uint8:
        return a
    if a.size and not 0 <= a.min() <= a.max() <= top:
        raise ValueError(f"samples from {a.min()} to {a.max()}, {top} being the largest allowed")
    return (a.astype(np.int64) * 255 // top).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    start, _, w, h, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing or bits not in (8, 24, 32):
        raise ValueError(f"BMP of {bits} bits, compression {packing}")
    n = bits // 8
    if w < 1 or w * abs(h) * n > len(data):
        raise ValueError(f"{w} x {h} pixels in {len(data)} bytes")
    stride = (w * n + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * n]
    rows = rows[::-1] if h > 0 else rows
    if n > 1:
        return rows.reshape(abs(h), w, n)[:, :, 2::-1]
    at = 14 + struct.unpack_from("<I", data, 14)[0]
    palette = np.frombuffer(data, np.uint8, start - at, at).reshape(-1, 4)[:, 2::-1]
    colours = palette[rows]
    return colours[:, :, 0] if (palette[:, :1] == palette).all() else colours


def decode(data: bytes) -> np.ndarray:
    """uint8 array, height x width or height x width x 3."""
    if data[:2] == b"BM":
        a = _bmp(data)
    elif data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        a = _netpbm(data)
    else:
        raise ValueError("neither Netpbm nor BMP")
    if not a.size:
        raise ValueError("an image without pixels")
    return a


def area_resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell, with the exact share of pixels that a cell's border cuts: the integral image is read by
    linear interpolation at the borders."""
    grey = a.mean(axis=2) if a.ndim == 3 else a
    h, w = grey.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(grey, 0, dtype=np.float64), 1, out=total[1:, 1:])

    def at_edges(t: np.ndarray, n: int, size: int) -> np.ndarray:
        edge = np.arange(n + 1) * size / n
        low = np.minimum(edge.astype(np.int64), size - 1)
        part = (edge - low)[:, None]
        return t[low] * (1 - part) + t[low + 1] * part

    cut = at_edges(at_edges(total, height, h).T, width, w).T
    cells = np.diff(np.diff(cut, axis=0), axis=1)
    return cells / (h * w / (height * width))


def difference_hash(a: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 cells of a 8 x 9 reduction is darker than its right neighbour.  Cells count as
    equal below a thousandth of a grey level, so that rounding decides nothing."""
    small = np.round(area_resize(a, 8, 9), 3)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_bytes(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(a), allow_pickle=False)
    return out.getvalue()


def tiles(a: np.ndarray, side: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row and column number and content of each tile; those at the right and bottom may be smaller."""
    for y in range(0, a.shape[0], side):
        for x in range(0, a.shape[1], side):
            yield y // side, x // side, a[y : y + side, x : x + side]


def payload_to_media(payload: bytes) -> bytes:
    """Bytes as an image of width 64: Netpbm for an even number of rows, BMP for an odd one."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    return encode_pgm(a) if a.shape[0] % 2 == 0 else encode_bmp(a)


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes with zero bytes up to a positive multiple of 64, and their number before."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def store_texts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` to ``doc_id``, ``n_bytes`` and ``media``: the text's bytes as an image file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = [padded(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in rows], pa.int64()), pa.array([payload_to_media(p) for _, p in rows], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


TILE = [T.StructField("tile_y", T.IntegerType()), T.StructField("tile_x", T.IntegerType()), T.StructField("npy", T.BinaryType()), T.StructField("dhash", T.StringType())]
FEATURES = T.StructType([
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("tiles", T.ArrayType(T.StructType(TILE))), T.StructField("error", T.StringType()),
])


def media_features(media: DataFrame, keep: list[str], size: int = 32, side: int = 16) -> DataFrame:
    """``media`` binary to digests of its decoded samples, a difference hash of the whole (``feature``) and ``tiles``: its area
    means on ``size`` x ``size`` cells, cut into NPY tiles of ``side``, each with its own difference hash.  Columns in
    ``keep`` pass through."""

    def one(data: bytes | None) -> tuple:
        try:
            if data is None:
                raise ValueError("no media")
            a = decode(data)
        except BROKEN as e:
            return None, None, None, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), None, None, str(e) or type(e).__name__
        raw = a.tobytes()
        small = np.clip(np.rint(np.round(area_resize(a, size, size), 3)), 0, 255).astype(np.uint8)
        parts = [{"tile_y": y, "tile_x": x, "npy": npy_bytes(t), "dhash": difference_hash(t)} for y, x, t in tiles(small, side)]
        return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(a), parts, None

    tile = pa.struct([("tile_y", pa.int32()), ("tile_x", pa.int32()), ("npy", pa.binary()), ("dhash", pa.string())])
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(tile), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = zip(*[one(x.as_py()) for x in part.column("media")], strict=True)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *(pa.array(x, t) for x, t in zip(rows, types, strict=True))], names=[*keep, *FEATURES.names])

    return media.select(*keep, "media").mapInArrow(run, T.StructType([*(media.schema[k] for k in keep), *FEATURES.fields]))


def media_tiles(media: DataFrame, key: str, side: int = 64) -> DataFrame:
    """One row per tile, at full size, of each decodable image: ``key``, ``tile_y``, ``tile_x``, ``npy`` (NPY bytes), ``dhash``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.binary(), pa.string()]
        for b in batches:
            for k, data in zip(b.column(key), b.column("media"), strict=True):
                try:
                    a = decode(data.as_py() or b"")
                except BROKEN:
                    continue
                rows = [(y, x, npy_bytes(t), difference_hash(t)) for y, x, t in tiles(a, side)]
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(rows), b.schema.field(key).type), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=[key, "tile_y", "tile_x", "npy", "dhash"])

    return media.select(key, "media").mapInArrow(run, T.StructType([media.schema[key], *TILE]))
