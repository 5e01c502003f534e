"""Byte-level BPE encoding and decoding by a sentencepiece model that is made from a rank file, without training.

The model proto is written field by field: one piece per rank, its bytes mapped to printable characters (sentencepiece
holds text, not bytes), scored by its negative rank, so that the merge with the highest score is the one of lowest rank;
identity normalisation, no dummy prefix, no white space rules.  Texts are cut by the pattern into pre-tokens, each encoded
by itself; ids are decoded by the inverse map.

Edge cases: null and empty texts have no ids; what a pattern doesn't match is left out; repeated rows repeat; an empty table gives an empty one; extra columns are
left out.  A text that is one very long word is one pre-token and is encoded whole.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recloom.llm.pretokens import PATTERN, Chunks


@lru_cache(1)
def byte_chars() -> list[str]:
    """A printable character for each byte: itself where it prints in Latin-1, else one from U+0100 on, in byte order."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _bytes_field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    """Pieces in order of rank, from lines of base64 and rank."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                piece, rank = line.split()
                ranks[int(rank)] = base64.b64decode(piece)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks are not gapless")
    return [ranks[i] for i in range(len(ranks))]


def model_proto(pieces: list[bytes]) -> bytes:
    """A serialised sentencepiece model: ids are ranks, and one unknown piece follows them."""
    to = byte_chars()
    out = [_bytes_field(1, _bytes_field(1, "".join(to[b] for b in p).encode()) + b"\x15" + struct.pack("<f", -float(i)) + _int_field(3, 1)) for i, p in enumerate(pieces)]
    out.append(_bytes_field(1, _bytes_field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _int_field(3, 2)))
    trainer = _int_field(3, 2) + _int_field(4, len(pieces) + 1) + _int_field(40, len(pieces))  # BPE; size; id of unknown
    trainer += b"".join(_int_field(k, (1 << 64) - 1) for k in (41, 42, 43))  # no begin, end or padding piece
    normalizer = _bytes_field(1, b"identity") + _int_field(3, 0) + _int_field(4, 0) + _int_field(5, 0)
    return b"".join(out) + _bytes_field(2, trainer) + _bytes_field(3, normalizer)


class Codec:
    def __init__(self, rank_path: str, pattern: str):
        import regex
        import sentencepiece

        self.pieces = read_ranks(rank_path)
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(model_proto(self.pieces))
        own = regex.compile(pattern)
        self.find = (lambda text: [m.group() for m in own.finditer(text)]) if own.groups else own.findall
        chars = byte_chars()
        self.plain = {b: ord(c) for b, c in enumerate(chars)}
        self.chunks = Chunks(self._many, 300_000) if pattern == PATTERN else None
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            ids = np.array(self.model.EncodeAsIds(piece.encode().decode("latin-1").translate(self.plain)), "<u4").tobytes()
            if len(self.known) >= 100_000:
                self.known.clear()
            if len(piece) < 64:
                self.known[piece] = ids
        return ids

    def _many(self, texts: list[str]) -> list[bytes]:
        return [b"".join(map(self._piece, self.find(t))) for t in texts]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        texts = [t or "" for t in texts]
        return self._many(texts) if self.chunks is None else list(self.chunks.encode(texts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def codec(rank_path: str, pattern: str) -> Codec:
    """One per process and vocabulary: Python workers are used again by later tasks."""
    return Codec(rank_path, pattern)


def encode_table(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = own.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]))


def decode_table(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Adds ``decoded`` (binary) to a table with ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([own.decode(x or b"") for x in part.column("ids").to_pylist()], pa.binary())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Digests per document of its ids and of the bytes decoded from them."""
    t = decode_table(encode_table(docs, rank_path, pattern), rank_path, pattern)
    return t.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
