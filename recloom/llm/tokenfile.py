"""Token-ID output: flat unsigned integer files plus 64-bit document offsets, for memory mapping.

Documents are range-partitioned and sorted by id; each partition is encoded and streamed into one file ``NNNNN.bin`` of
16-bit ids (32-bit if the vocabulary asks for it), with ``NNNNN.id`` (document ids) beside it.  The ids written by each
partition are summed up in order on the driver, one number per partition, and a second pass writes ``NNNNN.idx``:
absolute 64-bit offsets, one more than documents.  Files are moved in place whole, so a retried task leaves no half file.

Edge cases: null and empty texts have the end id alone; null ids come first (written as the smallest long); repeated rows
repeat; partitions without rows leave no file; an empty table gives no file; extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recloom.llm.pretokens import Chunks
from recloom.llm.store import open_mapped, put_whole

_NULL = -(1 << 63)


class LibraryEncoder:
    """Whole texts by the tokenizers library.  Chunks that are new to the process are encoded many at a time, in one call
    with line feeds between them, which the pattern never joins to what stands beside them."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values() if t.special]
        self.vocabulary = self.lib.get_vocab_size(with_added_tokens=True)
        feed = self.lib.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        self.chunks = Chunks(self._many) if self._cuts_hold() else None

    def _cuts_hold(self) -> bool:
        """Whether the file's own cuts are those of ``pretokens``: bytes by the usual pattern, nothing done to the text before,
        and no added token but special ones."""
        import json

        own = json.loads(self.lib.to_str())
        cut = own.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        return bool(plain) and own.get("normalizer") is None and all(t["special"] for t in own.get("added_tokens", ()))

    def _one(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _many(self, texts: list[str]) -> list[bytes]:
        single = [self.feed is not None and len(x := t.split(None, 1)) == 1 and t[-1] == x[0][-1] and len(t) - len(x[0]) <= 1 for t in texts]
        joined = [t for t, ok in zip(texts, single, strict=True) if ok]
        out: list[bytes] = []
        for at in range(0, len(joined), 2000):
            some = joined[at : at + 2000]
            ids = np.array(self.lib.encode("\n".join(some), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(ids == self.feed)
            if len(ends) != len(some) - 1:
                out += map(self._one, some)
                continue
            raw, a = ids.tobytes(), 0
            for e in [*ends.tolist(), len(ids)]:
                out.append(raw[4 * a : 4 * e])
                a = e + 1
        got = iter(out)
        return [next(got) if ok else self._one(t) for t, ok in zip(texts, single, strict=True)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """A text that holds a special token's string is left to the library whole, as are all texts of a file whose cuts are
        others."""
        if self.chunks is None:
            yield from map(self._one, texts)
            return
        plain = [t if not any(s in t for s in self.special) else "" for t in texts]
        for t, p, ids in zip(texts, plain, self.chunks.encode(plain), strict=True):
            yield ids if p or not t else self._one(t)


@lru_cache(2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, path: str, end_id: int = 2) -> list[tuple[int, ...]]:
    """Writes the files below ``path`` and returns (file number, documents, ids, ids before, bytes per id) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(tokenizer), TaskContext.get().partitionId()
        width = "<u2" if max(own.vocabulary - 1, end_id) < 1 << 16 else "<u4"
        end = np.array([end_id], width).tobytes()
        ids, lens = [], []

        def stream() -> Iterator[bytes]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    some = b.slice(at, 256)
                    ids.append(some.column("doc_id").cast(pa.int64()).fill_null(_NULL).to_numpy(zero_copy_only=False))
                    for raw in own.encode([t or "" for t in some.column("text").to_pylist()]):
                        lens.append(len(raw) // 4 + 1)
                        yield np.frombuffer(raw, "<u4").astype(width).tobytes() + end

        first = next(batches, None)
        if first is None:
            return
        batches = chain([first], batches)
        put_whole(f"{path}/{part:05d}.bin", stream())
        put_whole(f"{path}/{part:05d}.id", [np.concatenate(ids).astype("<i8").tobytes()])
        put_whole(f"{path}/{part:05d}.len", [np.array(lens, "<i8").tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([len(lens)], pa.int64()), pa.array([sum(lens)], pa.int64()), pa.array([int(width[-1])], pa.int64())], names=["part", "docs", "ids", "width"])

    rows = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    done = sorted(tuple(r) for r in rows.mapInArrow(run, "part long, docs long, ids long, width long").collect())
    base, out = 0, []
    for part, n, ids, width in done:
        out.append((part, n, ids, base, width))
        base += ids

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, before in zip(b.column("part").to_pylist(), b.column("base").to_pylist(), strict=True):
                with open_mapped(f"{path}/{part:05d}.len") as f:
                    lens = np.frombuffer(f.read(), "<i8")
                put_whole(f"{path}/{part:05d}.idx", [(before + np.concatenate(([0], np.cumsum(lens)))).astype("<i8").tobytes()])
            yield b

    if out:
        files(spark, out).mapInArrow(index, "part long, docs long, ids long, base long, width long").count()
    return out


def files(spark: SparkSession, manifest: list[tuple]) -> DataFrame:
    """A row per file, each in a task of its own."""
    return spark.createDataFrame(spark.sparkContext.parallelize(manifest, max(1, len(manifest))), "part long, docs long, ids long, base long, width long")


def read_token_files(spark: SparkSession, manifest: list[tuple], path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` per document, from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, width in zip(b.column("part").to_pylist(), b.column("width").to_pylist(), strict=True):
                with open_mapped(f"{path}/{part:05d}.idx") as f:
                    idx = np.frombuffer(f.read(), "<i8")
                with open_mapped(f"{path}/{part:05d}.id") as f:
                    ids = np.frombuffer(f.read(), "<i8")
                with open_mapped(f"{path}/{part:05d}.bin") as f:
                    for at in range(0, len(ids), 10_000):
                        cut = idx[at : at + 10_001]
                        f.seek(int(cut[0] - idx[0]) * width)
                        flat = np.frombuffer(f.read(int(cut[-1] - cut[0]) * width), f"<u{width}").astype("<u4")
                        rel = cut - cut[0]
                        crc = [zlib.crc32(flat[x:y]) for x, y in zip(rel[:-1], rel[1:], strict=True)]
                        own = ids[at : at + 10_000]
                        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64(), mask=own == _NULL), pa.array(cut[:-1], pa.int64()), pa.array(np.diff(cut), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files(spark, manifest).mapInArrow(run, schema)
