"""Document fingerprints by order MinHash.

A text's k-mers of code points are numbered by occurrence, so that the third "abcde" is another item than the first.  Each of
``sketches`` random orders picks the ``tuple_size`` lowest items; these are put back into text order and the k-mers' hashes
are hashed as one tuple.  Two texts agree in a sketch only if the same items are lowest in both and stand in the same order,
so that moving passages lowers the likeness, as edit distance does, where plain MinHash would not see it.

Neighbours in the order of ids are compared without a window over all rows: texts are range-partitioned by sampled, size-weighted
splitters and sorted in their ranges, and the first row of each range goes also to the end of the range before it.  That is one
shuffle of the texts; a task streams its range.

Edge cases: null and empty texts have no k-mer and the fingerprint of zeros, a text shorter than k is one k-mer of its own, and
one with fewer items than ``tuple_size`` has tuples of what there is; rows without an id come after all others, and rows of one
id are ordered by a hash of their text; a single row is its own neighbour; repeated rows are neighbours of each other; an empty
table gives an empty one; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recloom.llm.sharding import quantiles, weighted_sample
from recloom.llm.store import Scratch

K, TUPLE_SIZE, SKETCHES = 5, 2, 64
#: Bytes of text in a range, ranges at most, and sampled keys per range.
RANGE_BYTES, MOST_RANGES, PER_RANGE = 32 << 20, 100_000, 20
#: Positions that are ordered at a time, so that all orders of them fit a core's cache.
STRIP = 4096
_LOW = -(1 << 63)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWER = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint32(0xFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _A
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


def kmers(text: str, k: int) -> np.ndarray:
    """A 64-bit hash of the k-mer at each position; of the whole text if it is shorter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = max(len(points) - k + 1, min(len(points), 1))
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(points))):
        out *= _POWER
        out += points[i : i + n]
    return mixed(out)


def items(hashes: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each k-mer with its occurrence number, from 0 in text order."""
    n = len(hashes)
    bits = np.uint64(n.bit_length())
    at = np.sort((hashes >> bits << bits) | np.arange(n, dtype=np.uint64))  # by k-mer, then position
    place = (at & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    same, index = at >> bits, np.arange(n)
    first = np.concatenate(([True], same[1:] != same[:-1]))
    occurrence = index - np.maximum.accumulate(np.where(first, index, 0))
    out = np.empty(n, np.uint32)
    out[place] = (mixed(hashes[place] + occurrence.astype(np.uint64) * _POWER) >> np.uint64(32)).astype(np.uint32)
    return out


def multipliers(sketches: int) -> np.ndarray:
    """Odd factors: multiplied by each, 32-bit items come in an order of their own."""
    return (mixed(np.arange(1, sketches + 1, dtype=np.uint64) * _POWER) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def sketch(text: str | None, k: int = K, tuple_size: int = TUPLE_SIZE, sketches: int = SKETCHES) -> np.ndarray:
    """One 32-bit tuple hash per order; never 0 but for a text without k-mers."""
    if not text:
        return np.zeros(sketches, np.uint32)
    hashes = kmers(text, k)
    x, a, rows = items(hashes), multipliers(sketches)[:, None], np.arange(sketches)
    size = min(tuple_size, len(x))
    values, places = [], []
    for start in range(0, len(x), STRIP):
        y = x[None, start : start + STRIP] * a
        for _ in range(min(size, y.shape[1])):
            low = y.argmin(1)
            values.append(y[rows, low])
            places.append(low + start)
            y[rows, low] = _NONE
    values, places = np.stack(values, 1), np.stack(places, 1)
    if places.shape[1] > size:
        low = np.argsort(values, 1, kind="stable")[:, :size]  # of equal values the first in the text
        places = np.take_along_axis(places, low, 1)
    places.sort(1)
    out = rows.astype(np.uint64)
    for i in range(size):
        out = mixed(out * _POWER + hashes[places[:, i]])
    return (out >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of orders in which two fingerprints agree."""
    return float((a == b).mean())


def as_text(sketched: np.ndarray) -> str:
    return sketched.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half of ``text`` (rounded down) replaced by as many code points from the start of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def keyed(docs: DataFrame) -> DataFrame:
    """``h`` (the id; rows without one come last in descending order), ``doc_id`` (the text's hash, which orders rows of one
    id) and ``size``: the names by which the sharding module draws splitters."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(_LOW)).alias("h"), F.xxhash64(text).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"))


def placed(docs: DataFrame, splitters: list[tuple[int, int]], before: dict[tuple[int, int], int]) -> DataFrame:
    """``range``, ``halo``, ``id``, ``hash``, ``text``; a row that is in ``before`` also as the halo of the range named there."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    cuts = np.array(splitters, dtype=[("a", np.int64), ("b", np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = np.empty(b.num_rows, cuts.dtype)
            key["a"] = b.column("id").cast(pa.int64()).fill_null(_LOW).to_numpy(zero_copy_only=False)
            key["b"] = b.column("hash").to_numpy(zero_copy_only=False)
            at = np.searchsorted(cuts, key, "right").astype(np.int32)
            head = [(i, before[k]) for i, k in enumerate(zip(key["a"].tolist(), key["b"].tolist(), strict=True)) if k in before]
            for rows, to, halo in ((np.arange(b.num_rows), at, False), (np.array([i for i, _ in head], np.int64), np.array([r for _, r in head], np.int32), True)):
                if len(rows):
                    some = b if len(rows) == b.num_rows and not halo else b.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([halo] * len(rows)), some.column("id").cast(pa.int64()), some.column("hash"), some.column("text").cast(pa.string())], names=["range", "halo", "id", "hash", "text"])

    return rows.mapInArrow(run, "range int, halo boolean, id long, hash long, text string")


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
OUT_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(k: int, tuple_size: int, sketches: int):
    """Streams sorted ranges: each row is told from the one after it, the last from the range's halo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # range, id, text, fingerprint
        out: list[dict] = []
        for b in batches:
            columns = [b.column(c) for c in ("range", "halo", "id", "text")]
            for at in range(0, b.num_rows, 256):
                for own, halo, key, text in zip(*(c.slice(at, 256).to_pylist() for c in columns), strict=True):
                    if halo and (last is None or last[0] != own):
                        continue  # the halo repeats where its row does
                    print_ = sketch(text, k, tuple_size, sketches)
                    if last is not None and last[0] == own:
                        changed = edited(last[2], text)
                        new = sketch(changed, k, tuple_size, sketches)
                        out.append({"doc_id": last[1], "n_chars": len(last[2]), "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(), "fingerprint": as_text(last[3]), "edited_fingerprint": as_text(new), "near_edited": likeness(last[3], new), "near_next": likeness(last[3], print_)})
                    last = None if halo else (own, key, text, print_)
                if out:
                    yield pa.RecordBatch.from_pylist(out, OUT)
                    out = []

    return run


def fingerprints(spark: SparkSession, docs: DataFrame, k: int = K, tuple_size: int = TUPLE_SIZE, sketches: int = SKETCHES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per row of ``docs`` its fingerprint, that of its text edited with the next row's in descending order of ids (after the
    last comes the first), and the likeness to either: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``."""
    keys = Scratch(spark, "fingerprints").save(keyed(docs), "keys")
    total, count = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    parts = min(MOST_RANGES, max(-(-total // range_bytes), 4 * spark.sparkContext.defaultParallelism))
    sample = weighted_sample(keys, PER_RANGE * parts, count, total)
    splitters = quantiles(sample, parts)
    # a range's first row in descending order goes to the end of the range above it, the topmost one's to the lowest
    heads = ranged_heads(keys, splitters)
    order = sorted(heads)
    before = {heads[r]: order[(i + 1) % len(order)] for i, r in enumerate(order)}
    rows = placed(docs, splitters, before).repartitionById(len(splitters) + 1, F.col("range"))
    rows = rows.sortWithinPartitions("range", "halo", F.col("id").desc_nulls_last(), F.col("hash").desc())
    return rows.select("range", "halo", "id", "text").mapInArrow(compared(k, tuple_size, sketches), OUT_SQL)


def ranged_heads(keys: DataFrame, splitters: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """The highest key of each range that has rows: one entry per range."""
    cuts = np.array(splitters, dtype=[("a", np.int64), ("b", np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, int]] = {}
        for b in batches:
            key = np.empty(b.num_rows, cuts.dtype)
            key["a"] = b.column("h").to_numpy(zero_copy_only=False)
            key["b"] = b.column("doc_id").to_numpy(zero_copy_only=False)
            key.sort()
            at = np.searchsorted(cuts, key, "right")
            for i in np.flatnonzero(np.concatenate((at[1:] != at[:-1], [True]))[: len(at)]):
                best[int(at[i])] = max(best.get(int(at[i]), (_LOW, _LOW)), (int(key["a"][i]), int(key["b"][i])))
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array([v[0] for v in best.values()], pa.int64()), pa.array([v[1] for v in best.values()], pa.int64())], names=["range", "a", "b"])

    rows = keys.select("h", "doc_id").mapInArrow(run, "range int, a long, b long").groupBy("range").agg(F.max(F.struct("a", "b")).alias("top"))
    return {r["range"]: (r["top"]["a"], r["top"]["b"]) for r in rows.collect()}
