"""Ranked lexical search by bit-sliced Bloom signatures.

Index, made without knowing a query: documents of like size (distinct entries, by powers of two) fill blocks of up to
``BLOCK_DOCS``.  A document enters each of its terms once per level of ``LEVELS`` that its count reaches; a block is a matrix
of bits, a row per Bloom position and a column per document, so that a term's documents are the AND of ``HASHES`` rows.
Beside the bits a block has the documents' ids and numbers of terms; each task also leaves counts of documents by term.

Search: bits never miss a term, so the level that they show is at or above the true one.  The weighted sum over an item's
terms of the highest score of a level for a document of that length is an upper bound of its score.

1. The ten documents with the highest bounds per item are scored from their texts; the tenth score is the item's floor.
2. All documents whose bound is over the floor, or equals it with an id that could still win, are scored from their texts.
   Those left out are provably not among the ten.

Items are taken in slices of bounded size, each against all blocks; in a task, bounds are summed for packs of terms.  Pairs of
document and item are joined to the texts by broadcast up to ``BROADCAST_PAIRS``, else by a shuffle.

Edge cases: null and empty texts have no terms, are no part of N and are never returned; an item without terms has no rows;
each row of the benchmark is an item of its own, null and repeated ids included, and each row of the documents a document;
rows of one id may all be ranked, and rows without an id come first among equal scores; empty tables give an empty result;
extra columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recloom.llm.store import Scratch

HASHES, BITS_PER_ENTRY = 3, 8
BLOCK_DOCS, BLOCK_BYTES = 1024, 16 << 20
#: Counts from which on a term is entered once more; the highest level stands for any count up to the document's terms.
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 512, 2048)
#: Terms in a task before their counts are handed on; bytes of items in a slice; terms in a pack; pairs that are broadcast.
VOCABULARY, SLICE_BYTES, PACK, BROADCAST_PAIRS = 300_000, 16 << 20, 2048, 1_000_000
_LOW = -(1 << 63)
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or b >= 97 and b < 123 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Letters and digits of ASCII and all that lies beyond it, in order, A-Z lower-cased."""
    return (text or "").encode().translate(_TERM).split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= _A
    x ^= x >> np.uint64(33)
    x *= _B
    x ^= x >> np.uint64(33)
    return x


def level_keys(hashes: np.ndarray, level: int) -> np.ndarray:
    return mixed(hashes + np.uint64(level * int(_A) & (1 << 64) - 1))


def positions(keys: np.ndarray, rows: int) -> np.ndarray:
    """keys x ``HASHES`` Bloom rows; ``rows`` is a power of two."""
    step = (keys >> np.uint64(32)) | np.uint64(1)
    return ((keys[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(rows - 1)).astype(np.int64)


class Hashes(dict):
    """Terms to 64-bit hashes, for the terms met lately."""

    def __missing__(self, term: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[term] = h = xxhash.xxh3_64_intdigest(term)
        return h


class Block:
    """Documents of one size class on their way into a row of the index."""

    def __init__(self, size_class: int):
        self.rows = BITS_PER_ENTRY << size_class
        self.most = max(8, min(BLOCK_DOCS, BLOCK_BYTES * 8 // self.rows // 8 * 8))
        self.bits = np.zeros((self.rows, self.most // 8), np.uint8)
        self.ids: list[int] = []
        self.sizes: list[int] = []

    def add(self, key: int, n: int, at: np.ndarray) -> bool:
        d = len(self.ids)
        self.bits[at, d >> 3] |= np.uint8(1 << (d & 7))
        self.ids.append(key)
        self.sizes.append(n)
        return d + 1 == self.most

    def batch(self) -> pa.RecordBatch:
        width = -(-len(self.ids) // 8)
        return record(self.ids, self.sizes, self.rows, self.bits[:, :width].tobytes(), None, None)


INDEX = "keys array<long>, sizes array<long>, bloom_rows int, bits binary, terms array<binary>, counts array<long>"


def record(keys, sizes, rows, bits, terms, counts) -> pa.RecordBatch:
    long = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([keys], long), pa.array([sizes], long), pa.array([rows], pa.int32()), pa.array([bits], pa.binary()), pa.array([terms], pa.list_(pa.binary())), pa.array([counts], long)], names=["keys", "sizes", "bloom_rows", "bits", "terms", "counts"])


def index(docs: DataFrame) -> DataFrame:
    """Rows with ``bits`` are blocks, rows with ``terms`` counts of documents by term (several rows may have one term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, blocks = Hashes(), Counter(), {}
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
                    words = terms_of(text)
                    if not words:
                        continue
                    counts = Counter(words)
                    seen.update(counts.keys())
                    h = np.fromiter(map(hashes.__getitem__, counts), np.uint64, len(counts))
                    tf = np.fromiter(counts.values(), np.int64, len(counts))
                    entries = [level_keys(h, 0)]
                    for i, least in enumerate(LEVELS[1:], 1):
                        some = tf >= least
                        if not some.any():
                            break
                        h, tf = h[some], tf[some]
                        entries.append(level_keys(h, i))
                    entries = np.concatenate(entries)
                    size_class = max(4, (len(entries) - 1).bit_length())
                    block = blocks.get(size_class) or blocks.setdefault(size_class, Block(size_class))
                    if block.add(key, len(words), positions(entries, block.rows).ravel()):
                        yield blocks.pop(size_class).batch()
                if len(seen) >= VOCABULARY:
                    yield record(None, None, None, None, list(seen), list(seen.values()))
                    seen.clear()
        for block in blocks.values():
            yield block.batch()
        if seen:
            yield record(None, None, None, None, list(seen), list(seen.values()))

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("key"), "text").mapInArrow(run, INDEX)


def items_of(benchmark: DataFrame) -> DataFrame:
    """``q`` (a number per row), ``item_id``, ``term`` and ``times``, a row per distinct term of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                counts = [Counter(terms_of(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("q"), part.column("item_id"), pa.array([list(c) for c in counts], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))], names=["q", "item_id", "terms", "times"])

    kind = dict(benchmark.dtypes)["item_id"]
    rows = benchmark.select(F.monotonically_increasing_id().alias("q"), "item_id", "text").mapInArrow(run, f"q long, item_id {kind}, terms array<binary>, times array<long>")
    return rows.select("q", "item_id", F.explode(F.arrays_zip("terms", "times")).alias("x")).select("q", "item_id", F.col("x.terms").alias("term"), F.col("x.times").alias("times"))


@dataclass
class Corpus:
    """N documents with terms, L terms."""

    n: int
    total: int

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.n + 2) / (2 * df + 1)))

    def length(self, n):
        return 100 - 75 + (75 * n * self.n) // self.total


def part_score(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass
class Pack:
    """Some items: the hashes of their terms, and per item which of these with what weight (times its occurrences)."""

    hashes: np.ndarray
    items: list[tuple[int, np.ndarray, np.ndarray]]


def packs_of(queries: dict[int, list[tuple[bytes, int]]]) -> list[Pack]:
    """``queries``: per item its terms and their weights times occurrences."""
    out, terms, items = [], {}, []

    def close() -> None:
        if items:
            out.append(Pack(np.array([xxhash.xxh3_64_intdigest(t) for t in terms], np.uint64), items[:]))
            terms.clear()
            items.clear()

    for q, pairs in sorted(queries.items()):
        if len(terms) + len(pairs) > PACK:
            close()
        pairs = [(t, w) for t, w in pairs if w > 0]
        if pairs:
            items.append((q, np.array([terms.setdefault(t, len(terms)) for t, _ in pairs]), np.array([w for _, w in pairs], np.int64)))
    close()
    return out


def bounds(bits: np.ndarray, sizes: np.ndarray, pack: Pack, corpus: Corpus) -> Iterator[tuple[int, np.ndarray]]:
    """Per item an upper bound of each document's score."""
    docs, m = len(sizes), corpus.length(sizes)
    most = [np.minimum(LEVELS[i] - 1, sizes) for i in range(1, len(LEVELS))] + [sizes]
    best = np.stack([np.zeros(docs, np.int64), *(part_score(tf, m) for tf in most)])
    level = np.zeros((len(pack.hashes), docs), np.uint8)
    alive, shown = np.arange(len(pack.hashes)), None
    for i in range(len(LEVELS)):
        at = positions(level_keys(pack.hashes[alive], i), len(bits))
        own = bits[at[:, 0]]
        for j in range(1, HASHES):
            own &= bits[at[:, j]]
        if shown is not None:
            own &= shown
        some = own.any(1)
        alive, shown = alive[some], own[some]
        if not len(alive):
            break
        level[alive] += np.unpackbits(shown, axis=1, count=docs, bitorder="little")
    worth = best[level, np.arange(docs)]
    for q, terms, weights in pack.items:
        yield q, (weights[:, None] * worth[terms]).sum(0)


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for i in range(b.num_rows):
            keys, sizes = (np.array(b.column(c)[i].values, np.int64) for c in ("keys", "sizes"))
            raw = np.frombuffer(b.column("bits")[i].as_buffer(), np.uint8)
            yield raw.reshape(b.column("bloom_rows")[i].as_py(), -1), keys, sizes


PAIRS = pa.schema([("q", pa.int64()), ("key", pa.int64()), ("bound", pa.int64())])


def highest_bounds(blocks: DataFrame, packs: list[Pack], corpus: Corpus, top: int) -> DataFrame:
    """``q``, ``key``, ``bound``: the ``top`` of each item, by bound, then id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for bits, keys, sizes in read_blocks(batches):
            for pack in packs:
                for q, bound in bounds(bits, sizes, pack, corpus):
                    old_key, old = best.get(q, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    some = np.flatnonzero(bound >= (old[-1] if len(old) == top else 1))
                    if len(some):
                        k, v = np.concatenate((old_key, keys[some])), np.concatenate((old, bound[some]))
                        first = np.lexsort((k, -v))[:top]
                        best[q] = k[first], v[first]
        for q, (k, v) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), q)), pa.array(k), pa.array(v)], schema=PAIRS)

    found = blocks.mapInArrow(run, "q long, key long, bound long")
    order = Window.partitionBy("q").orderBy(F.col("bound").desc(), "key")
    return found.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= top).drop("rn")


def not_excluded(blocks: DataFrame, packs: list[Pack], corpus: Corpus, floors: dict[int, tuple[int, int]]) -> DataFrame:
    """``q``, ``key`` of all documents whose bound beats the item's floor (a score and the id that holds it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bits, keys, sizes in read_blocks(batches):
            found_q, found = [], []
            for pack in packs:
                for q, bound in bounds(bits, sizes, pack, corpus):
                    score, key = floors.get(q, (0, 0))
                    some = keys[(bound > score) | ((bound == score) & (bound > 0) & (keys <= key))]
                    found.append(some)
                    found_q.append(np.full(len(some), q))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_q)), pa.array(np.concatenate(found))], names=["q", "key"])

    return blocks.mapInArrow(run, "q long, key long")


def scored(docs: DataFrame, pairs: DataFrame, queries: dict[int, list[tuple[bytes, int]]], corpus: Corpus) -> DataFrame:
    """``q``, ``key``, ``score`` (above 0) of the documents of ``pairs`` (``q``, ``key``), from their whole texts."""
    per_doc = pairs.groupBy("key").agg(F.collect_set("q").alias("qs"))
    per_doc = F.broadcast(per_doc) if pairs.count() <= BROADCAST_PAIRS else per_doc
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("key"), "text").join(per_doc, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, text, qs in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), b.column("qs").to_pylist(), strict=True):
                words = terms_of(text)
                counts, m = Counter(words), corpus.length(len(words)) if words else 0
                for q in qs:
                    score = sum(w * part_score(counts[t], m) for t, w in queries[q] if t in counts)
                    if score > 0:
                        out.append((q, key, score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["q", "key", "score"])

    return rows.mapInArrow(run, "q long, key long, score long")


def ranked(scores: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "key")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, top: int = 10, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of each item's ``top`` documents with a score above 0."""
    scratch = Scratch(spark, "lexical")
    stored = scratch.save(index(docs.select("doc_id", "text")), "index")
    blocks = stored.filter("bits is not null").select("keys", "sizes", "bloom_rows", "bits")
    size = lambda f: F.coalesce(F.sum(f), F.lit(0))
    corpus = Corpus(*stored.agg(size(F.size("keys").cast("long") * F.col("keys").isNotNull().cast("long")), size(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x))).first())
    items = scratch.save(items_of(benchmark), "items")
    wanted = items.select("term").distinct()
    seen = stored.filter("terms is not null").select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("c"))
    df = seen.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("c").alias("df"))
    items = scratch.save(items.join(df, "term"), "weighed")  # terms that no document has add nothing

    sent = items.agg(size(F.octet_length("term") + 64)).first()[0]
    slices = max(1, -(-sent // slice_bytes))
    out = []
    for i in range(slices):
        rows = items.filter(F.pmod(F.xxhash64("q"), F.lit(slices)) == i).select("q", "term", "times", "df").collect()
        queries: dict[int, list[tuple[bytes, int]]] = {}
        for r in rows:
            queries.setdefault(r["q"], []).append((bytes(r["term"]), r["times"] * corpus.weight(r["df"])))
        packs = packs_of(queries)
        first = scratch.save(highest_bounds(blocks, packs, corpus, top), f"first-{i}")
        tenth = ranked(scored(docs, first, queries, corpus), top).filter(F.col("rank") == top)
        floors = {r["q"]: (r["score"], r["key"]) for r in tenth.collect()}
        pairs = scratch.save(not_excluded(blocks, packs, corpus, floors), f"pairs-{i}")
        out.append(scratch.save(ranked(scored(docs, pairs, queries, corpus), top), f"ranked-{i}"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    names = items.select("q", "item_id").distinct()
    return found.join(names, "q").select("item_id", "rank", F.when(F.col("key") != _LOW, F.col("key")).alias("doc_id"), "score")
