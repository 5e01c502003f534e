"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and freed of marks around them; numbers, units and names (capitalised inside a sentence) become typed
placeholders whose values are kept aside as slots.  Hashed windows of ``width`` words, or of all words of an item that has
fewer, are joined between documents and benchmark in two forms:

* literal: the lower-cased words as they stand.  A hit counts by itself;
* typed: with placeholders, where at least half of the window is words.  Per document, item and alignment the slots must be
  consistent, one benchmark value standing for one document value; hits of other alignments don't count.

A question with other numbers or names thus counts, a chance mixture does not.  A document is contaminated by an item if hits
cover ``coverage`` of all the item's windows, or of those that may be typed.  An item of fewer than ``MIN_WORDS`` words
would be found in any text; it counts where a line of a document consists of it.

The benchmark's windows go to all tasks only while they are ``BROADCAST_BYTES`` at most, as counted on the rows that are
sent; beyond, all document windows are joined by a shuffle, salted by document.

Edge cases: null and empty texts have no windows; rows without an id have no name to be reported by and are left out (see
``row_key``); repeated rows of an id count once; empty tables give no pairs; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recloom.llm.store import Scratch

WIDTH, COVERAGE, MIN_WORDS, BROADCAST_BYTES, SALTS = 8, 0.5, 4, 32 << 20, 16
#: Words that are units: lengths, weights, volumes, times, money, shares.
UNITS = [
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "inch", "inches", "foot", "feet", "mile", "miles",
    "meter", "meters", "metre", "metres", "kilometer", "kilometers",
    "mg", "g", "kg", "t", "oz", "lb", "lbs", "gram", "grams", "kilogram", "kilograms",
    "ml", "l", "liter", "liters", "litre", "litres",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hrs", "hour", "hours",
    "day", "days", "week", "weeks", "month", "months", "year", "years",
    "cent", "cents", "dollar", "dollars", "euro", "euros", "percent", "degree", "degrees",
]
_NUMBER = r"^[+-]?[$€£]?\p{Nd}[\p{Nd}.,:/]*[%$€£]?$"
_CLOSES = r"""[.!?:]["'”’)»]*$"""
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "$%") + "«»“”‘’¿¡…"
_A, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(31)
_KIND = [np.uint64(0), np.uint64(0x1D8AF066), np.uint64(0x2545F491), np.uint64(0x3C6EF372)]  # word, number, unit, name


@dataclass
class Canonical:
    """Words of several texts in a row: hash of the word (``raw``), of the word or its placeholder (``h``), kind (0 word,
    1 number, 2 unit, 3 name), text number, and the words by their number in ``low``.  Marks alone are no word."""

    raw: np.ndarray
    h: np.ndarray
    kind: np.ndarray
    text: np.ndarray
    word: np.ndarray
    low: pa.Array


def canonical(texts: pa.Array) -> Canonical:
    """Arrow splits the texts and numbers their distinct words; what a word is by itself is found out on these."""
    cut = pc.utf8_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    size = np.diff(cut.offsets.to_numpy())
    coded = cut.flatten().dictionary_encode()
    own, word = coded.dictionary, coded.indices.to_numpy()
    core = pc.utf8_trim(own, characters=_EDGE)
    low = pc.utf8_lower(core)

    def flag(x: pa.Array) -> np.ndarray:
        return x.to_numpy(zero_copy_only=False).astype(bool)

    number = flag(pc.match_substring_regex(core, _NUMBER))
    unit = flag(pc.is_in(low, value_set=pa.array(UNITS, pa.large_string()))) & ~number
    capital = flag(pc.and_(pc.utf8_is_upper(pc.utf8_slice_codeunits(core, 0, 1)), pc.utf8_is_lower(pc.utf8_slice_codeunits(core, 1))))
    closes = flag(pc.match_substring_regex(own, _CLOSES))
    known = np.fromiter(map(xxhash.xxh64_intdigest, low.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), np.uint64, len(low))
    text = np.repeat(np.arange(len(texts)), size)
    real = (pc.binary_length(core).to_numpy(zero_copy_only=False) > 0)[word]
    word, text = word[real], text[real]
    kind = (number + 2 * unit).astype(np.int8)[word]
    first = np.ones(len(word), bool)
    first[1:] = (text[1:] != text[:-1]) | closes[word[:-1]]
    kind[capital[word] & ~first & (kind == 0)] = 3
    raw = known[word]
    out = raw.copy()
    for k in (1, 2, 3):
        out[kind == k] = _KIND[k]
    return Canonical(raw, out, kind, text, word, low)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    m = max(0, len(h) - width + 1)
    out = np.full(m, np.uint64(width))
    for i in range(width):
        out ^= out >> _S
        out *= _A
        out += h[i : i + m]
    out ^= out >> _S
    return (out * _A).view(np.int64)


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a MB of text, or one text.  What Arrow has put by goes back to the system between them."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
        yield b.slice(at, end - at)
        pa.default_memory_pool().release_unused()
        at = end


class Known:
    """Sorted hashes, behind a table of bits that most others fail at."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.gate = hashes, np.zeros(1 << 20, bool)
        self.gate[hashes & ((1 << 20) - 1)] = True

    def has(self, x: np.ndarray) -> np.ndarray:
        out = self.gate[x & ((1 << 20) - 1)]
        some = np.flatnonzero(out)
        at = np.minimum(np.searchsorted(self.hashes, x[some]), len(self.hashes) - 1)
        out[some] = self.hashes[at] == x[some] if len(self.hashes) else False
        return out


_FIELDS = {"pos": "long", "hash": "long", "literal": "boolean", "may_type": "boolean", "slots": "array<string>", "width": "int", "total": "long", "typed_total": "long"}
_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.int32(), pa.int64(), pa.int64()]


def windows(df: DataFrame, key: str, widths: list[int] | None, width: int, known: np.ndarray | None) -> DataFrame:
    """``key``, ``pos``, ``hash``, ``literal``, ``may_type`` (at least half of the window is words), ``slots`` (kind and value of
    a typed window's placeholders), ``width``, ``total`` and ``typed_total``, the windows that a text has and those of them
    that may be typed.  A window without placeholders is a literal one only.  ``widths`` null: each text's own, ``width`` or
    all its words if they are fewer.  ``known``: sorted hashes to which rows are kept."""

    def some(c: Canonical, rows: int, w: int, own: Known | None) -> Iterator[tuple]:
        """Per window that counts: text, position, then the columns from ``hash`` on."""
        m = max(0, len(c.h) - w + 1)
        n = np.bincount(c.text, minlength=rows)
        text, begin = c.text[:m], np.cumsum(n) - n
        ok = (text == c.text[w - 1 : w - 1 + m]) & (n[text] >= MIN_WORDS)
        if widths is None:
            ok &= np.minimum(n[text], width) == w
        words = np.concatenate(([0], np.cumsum(c.kind == 0)))
        words = words[w : w + m] - words[:m]
        slots, may = words < w, 2 * words >= w
        total, typed_total = (np.bincount(text[x], minlength=rows) for x in (ok, ok & may))
        typed = window_hashes(c.h, w)
        plain = typed.copy()
        at = np.flatnonzero(slots & ok)
        if len(at):
            plain[at] = window_hashes(c.raw, w)[at]
        for hashes, these in ((plain, ok), (typed, ok & slots & may)):
            found = np.flatnonzero(these if own is None else these & own.has(hashes))
            for p in found.tolist():
                t = int(text[p])
                values = [f"{c.kind[j]}{c.low[int(c.word[j])]}" for j in range(p, p + w) if c.kind[j]] if hashes is typed else []
                yield t, p - int(begin[t]), int(hashes[p]), hashes is plain, bool(may[p]), values, w, int(total[t]), int(typed_total[t])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if known is None else Known(known)
        for batch in batches:
            for b in _slices(batch):
                c = canonical(b.column("text"))
                rows = [r for w in (widths if widths is not None else range(MIN_WORDS, width + 1)) for r in some(c, b.num_rows, w, own)]
                cols = list(zip(*rows, strict=True)) or [[] for _ in range(9)]
                keys = b.column(key).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(x, t) for x, t in zip(cols[1:], _TYPES, strict=True))], names=[key, *_FIELDS])

    kind = dict(df.dtypes)[key]
    return df.select(key, "text").mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{k} {v}" for k, v in _FIELDS.items()))


def short_texts(df: DataFrame, key: str) -> DataFrame:
    """``key`` and ``hash`` of the texts of under ``MIN_WORDS`` words, one at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _slices(batch):
                c = canonical(b.column("text"))
                n = np.bincount(c.text, minlength=b.num_rows)
                begin = np.cumsum(n) - n
                at = np.flatnonzero((n > 0) & (n < MIN_WORDS))
                hashes = np.array([window_hashes(c.raw[begin[t] : begin[t] + n[t]], int(n[t]))[0] for t in at.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at)), pa.array(hashes)], names=[key, "hash"])

    return df.select(key, "text").mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, hash long").distinct()


def row_key() -> Column:
    """A name for every row, by which rows without an id can be looked at as well: the id, else a digest of the text."""
    return F.coalesce(F.concat(F.lit("id "), F.col("doc_id").cast("string")), F.concat(F.lit("text "), F.sha1(F.col("text").cast("binary"))))


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``doc_id``, ``item_id``, ``covered`` (windows of the item), ``total`` and ``same_slots`` (all of them literally)."""
    scratch = Scratch(spark, "decontam")
    docs, benchmark = docs.filter("doc_id is not null"), benchmark.filter("item_id is not null")
    items = scratch.save(windows(benchmark, "item_id", None, width, None).withColumnsRenamed({"pos": "ipos", "slots": "islots"}).distinct(), "items")
    # 64 bytes of numbers and the slots' characters a row, as the join keeps them
    sent = items.agg(F.sum(64 + F.octet_length(F.array_join("islots", " ")))).first()[0] or 0
    few = sent <= broadcast_bytes
    known = np.unique(items.select("hash").toPandas()["hash"].to_numpy(np.int64)) if few else None
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    found = windows(docs, "doc_id", widths, width, known).select("doc_id", "pos", "hash", "slots")
    item = items.select("item_id", "ipos", "hash", "literal", "may_type", "islots", "total", "typed_total")
    if few:
        hits = found.join(F.broadcast(item), "hash")
    else:
        item = item.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int")).join(item.hint("merge"), ["hash", "salt"])
    hits = hits.select("doc_id", "item_id", "total", "typed_total", "ipos", "literal", "may_type", (F.col("pos") - F.col("ipos")).alias("shift"), "slots", "islots")
    hits = scratch.save(hits, "hits")
    key = ["doc_id", "item_id", "shift"]
    pairs = hits.filter("not literal").select(*key, F.explode(F.arrays_zip("slots", "islots")).alias("s")).select(*key, F.col("s.slots").alias("d"), F.col("s.islots").alias("i")).distinct()
    bad = pairs.groupBy(*key, "i").agg(F.count("*").alias("n")).filter("n > 1").select(*key).distinct()
    good = hits.filter("literal").unionByName(hits.filter("not literal").join(bad, key, "left_anti").select(*hits.columns))
    of = ["doc_id", "item_id", "total", "typed_total"]
    out = good.groupBy(*of, "ipos").agg(F.max("literal").alias("same"), F.max("may_type").alias("may_type"))
    out = out.groupBy(*of).agg(F.count("*").alias("covered"), F.count_if("may_type").alias("typed"), F.bool_and("same").alias("same_slots"))
    enough = (F.col("covered") >= F.lit(coverage) * F.col("total")) | ((F.col("typed_total") > 0) & (F.col("typed") >= F.lit(coverage) * F.col("typed_total")))
    out = out.filter(enough).select("doc_id", "item_id", "covered", "total", "same_slots")
    short = scratch.save(short_texts(benchmark, "item_id"), "short-items")
    if not short.isEmpty():
        lines = short_texts(docs.select("doc_id", F.explode(F.split("text", "\n")).alias("text")), "doc_id")
        one = F.lit(1).cast("long")
        out = out.unionByName(lines.join(short, "hash").select("doc_id", "item_id", one.alias("covered"), one.alias("total"), F.lit(True).alias("same_slots")).distinct())
    return out
