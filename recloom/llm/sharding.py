"""Sharding by sampled splitters.

Rows are ordered by a hash of their text, then by id, so that equal texts lie together.  A size-weighted sample of these
keys gives quantiles as splitters of many small ranges; ranges that turn out overfull are sampled again and subdivided (a
group of equal texts that is too large is cut by id) until none is left but such as are one key, id and text alike, which
nothing can cut.  Exact sizes of all ranges then decide which run of ranges makes a shard.  The driver sees the sample and
one row per range, both bounded by parameters.

Edge cases: null and empty texts have size 1; a null id sorts first; repeated rows are adjacent; an empty table gives an
empty one; extra columns are left out; a shard may stay empty if there are fewer rows than shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recloom.llm.draws import lowest
from recloom.llm.store import Scratch

SAMPLE, RANGES, MOST_RANGES, RANGE_BYTES = 20_000, 2048, 100_000, 128 << 20
_LOW = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("h"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def weighted_sample(rows: DataFrame, n: int, count: int, total: int) -> list[tuple[int, int]]:
    """Keys of ``n`` of ``count`` rows of ``total`` size, drawn without replacement with chances in proportion to size
    (exponential races)."""
    u = (F.pmod(F.xxhash64("doc_id", "h", F.lit(7)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    races = rows.select("h", "doc_id", (-F.log(u) / F.col("size")).alias("race"))
    got = lowest(races, "race", ["h", "doc_id"], n, count, total).collect()
    return sorted((r["h"], _LOW if r["doc_id"] is None else r["doc_id"]) for r in got)


def quantiles(keys: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    """Up to ``parts`` - 1 splitters.  The first of several with one hash is put before the whole group, so that a group is
    cut only where it spans ranges."""
    picked = sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if len(keys) > 1 else []
    out: list[tuple[int, int]] = []
    for k in picked:
        out.append((k[0], _LOW) if not out or out[-1][0] != k[0] else k)
    return out


def assigned(rows: DataFrame, splitters: list[tuple[int, int]], only: list[int] | None = None) -> DataFrame:
    """Adds ``range``: how many splitters are at or below a row's key.  ``only``: ranges to which rows are kept."""
    wanted = None if only is None else np.array(sorted(only), np.int64)
    h = np.array([s[0] for s in splitters], np.int64)
    d = np.array([s[1] for s in splitters], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("h").to_numpy(zero_copy_only=False)
            ids = b.column("doc_id").cast(pa.int64()).fill_null(_LOW).to_numpy(zero_copy_only=False)
            lo, hi = np.searchsorted(h, own, "left"), np.searchsorted(h, own, "right")
            at = hi.copy()
            for i in np.flatnonzero(hi - lo > 1):  # a group that is cut by id
                at[i] = lo[i] + np.searchsorted(d[lo[i] : hi[i]], ids[i], "right")
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=[*b.schema.names, "range"])
            yield out if wanted is None else out.filter(pa.array(np.isin(at, wanted)))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("range", T.LongType())]))


def shard(spark: SparkSession, docs: DataFrame, shards: int = 8, sample: int = SAMPLE, ranges: int = RANGES) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law`` (``bytes``), ``shard``, ``slot`` (gapless from 0), ``grown_shard`` (null)."""
    scratch = Scratch(spark, "shards")
    rows = scratch.save(keyed(docs), "keys")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = int(min(MOST_RANGES, max(ranges, -(-total // RANGE_BYTES))))
    splitters = quantiles(weighted_sample(rows, max(sample, 8 * ranges), count, total), ranges)
    while True:
        per_range = assigned(rows, splitters).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        stats = {r["range"]: (r["bytes"], r["rows"]) for r in per_range.collect()}
        over = [k for k, (size, n) in stats.items() if n > 1 and size > 2 * total / ranges]
        inside = sum(stats[k][1] for k in over), sum(stats[k][0] for k in over)
        more = quantiles(weighted_sample(assigned(rows, splitters, over).drop("range"), sample, *inside), 4 * sum(-(-stats[k][0] * ranges // total) for k in over)) if over else []
        merged = sorted({*splitters, *more})
        if len(merged) == len(splitters):
            break
        splitters = merged
    # a run of ranges makes a shard: a range goes to the shard in which its middle byte lies
    first, place, seen, filled = {}, [], 0, [0] * shards
    for k in sorted(stats):
        size, n = stats[k]
        to = min(shards - 1, int((seen + size / 2) * shards // max(total, 1)))
        first[k] = (to, filled[to])
        filled[to] += n
        seen += size
        place.append((k, *first[k]))
    table = spark.createDataFrame(place, "range long, shard int, base long")  # a row per range, a few MB
    own = Window.partitionBy("range").orderBy("h", "doc_id", "size")
    out = assigned(rows, splitters).withColumn("rn", F.row_number().over(own)).join(F.broadcast(table), "range")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rn") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
