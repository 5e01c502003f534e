"""Line dedup by distinct-site spread, in DataFrame functions only.

Lines are hashed after trimming, and written once as (doc_id, site, hash).  Per hash a HyperLogLog sketch of the sites merges
by aggregation; hashes whose estimate lies within ``band`` of the threshold are counted exactly, those above are boilerplate,
those below are not.  A boilerplate line stays in the document with the smallest id that has it and goes from every other, so
no content is lost with all its copies.  Lines with fewer than ``min_words`` words are never boilerplate.

Edge cases: null text stays null, empty text empty; a null source is a site of its own; rows of one id share the fate of
their lines, rows without an id keep them; a line that repeats inside a document counts once and stays or goes as a whole;
an empty table gives an empty one; extra columns pass through, whatever their names.  The list of boilerplate hashes is
never broadcast by force: Spark joins it as its size asks for.  Both joins with it are salted by document, so that the
rows of one frequent line are work for ``SALTS`` tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recloom.llm.store import Scratch

MIN_SITES = 8
SALTS = 16


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def counts_as_line(line: Column, min_words: int) -> Column:
    return F.size(F.split(F.trim(line), " ")) >= min_words


def hashed_lines(docs: DataFrame, min_words: int = 3) -> DataFrame:
    """``doc_id``, ``site``, ``hash`` and ``salt`` of each document's distinct lines that count."""
    lines = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("site"), F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    lines = lines.filter(counts_as_line(F.col("line"), min_words))
    return lines.select("doc_id", "site", line_hash(F.col("line")).alias("hash"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))


def salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, band: float = 0.25, lg_k: int = 11) -> DataFrame:
    """``hash`` and ``keeper`` (smallest doc_id) of the lines (see ``hashed_lines``) that occur on ``min_sites`` distinct sites
    or more."""
    est = lines.groupBy("hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"), F.min("doc_id").alias("keeper"))
    est = est.filter(F.col("sites") >= min_sites * (1 - band))
    sure = est.filter(F.col("sites") > min_sites * (1 + band)).select("hash", "keeper")
    near = est.filter(F.col("sites") <= min_sites * (1 + band)).select("hash", "keeper")
    pairs = lines.join(salted(near), ["hash", "salt"]).groupBy("hash", "keeper", "site").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("hash", "keeper").count().filter(F.col("count") >= min_sites).select("hash", "keeper")
    return sure.unionByName(exact)


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = 3) -> DataFrame:
    """``row`` (the columns of ``docs`` as a struct), its ``text`` without boilerplate lines, ``n_lines`` and ``n_removed``."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.save(hashed_lines(docs, min_words), "lines")
    bad = scratch.save(boilerplate(lines, min_sites), "boilerplate")
    hits = lines.join(salted(bad), ["hash", "salt"]).filter("doc_id != keeper")
    per_doc = hits.groupBy("doc_id").agg(F.collect_set("hash").alias("bad"))
    out = docs.select(F.struct(*docs.columns).alias("row")).join(per_doc, F.col("row.doc_id") == F.col("doc_id"), "left")
    every, touched = F.split("row.text", "\n"), F.col("bad").isNotNull()
    kept = F.filter(every, lambda s: ~(F.array_contains("bad", line_hash(s)) & counts_as_line(s, min_words)))
    out = out.select("row", F.when(touched, kept).alias("kept"))
    touched = F.col("kept").isNotNull()
    return out.select(
        "row",
        F.when(touched, F.array_join("kept", "\n")).otherwise(F.col("row.text")).alias("text"),
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size(every)).cast("long").alias("n_lines"),
        F.when(touched, F.size(every) - F.size("kept")).otherwise(0).cast("long").alias("n_removed"),
    )


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = 3) -> DataFrame:
    """``docs`` with ``text`` cleaned, and ``n_lines`` and ``n_removed`` added (columns of these names are replaced)."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    out = cleaned(docs, min_sites, min_words)
    return out.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in own), "n_lines", "n_removed")
