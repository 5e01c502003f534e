"""From raw documents to training text: quality, line dedup, near duplicates, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; ``run`` writes each stage's result
as Parquet below the shared folder and reads it again as the next one's documents.

Every stage takes nulls in any column, empty and very long texts, empty tables and extra columns, whose names may be those
that an operator adds; all but the last return the columns they got.  A row without an id is judged by quality, keeps its
lines, is no near duplicate, is looked at for benchmark items by its text, and is tokenised.  Repeated rows share their
fate, so near duplicates keep all rows of the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recloom.llm import bpe, decontam, jaccard, linededup, quality
from recloom.llm.queries import table
from recloom.llm.store import Scratch

def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; null and empty texts get a score like all others."""
    return quality.judged(spark, docs, table(spark, sf_dir, "labels")).filter("predicted = 1").select("row.*")


def by_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go, and documents that have nothing but white space beside them; ``n_chars`` is counted
    anew.  Null and empty texts stay."""
    out = linededup.cleaned(docs)
    touched = F.col("n_removed") > 0
    out = out.filter(~touched | F.col("text").rlike(r"\S"))
    n_chars = F.when(touched, F.length("text")).otherwise(F.col("row.n_chars")).cast(dict(docs.dtypes)["n_chars"])
    return out.select(*({"text": F.col("text"), "n_chars": n_chars}.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def by_similarity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest id stays."""
    found = jaccard.join_components(spark, docs, k=5, percent=80)
    leave = found.filter("component_id != doc_id").select("doc_id").distinct()
    return docs.join(leave, "doc_id", "left_anti").select(*docs.columns)


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    key = decontam.row_key()
    keyed = docs.select(key.alias("doc_id"), "text")
    found = decontam.contaminated(spark, keyed, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("id")).distinct()
    return docs.join(found, key == F.col("id"), "left_anti").select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes per document; null and empty texts have no token."""
    import public_tokenizers as tokenizers

    return bpe.round_trip(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


STAGES = [
    ("quality", by_quality),
    ("lines", by_lines),
    ("near_duplicates", by_similarity),
    ("decontamination", by_benchmark),
    ("tokens", to_tokens),
]

#: No stage's whole is in reach of SQL: model scores, shingle components, templates and merges are tested in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
