"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recloom.llm import audit, bpe, chat, decontam, fingerprint, jaccard, lexical, linededup, media, quality, sharding, tokenfile, warc
from recloom.llm.oracle import ORACLE
from recloom.llm.store import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.convert_pages(spark, table(spark, sf_dir, "pages"), Scratch(spark, "warc").path("archives"))
    return back.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").cast("long").alias("refers_to"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = Scratch(spark, "media").save(media.store_texts(table(spark, sf_dir, "documents")), "images")
    return media.media_features(stored, ["doc_id", "n_bytes"])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "\\### Assistant: </turn> ok"
    kinds = "conv_id long, turn long, role string, text string"
    more = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], kinds)
    return chat.read_back(chat.expand(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(spark, table(spark, sf_dir, "documents"))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    path = Scratch(spark, "tokens").path("files")
    manifest = tokenfile.write_token_files(spark, table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"), path)
    return tokenfile.read_token_files(spark, manifest, path)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(spark, table(spark, sf_dir, "documents"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(spark, table(spark, sf_dir, "documents"))


__all__ = ["ORACLE", "QUERIES"]

QUERIES = {f.__name__: f for f in (op1_warc, op2_media, op3_quality, op4_chat, op5_jaccard, op6_decontam, op7_bpe, op8_token_files, op9_line_dedup, op10_sharding, op11_lexical, op12_audit, op13_fingerprints)}
