"""Sources.  Schemas are given, not inferred, wherever the format has none; filters and columns are pushed down by Spark."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recloom.sources import files


def parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """S1."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a header."""
    return spark.read.schema(schema).option("header", True).csv(path)


def keyed_tree(spark: SparkSession, root: str, name: str) -> DataFrame:
    """S3: parquet shards ``subject/pid/T<ms>/name``; the keys come from the path, the time from its label."""
    x = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).parquet(root)
    p = F.split(F.col("_metadata.file_path"), "/")
    part = lambda k: F.element_at(p, k)
    return x.select("*", part(-4).alias("subject"), part(-3).alias("pid"), (F.substring(part(-2), 2, 20).cast("double") / 1000).alias("t0"))


def with_tags(df: DataFrame, tags: Mapping[str, Mapping[str, str]], path: str = "path") -> DataFrame:
    """Columns from a file's name: each takes the first of its values whose word is in the name (without regard to case; the
    empty word is in every name), null if none is.  ``tags``: column -> word -> value."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    for column, words in tags.items():
        out = F.lit(None).cast("string")
        for word, value in reversed(words.items()):
            out = F.when(name.contains(word.lower()), F.lit(value)).otherwise(out)
        df = df.withColumn(column, out)
    return df


def shards(spark: SparkSession, path: str) -> DataFrame:
    """Shards whose columns differ, missing ones as null; an empty folder is an error of the reader."""
    return spark.read.option("mergeSchema", True).parquet(path)


def checksums(spark: SparkSession, path: str, glob: str = "*") -> tuple[DataFrame, DataFrame]:
    """``path`` and ``md5`` of every file, and one hash per folder over its sorted file hashes.  A task reads a file part by
    part, so its size doesn't matter."""
    found = files.digests(files.listing(spark, path, glob))
    folders = found.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.md5(F.array_join(F.sort_array(F.collect_list("md5")), "").cast("binary")).alias("md5"))
    return found, folders


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """One path per line; empty lines and those that begin with # are left out."""
    v = F.trim("value")
    p = F.split(v, "/Subjects/")
    rest = F.split(p[1], "/")
    x = spark.read.text(path).filter((v != "") & ~v.startswith("#"))
    return x.select(v.alias("path"), F.element_at(F.split(p[0], "/"), -1).alias("lab"), rest[0].alias("subject"), rest[1].alias("date"), rest[2].alias("number"))


def log_durations(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Hours from the seconds at the end of each log's last line, null if it has none.  Only the end of a log is read; an
    empty file has no row.  For many logs name their folder and ``glob``: files that a pattern in ``path`` names are listed by the driver."""
    x = files.last_lines(files.listing(spark, path, glob).filter("length > 0"))
    s = F.regexp_extract("line", r"([0-9.]+)\s*s\s*$", 1)
    return x.select("path", F.round(F.when(s != "", s.try_cast("double")) / 3600, 2).alias("hours"))


def latest(df: DataFrame, label: str) -> DataFrame:
    """Rows of the greatest label; one value is looked up, then it is a plain filter that prunes partitions."""
    top = df.agg(F.max(label)).first()[0]
    return df.filter(F.col(label) == top)


def window(df: DataFrame, i: str, fs: float, t0: float, length: int, offset: int = 0, sync: Sequence[int] = ()) -> DataFrame:
    """A fixed number of samples from floor(fs t0) + offset on, without the sync channels."""
    a = int(fs * t0) + offset
    out = df.filter((F.col(i) >= a) & (F.col(i) < a + length))
    return out.filter(~F.col("channel").isin(list(sync))) if sync else out
