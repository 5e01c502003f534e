"""Results of a run as tables that appear together.

``publish`` writes each table under the name of a batch and then, as one file, the manifest rows of the batch's keys.  Readers take
what a manifest row names, so that a run that broke off between two tables has left nothing that anyone sees; of a key that was
published again the last batch counts.  ``pending`` tells what a run that is resumed still has to do.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recloom.sources import scratch


def publish(path: str, tables: Mapping[str, DataFrame], keys: Sequence[str], done: DataFrame | None = None) -> str:
    """Writes ``tables``, then the manifest: the keys of ``done``, or else of the first table as written.  Returns the batch."""
    batch = uuid.uuid4().hex
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}/batch={batch}")
    if done is None:
        name, first = next(iter(tables.items()))
        done = first.sparkSession.read.schema(first.schema).parquet(f"{path}/{name}/batch={batch}")
    rows = done.select(*keys).distinct().withColumns({"batch": F.lit(batch), "at": F.current_timestamp()})
    rows.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return batch


def manifest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame | None:
    """Keys and the batch that counts for each, or none if nothing is published."""
    if not scratch.exists(spark, f"{path}/manifest"):
        return None
    rows = spark.read.parquet(f"{path}/manifest")
    return rows.groupBy(*keys).agg(F.max_by("batch", F.struct("at", "batch")).alias("batch"))


def read(spark: SparkSession, path: str, name: str, keys: Sequence[str]) -> DataFrame:
    """A table's rows that are published, without the batch."""
    known = manifest(spark, path, keys)
    if known is None:
        raise ValueError(f"{path}: nothing is published there")
    table = spark.read.option("mergeSchema", True).parquet(f"{path}/{name}")
    return table.join(known, [*keys, "batch"], "left_semi").drop("batch")


def pending(rows: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Of ``rows`` those whose keys are not published."""
    known = manifest(rows.sparkSession, path, keys)
    return rows if known is None else rows.join(known, list(keys), "left_anti")
