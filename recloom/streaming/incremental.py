"""Structured Streaming forms of two operators with an exact incremental version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str, keys: Sequence[str], width: str, late: str) -> DataFrame:
    """Events per unit and window; a window closes when the watermark passes it, so its state goes."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def merged_sums(batches: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Sufficient statistics of several batches as one: sums add up, whatever the cut into batches was."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return out.groupBy(*keys).agg(F.sum("v").alias("v"))
