"""The rows with the lowest draws, found by a threshold first, so that no partition sends more than its share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lowest(df: DataFrame, draw: str, ties: list[str], n: int, rows: int, weight: float) -> DataFrame:
    """The ``n`` of ``rows`` rows of ``df`` that are lowest in ``draw``, then in ``ties``.  About ``weight`` * x rows draw less
    than a small x; the threshold is doubled until it leaves ``n`` rows, so some 2 ``n`` rows are sorted, however many
    partitions there are.  Fewer than ``n`` rows are all taken.  A row whose draw is null is never
    taken unless all are; callers draw by hashes, which have none.  Equal draws are ordered by ``ties``."""
    if rows <= n:
        return df
    x = 1.2 * n / max(weight, 1.0)
    while (some := df.filter(F.col(draw) <= x)).count() < n:
        x *= 2
    return some.orderBy(draw, *ties).limit(n)
