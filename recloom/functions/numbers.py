"""Column functions over numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson's correlation as an aggregate over the rows that have both; null, not an error, where one doesn't vary."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def clipped(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """within two ends; a missing value stays missing (greatest and least would leave it out)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def log_size(x: Column, floor: float = 0.0) -> Column:
    """natural log of a value's size, which counts as ``floor`` at least; null for 0."""
    size = F.greatest(F.abs(x), F.lit(floor))
    return F.when(x.isNotNull() & (size > 0), F.log(size))
