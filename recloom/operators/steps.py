"""The steps of a run over recorded units, chosen by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recloom.operators import events as ev
from recloom.operators.tables import patch_columns


def patched(stored: DataFrame, new: DataFrame, unit: Sequence[str], prefix: str) -> DataFrame:
    """``stored`` with ``new``'s columns, named after ``prefix``, in place of those it has of that prefix; all else stays, and
    a unit without new values has nulls.  Units that the table doesn't know, or has twice, are an error before anything is
    changed: they would be another version's."""
    named = new.select(*unit, *(F.col(c).alias(f"{prefix}{c}") for c in new.columns if c not in unit))
    if named.select(*unit).join(stored, list(unit), "left_anti").limit(1).count():
        raise ValueError(f"units of {prefix}* are not in the stored table")
    if stored.groupBy(*unit).count().filter("count > 1").limit(1).count():
        raise ValueError("the stored table has a unit twice")
    return patch_columns(stored, named, unit, prefix)


def patch_sliding_rp(stored: DataFrame, spikes: DataFrame, unit: Sequence[str], **options) -> DataFrame:
    """Refractory columns anew, as after a change of their settings."""
    return patched(stored, ev.sliding_rp(spikes, unit, **options), unit, "slidingRP_")


def patch_acg3d(stored: DataFrame, spikes: DataFrame, unit: Sequence[str], **options) -> DataFrame:
    """``acg3d_counts``: the correlogram by rate decile as an array of decile, bin, n and per_event, by decile, then bin."""
    cells = F.array_sort(F.collect_list(F.struct("decile", "bin", "n", "per_event"))).alias("counts")
    return patched(stored, ev.acg_by_rate_decile(spikes, unit, **options).groupBy(*unit).agg(cells), unit, "acg3d_")


#: Unit quality, its autocorrelogram, signal around events, coupling to the population; and those that only renew columns of a
#: stored table.
STEPS: dict[str, Callable[..., DataFrame]] = {
    "cells": ev.sliding_rp,
    "acg": ev.log_acg,
    "stlfp": ev.window_average,
    "stpc": ev.coupling,
    "patch_slidingrp": patch_sliding_rp,
    "patch_acg3d": patch_acg3d,
    "burstiness": ev.burstiness_memory,
}


def run(step: str, *tables, **options) -> DataFrame:
    """The step of that name over its tables with its options; another name is an error that lists the names."""
    if step not in STEPS:
        raise ValueError(f"no step {step!r}; there are {', '.join(sorted(STEPS))}")
    return STEPS[step](*tables, **options)
