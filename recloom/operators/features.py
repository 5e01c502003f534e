"""The feature bundle of recorded snippets, a group of columns at a time, each computed once.

A group is a table of its own with a folder per key (recording and snippet).  What a run finds there is not computed again, so a
run that broke off, or new snippets, cost only what is missing; the bundle is the groups side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recloom.functions import kernels
from recloom.operators import blocks
from recloom.operators import signal as sg
from recloom.operators import spikes as sp
from recloom.sources import scratch, writers


def present(rows: DataFrame, path: str, keys: Sequence[str]) -> DataFrame | None:
    """The keys that a stored group has, or none if there is no such table yet.  They are read from the folders' names."""
    spark = rows.sparkSession
    if not scratch.exists(spark, path):
        return None
    kinds = dict(rows.dtypes)
    return spark.read.parquet(path).select(*(F.col(k).cast(kinds[k]).alias(k) for k in keys)).distinct()


def bundle(rows: DataFrame, keys: Sequence[str], path: str, groups: Mapping[str, Callable[[DataFrame], DataFrame]], channel: str = "channel") -> tuple[DataFrame, dict[str, int]]:
    """The stored groups below ``path`` joined by keys and channel, and how many keys each group was computed for.  ``groups``:
    from rows (keys and whatever they need) to keys, ``channel`` and columns of their own.  A key that a group has no row for is
    asked for again by the next run.  Keys must not be null, as they are folders."""
    spark, kinds, out, computed = rows.sparkSession, dict(rows.dtypes), None, {}
    wanted = rows.select(*keys).distinct()
    for name, compute in groups.items():
        own = f"{path}/{name}"
        have = present(rows, own, keys)
        missing = wanted if have is None else wanted.join(have, list(keys), "left_anti")
        computed[name] = missing.count()
        if computed[name]:
            todo = rows if have is None else rows.join(missing, list(keys), "left_semi")
            writers.by_key(compute(todo), own, keys)
        table = spark.read.parquet(own).withColumns({k: F.col(k).cast(kinds[k]) for k in keys})
        out = table if out is None else out.join(table, [*keys, channel], "full")
    return out.join(wanted, list(keys), "left_semi"), computed


def lf(rows: DataFrame, keys: Sequence[str], fs: float, window: int) -> DataFrame:
    """RMS and band powers per channel.  Rows here and below: keys, ``i``, ``n``, ``x``; a snippet is of bounded length."""
    long = rows.select(*keys, "i", F.posexplode("x").alias("channel", "v")).withColumn("v", F.col("v").cast("double"))
    arrays = sg.chunks_of(long, [*keys, "channel"], "i", "v").drop("i")
    powers = sg.band_powers(arrays, [*keys, "channel"], "v", fs, window).groupBy(*keys, "channel").pivot("band", list(kernels.BANDS)).agg(F.first("db"))
    return sg.rms(long, [*keys, "channel"], "v").join(powers, [*keys, "channel"], "left")


def csd(rows: DataFrame, keys: Sequence[str], q: int, h: float) -> DataFrame:
    return blocks.csd_power(rows, keys, q, h)


def ap(rows: DataFrame, keys: Sequence[str], reach: int) -> DataFrame:
    """Largest correlation with a neighbour."""
    long = rows.select(*keys, "i", F.posexplode("x").alias("channel", "v"))
    return sp.neighbour_correlation(long, keys, "channel", "i", "v", reach)


def spiking(rows: DataFrame, keys: Sequence[str], k: float, reach: int, dead: int, lo: int, hi: int) -> DataFrame:
    """Number and mean depth of the separated events of each channel, and the shape of their mean waveform.  An event too near an
    end for a waveform counts all the same."""
    long = rows.select(*keys, "i", F.posexplode("x").alias("channel", "v")).withColumn("v", F.col("v").cast("double"))
    own = [*keys, "channel"]
    events = sp.separate(sg.detect_spikes(long, own, "i", "v", k), keys, "channel", "i", "v", reach, dead)
    counts = events.groupBy(*own).agg(F.count("*").alias("n_spikes"), F.avg("v").alias("spike_depth"))
    mean = sp.mean_waveforms(sp.cutouts(events.withColumn("event", F.col("i")), long, own, ["event"], "i", lo, hi).select(*own, "waveform"), own)
    whole = mean.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "v"))), lambda s: s["v"]).alias("w"))
    shape = sg.waveform_features(whole, own, "w")
    every = rows.select(*keys, F.explode(F.sequence(F.lit(0), F.size("x") - 1)).alias("channel")).distinct()
    return every.join(counts, own, "left").join(shape, own, "left").fillna(0, ["n_spikes"])
