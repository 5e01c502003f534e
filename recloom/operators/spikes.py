"""Saturation, detected events and their cut-outs, and features of neighbouring channels.

Neighbours lie within a number of channels, so every join has equality keys and a fan-out that parameters bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recloom.functions.numbers import correlation


def saturation(df: DataFrame, keys: Sequence[str], channel: str, i: str, v: str, limit: float, slew: float, share: float) -> DataFrame:
    """Samples at which over ``share`` of the channels are at or over ``limit`` in size or jump by ``slew`` or more since
    the sample before (``saturated``).  A channel's first sample, or one after a gap, has no jump; missing values are no fault."""
    own = Window.partitionBy(*keys, channel).orderBy(i)
    jump = F.when(F.lag(i).over(own) == F.col(i) - 1, F.abs(F.col(v) - F.lag(v).over(own)))
    x = df.select(*keys, i, (F.coalesce(F.abs(v) >= limit, F.lit(False)) | F.coalesce(jump >= slew, F.lit(False))).alias("_hit"))
    return x.groupBy(*keys, i).agg((F.count_if("_hit") / F.count("*") > share).alias("saturated"))


def saturation_report(spans: DataFrame, sizes: DataFrame, keys: Sequence[str], fs: float, muted: Column | None = None) -> DataFrame:
    """Per recording of ``sizes`` (keys, ``n``: its samples, and what ``muted`` needs) the number of intervals
    (``start``, ``end``, half-open), their seconds, their share of the samples, and whether the stored copy is muted there.  A
    recording without intervals has zeros, one without samples no share."""
    s = spans.groupBy(*keys).agg(F.count("*").alias("n_intervals"), F.sum(F.col("end") - F.col("start")).alias("_n"))
    x = sizes.join(s, list(keys), "left")
    bad = F.coalesce("_n", F.lit(0))
    return x.select(*keys, F.coalesce("n_intervals", F.lit(0)).alias("n_intervals"), (bad / fs).alias("seconds"), F.try_divide(bad, F.col("n")).alias("fraction"), (F.lit(False) if muted is None else F.coalesce(muted, F.lit(False))).alias("muted"))


def outside_labels(features: DataFrame, group: Sequence[str], channel: str, similarity: str = "similarity", label: str = "label", drop: float = 0.3, reach: int = 2) -> DataFrame:
    """G17, label 3: the unbroken run of channels up to the last one whose similarity, as the median over ``reach`` channels
    on either side, lies more than ``drop`` below the group's median.  Only such a run is outside; a bad stretch with good
    channels above it keeps its labels."""
    own = Window.partitionBy(*group).orderBy(channel)
    mid = features.groupBy(*group).agg(F.median(similarity).alias("_mid"))
    x = features.join(mid, list(group)).withColumn("_smooth", F.array_sort(F.collect_list(similarity).over(own.rowsBetween(-reach, reach))))
    size = F.size("_smooth")
    smooth = (F.get("_smooth", F.floor((size - 1) / 2).cast("int")) + F.get("_smooth", F.floor(size / 2).cast("int"))) / 2
    x = x.withColumn("_low", F.coalesce(smooth < F.col("_mid") - drop, F.lit(False)))
    above = Window.partitionBy(*group).orderBy(F.col(channel).desc()).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_run", F.min("_low").over(above))
    return x.withColumn(label, F.when(F.col("_run"), 3).otherwise(F.col(label))).drop("_mid", "_smooth", "_low", "_run")


def neighbour_correlation(df: DataFrame, keys: Sequence[str], channel: str, i: str, v: str, reach: int, lags: int = 0) -> DataFrame:
    """Per channel the largest correlation with a channel at most ``reach`` away, over shifts of up to ``lags`` samples;
    null for a channel without neighbours or spread."""
    a = df.select(*keys, F.col(channel).alias("channel"), F.col(i).alias("_i"), F.col(v).cast("double").alias("_a"))
    steps = [(d, k) for d in range(-reach, reach + 1) if d for k in range(-lags, lags + 1)]
    near = a.select("*", F.inline(F.array(*(F.struct(F.lit(d).alias("_d"), F.lit(k).alias("_k")) for d, k in steps))))
    near = near.withColumns({"_c": F.col("channel") + F.col("_d"), "_j": F.col("_i") + F.col("_k")})
    b = df.select(*keys, F.col(channel).alias("_c"), F.col(i).alias("_j"), F.col(v).cast("double").alias("_b"))
    pairs = near.join(b, [*keys, "_c", "_j"]).groupBy(*keys, "channel", "_d", "_k")
    best = pairs.agg(correlation("_a", "_b").alias("_r")).groupBy(*keys, "channel").agg(F.max("_r").alias("correlation"))
    return a.select(*keys, "channel").distinct().join(best, [*keys, "channel"], "left")


def separate(found: DataFrame, keys: Sequence[str], channel: str, i: str, v: str, reach: int, dead: int) -> DataFrame:
    """Without the events that have a deeper one (at a tie, of lower channel, then earlier) within ``reach`` channels and
    ``dead`` samples.  Deeper ones are spread over the buckets of time and channels in which what they suppress lies."""
    width, high = dead + 1, reach + 1
    o = found.select(*(F.col(k).alias(f"_o{n}") for n, k in enumerate(keys)), F.struct(F.col(v).alias("v"), F.col(channel).alias("c"), F.col(i).alias("i")).alias("_o"))
    o = o.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_o.i") - dead) / width), F.floor((F.col("_o.i") + dead) / width))))
    o = o.withColumn("_d", F.explode(F.sequence(F.floor((F.col("_o.c") - reach) / high), F.floor((F.col("_o.c") + reach) / high))))
    on = (F.floor(F.col(i) / width) == F.col("_b")) & (F.floor(F.col(channel) / high) == F.col("_d")) & (F.abs(F.col("_o.c") - F.col(channel)) <= reach) & (F.abs(F.col("_o.i") - F.col(i)) <= dead)
    on = on & (F.col("_o") < F.struct(F.col(v).alias("v"), F.col(channel).alias("c"), F.col(i).alias("i")))
    for n, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_o{n}"))
    return found.join(o, on, "left_anti")


def cutouts(events: DataFrame, signal: DataFrame, keys: Sequence[str], event: Sequence[str], at: str, lo: int, hi: int, few: int = 0) -> DataFrame:
    """Per event (``event``: what tells it apart) its ``waveform``, the signal (keys, ``i``, ``v``) from ``at`` + lo to
    ``at`` + hi in order.  Events whose window leaves the signal or meets a gap are dropped.  A window is cut once for all
    events at its place, from a block of the signal that holds it whole.  Of a signal of up to ``few`` rows in all the windows
    of every place are broadcast, so that events stay where they are; a longer one has those of the events' places."""
    n = hi - lo + 1
    known = signal.select(*keys, F.col("i").cast("long").alias("i"), "v").filter(F.col("v").isNotNull())
    own = F.floor(F.col("i") / n)
    blocks = known.select(*keys, F.explode(F.array(own - 1, own)).alias("_b"), F.struct("i", "v").alias("_s")).groupBy(*keys, "_b").agg(F.array_sort(F.collect_list("_s")).alias("_s"))
    small = few > 0 and known.count() <= few
    places = (known.select(*keys, (F.col("i") - lo).alias("_at")) if small else events.select(*keys, F.col(at).cast("long").alias("_at"))).distinct()
    first = F.col("_at") + lo
    cut = places.withColumn("_b", F.floor(first / n)).join(blocks, [*keys, "_b"])
    cut = cut.select(*keys, "_at", F.filter("_s", lambda x: x["i"].between(first, first + n - 1)).alias("_w")).filter(F.size("_w") == n)
    cut = cut.select(*keys, "_at", F.transform("_w", lambda x: x["v"]).alias("waveform"))
    found = events.select(*dict.fromkeys([*keys, *event]), F.col(at).alias("_at")).join(F.broadcast(cut) if small else cut, [*keys, "_at"])
    return found.select(*dict.fromkeys([*keys, *event]), F.col("_at").alias(at), "waveform")


def mean_waveforms(cut: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Mean and number per unit and sample of the cut-out; sums combine before the shuffle."""
    return cut.select(*unit, F.posexplode("waveform").alias("sample", "v")).groupBy(*unit, "sample").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
