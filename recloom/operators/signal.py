"""Regular and irregular signals: grids, resampling, references, bad channels, spectra."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recloom.functions import kernels


def event_to_grid(events: DataFrame, grid: DataFrame, keys: Sequence[str], time: str, weight: str, t0: float, dt: float) -> DataFrame:
    """Each event adds its weight to the first sample at or after it; events outside land on the edge samples."""
    span = grid.groupBy(*keys).agg(F.min("i").alias("_a"), F.max("i").alias("_b"))
    at = F.least(F.greatest(F.ceil((F.col(time) - t0) / dt), F.col("_a")), F.col("_b"))
    hit = events.filter(F.col(time).isNotNull()).join(span, list(keys)).groupBy(*keys, at.alias("i")).agg(F.sum(weight).alias("w"))
    return grid.join(hit, [*keys, "i"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def _running(df: DataFrame, keys: Sequence[str], value: str, up: bool) -> Column:
    """Largest (``up``: of the buckets before, else smallest of those after) ``value`` per key over the rows of ``_b``."""
    order = F.col("_b").asc() if up else F.col("_b").desc()
    own = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (F.max if up else F.min)(value).over(own)


def as_of_next(events: DataFrame, grid: DataFrame, keys: Sequence[str], time: str, width: float | None = None) -> DataFrame:
    """J9 on an irregular grid (``keys``, ``i``, ``t``): union of both sides and the next grid row, no nested loop; events
    after the last sample take the last.  With ``width``, a key's time is cut into buckets of it that are sorted apart; what
    lies beyond a bucket's end comes from one row per bucket."""
    both = events.select(*keys, F.col(time).alias("t"), F.lit(None).cast("long").alias("i"), F.lit(0).alias("_o"), F.struct(*[c for c in events.columns if c not in keys]).alias("_e"))
    kind = both.schema["_e"].dataType
    both = both.unionByName(grid.select(*keys, "t", F.col("i").cast("long").alias("i"), F.lit(1).alias("_o"), F.lit(None).cast(kind).alias("_e")))
    both = both.withColumn("_b", F.lit(0).cast("long") if width is None else F.floor(F.col("t") / width))
    edges = both.groupBy(*keys, "_b").agg(F.min(F.when(F.col("i").isNotNull(), F.struct("t", "i"))).alias("_lo"), F.max("i").alias("_hi"))
    edges = edges.withColumn("_after", _running(edges, keys, "_lo", False)).withColumn("_last", F.max("_hi").over(Window.partitionBy(*keys)))
    # backwards in time, so that the frame only ever grows and each row is looked at once
    own = Window.partitionBy(*keys, "_b").orderBy(F.col("t").desc(), F.col("_o").desc()).rowsBetween(Window.unboundedPreceding, 0)
    x = both.withColumn("_next", F.last("i", ignorenulls=True).over(own)).filter("_o = 0")
    x = x.join(edges.select(*keys, "_b", F.col("_after.i").alias("_after"), "_last"), [*keys, "_b"], "left")
    return x.select(*keys, "_e.*", F.coalesce("_next", "_after", "_last").alias("i"))


def resample(samples: DataFrame, grid: DataFrame, keys: Sequence[str], width: float | None = None) -> DataFrame:
    """Linear interpolation of (``t``, ``v``) at the grid's ``t``; missing values are left out, ends held.  With ``width``,
    a key's time is cut into buckets of it that are sorted apart; neighbours beyond a bucket come from one row per bucket."""
    good = samples.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    none = F.lit(None).cast("struct<t:double,v:double>")
    both = good.select(*keys, F.col("t").cast("double").alias("t"), F.struct(F.col("t").cast("double").alias("t"), F.col("v").cast("double").alias("v")).alias("s"), F.lit(None).cast("long").alias("i"), F.lit(0).alias("_o"))
    both = both.unionByName(grid.select(*keys, F.col("t").cast("double").alias("t"), none.alias("s"), F.col("i").cast("long").alias("i"), F.lit(1).alias("_o")))
    both = both.withColumn("_b", F.lit(0).cast("long") if width is None else F.floor(F.col("t") / width))
    edges = both.groupBy(*keys, "_b").agg(F.min("s").alias("_lo"), F.max("s").alias("_hi"))
    edges = edges.select(*keys, "_b", _running(edges, keys, "_hi", True).alias("_before"), _running(edges, keys, "_lo", False).alias("_after"))
    own = Window.partitionBy(*keys, "_b")
    grow = lambda *order: F.last("s", ignorenulls=True).over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    x = both.select(*keys, "_b", "i", "t", "_o", grow("t", "_o").alias("p"), grow(F.col("t").desc(), "_o").alias("q")).filter("_o = 1").join(edges, [*keys, "_b"])
    x = x.select(*keys, "i", "t", F.coalesce("p", "_before").alias("p"), F.coalesce("q", "_after").alias("q"))
    v = F.when(F.col("q.t") == F.col("p.t"), F.col("p.v")).otherwise(F.col("p.v") + (F.col("q.v") - F.col("p.v")) * (F.col("t") - F.col("p.t")) / (F.col("q.t") - F.col("p.t")))
    return x.select(*keys, "i", "t", F.coalesce(v, "p.v", "q.v").alias("v"))


def coverage(source: DataFrame, grid: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Share of the grid's span that the source spans; 0 for an empty source or grid."""
    side = lambda d, a: d.groupBy(*keys).agg(F.min(time).alias(f"{a}0"), F.max(time).alias(f"{a}1"))
    x = side(grid, "g").join(side(source, "s"), list(keys), "left")
    both = F.greatest(F.lit(0.0), F.least("g1", "s1") - F.greatest("g0", "s0"))
    return x.select(*keys, F.coalesce(F.when((F.col("g1") > F.col("g0")) & F.col("s0").isNotNull(), both / (F.col("g1") - F.col("g0"))), F.lit(0.0)).alias("coverage"))


def zscore(df: DataFrame, keys: Sequence[str], v: str) -> DataFrame:
    """Population z-score per key; only centred where the deviation is 0."""
    s = df.groupBy(*keys).agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"))
    return df.join(s, list(keys)).withColumn("z", F.when(F.col("_s") > 0, (F.col(v) - F.col("_m")) / F.col("_s")).otherwise(F.col(v) - F.col("_m"))).drop("_m", "_s")


def detrend(df: DataFrame, keys: Sequence[str], i: str, v: str) -> DataFrame:
    """Residual of a straight line per key."""
    s = df.groupBy(*keys).agg(F.regr_slope(v, i).alias("_b"), F.regr_intercept(v, i).alias("_a"))
    return df.join(s, list(keys)).withColumn("residual", F.col(v) - F.coalesce(F.col("_a") + F.col("_b") * F.col(i), F.col(v))).drop("_a", "_b")


def channel_bins(df: DataFrame, keys: Sequence[str], channel: str, v: str, n_channels: int, n_out: int) -> DataFrame:
    """G1: sum of neighbouring channels; those at the end that fill no group are dropped."""
    group = n_channels // n_out
    return df.filter(F.col(channel) < n_out * group).groupBy(*keys, F.floor(F.col(channel) / group).alias("bin")).agg(F.sum(v).alias("v"))


def car(df: DataFrame, sample: Sequence[str], channel: str, v: str, bad: DataFrame | None = None, scale: float = 1.0, power: float = 1.0) -> DataFrame:
    """Minus the median of the good channels of the sample.  ``bad`` (channel): replaced before that by the mean of the
    others with weights exp(-(distance / scale) ** power), distance in channels; within 8 channels, so the join has equality
    keys and bounded fan-out."""
    x = df.withColumnRenamed(v, "v").withColumnRenamed(channel, "channel")
    if bad is not None:
        good = x.join(bad.withColumnRenamed(channel, "channel"), "channel", "left_anti")
        near = x.join(bad.withColumnRenamed(channel, "channel"), "channel", "left_semi").select(*sample, F.col("channel").alias("target"), F.explode(F.array([F.lit(k) for k in range(-8, 9) if k])).alias("d")).withColumn("channel", F.col("target") + F.col("d"))
        w = F.exp(-F.pow(F.abs("d") / scale, F.lit(power)))
        fixed = near.join(good, [*sample, "channel"]).groupBy(*sample, F.col("target").alias("channel")).agg((F.sum(w * F.col("v")) / F.sum(w)).alias("v"))
        x = good.select(*sample, "channel", "v").unionByName(fixed.select(*sample, "channel", "v"))
        ref = good.groupBy(*sample).agg(F.median("v").alias("_m"))
    else:
        ref = x.groupBy(*sample).agg(F.median("v").alias("_m"))
    return x.join(ref, list(sample)).withColumn("v", F.col("v") - F.col("_m")).drop("_m")


def csd(df: DataFrame, sample: Sequence[str], depth: str, v: str, h: float) -> DataFrame:
    """Minus the second difference over depth; null at the ends."""
    own = Window.partitionBy(*sample).orderBy(depth)
    return df.withColumn("csd", -(F.lead(v).over(own) - 2 * F.col(v) + F.lag(v).over(own)) / (h * h))


def rms(df: DataFrame, keys: Sequence[str], v: str) -> DataFrame:
    """G23."""
    return df.groupBy(*keys).agg(F.sqrt(F.avg(F.col(v) * F.col(v))).alias("rms"))


def islands(df: DataFrame, keys: Sequence[str], i: str, flag: Column) -> DataFrame:
    """Maximal runs of flagged samples as half-open intervals."""
    x = df.filter(flag).withColumn("_g", F.col(i) - F.row_number().over(Window.partitionBy(*keys).orderBy(i)))
    return x.groupBy(*keys, "_g").agg(F.min(i).alias("start"), (F.max(i) + 1).alias("end")).drop("_g")


def saturated_samples(df: DataFrame, keys: Sequence[str], i: str, v: str, limit: float, share: float) -> DataFrame:
    """Whether the share of channels at or over ``limit`` exceeds ``share``, per sample."""
    return df.groupBy(*keys, i).agg((F.count_if(F.abs(v) >= limit) / F.count("*") > share).alias("saturated"))


def overlapping(events: DataFrame, spans: DataFrame, keys: Sequence[str], t: str, lo: float, hi: float, width: float, how: str = "left_anti") -> DataFrame:
    """Events whose window (t + lo, t + hi) overlaps an interval (``start``, ``end``) go (or stay, with left_semi).  An
    interval is spread over the buckets of ``width`` in which the times of such events lie, so the join has an equality key
    and an event one bucket.  Events without a time overlap nothing; null columns and keys and repeated rows make no difference."""
    buckets = F.sequence(F.floor((F.col("start") - hi) / width), F.floor((F.col("end") - lo) / width))
    s = spans.select(*(F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)), "start", "end", F.explode(buckets).alias("_b"))
    s = s.withColumnsRenamed({"start": "_start", "end": "_end"})
    on = (F.floor(F.col(t) / width) == F.col("_b")) & (F.col("_start") < F.col(t) + hi) & (F.col("_end") > F.col(t) + lo)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_s{i}"))
    return events.join(s, on, how)


def muted(df: DataFrame, spans: DataFrame, keys: Sequence[str], i: str, v: str) -> DataFrame:
    """Samples inside half-open intervals become 0."""
    bad = spans.select(*keys, F.explode(F.sequence("start", F.col("end") - 1)).alias(i)).distinct().withColumn("_mute", F.lit(True))
    return df.join(bad, [*keys, i], "left").withColumn(v, F.when(F.col("_mute"), F.lit(0.0)).otherwise(F.col(v))).drop("_mute")


def masked(df: DataFrame, v: str, quality: str, least: float) -> DataFrame:
    """Values of low quality are blanked."""
    return df.withColumn(v, F.when(F.col(quality) >= least, F.col(v)))


def sync_affine(df: DataFrame, keys: Sequence[str], sample: str, t: str, limit: float) -> DataFrame:
    """Slope and intercept of time on sample number, rate, worst residual and whether it is under the limit."""
    fit = df.groupBy(*keys).agg(F.regr_slope(t, sample).alias("slope"), F.regr_intercept(t, sample).alias("intercept"))
    x = df.join(fit, list(keys)).groupBy(*keys, "slope", "intercept").agg(F.max(F.abs(F.col(t) - F.col("intercept") - F.col("slope") * F.col(sample))).alias("worst"))
    return x.withColumn("fs", F.try_divide(F.lit(1.0), F.col("slope"))).withColumn("ok", F.col("worst") < limit)


def geometry_check(stored: DataFrame, computed: DataFrame, keys: Sequence[str], axes: Sequence[str], tolerance: float) -> DataFrame:
    """Worst difference per recording and its status: changed, unchanged, no-map (no computed positions), skip
    (no stored ones)."""
    j = stored.join(computed.select(*keys, *(F.col(a).alias(f"_{a}") for a in axes)), list(keys), "left")
    worst = F.max(F.greatest(*(F.abs(F.col(a) - F.col(f"_{a}")) for a in axes))) if len(axes) > 1 else F.max(F.abs(F.col(axes[0]) - F.col(f"_{axes[0]}")))
    stored_any = F.max(F.coalesce(*(F.when(F.col(a).isNotNull(), 1) for a in axes)))
    x = j.groupBy(keys[0]).agg(worst.alias("dmax"), stored_any.alias("_any"))
    return x.withColumn("status", F.when(F.col("_any").isNull(), "skip").when(F.col("dmax").isNull(), "no-map").when(F.col("dmax") > tolerance, "changed").otherwise("unchanged")).drop("_any")


def chunks_of(df: DataFrame, keys: Sequence[str], i: str, v: str) -> DataFrame:
    """One row per key with its samples in order, as arrays; for keys of bounded length."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(i, v))).alias("_s")).select(*keys, F.transform("_s", lambda x: x[i]).alias("i"), F.transform("_s", lambda x: x[v]).alias("v"))


def _kinds(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{k}` {kinds[k]}, " for k in keys)


def band_envelopes(df: DataFrame, keys: Sequence[str], v: str, fs: float, bands: dict[str, tuple[float, float]] = kernels.BANDS) -> DataFrame:
    """G2 over rows that each hold one channel's samples as an array: one row per band."""
    def run(frames):
        for f in frames:
            rows = [[*(getattr(r, k) for k in keys), b, kernels.envelope(np.asarray(getattr(r, v), float), fs, w).tolist()] for r in f.itertuples(index=False) for b, w in bands.items()]
            yield pd.DataFrame(rows, columns=[*keys, "band", "envelope"])

    return df.select(*keys, v).mapInPandas(run, _kinds(df, keys) + "band string, envelope array<double>")


def band_powers(df: DataFrame, keys: Sequence[str], v: str, fs: float, size: int, bands: dict[str, tuple[float, float]] = kernels.BANDS) -> DataFrame:
    """Mean Welch power per band, in dB."""
    def run(frames):
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                fr, p = kernels.welch(np.asarray(getattr(r, v), float), fs, size)
                for b, (lo, hi) in bands.items():
                    x = p[(fr >= lo) & (fr < hi)]
                    rows.append([*(getattr(r, k) for k in keys), b, float(10 * np.log10(x.mean() + 1e-300)) if len(x) else None])
            yield pd.DataFrame(rows, columns=[*keys, "band", "db"])

    return df.select(*keys, v).mapInPandas(run, _kinds(df, keys) + "band string, db double")


def spectrogram(df: DataFrame, keys: Sequence[str], v: str, fs: float, size: int, threshold: float) -> DataFrame:
    """Total power of each half-overlapping Hann window, and whether it rises over the threshold there."""
    def run(frames):
        for f in frames:
            rows = []
            for own, x in zip(f[list(keys)].itertuples(index=False), f[v], strict=True):
                x = np.asarray(x, float)
                power = kernels.window_powers(x, fs, size)[1].sum(1) if len(x) >= size else np.zeros(0)
                over = power > threshold
                rows += [[*own, k, float(p), bool(up)] for k, (p, up) in enumerate(zip(power, over & ~np.concatenate(([False], over[:-1])), strict=True))]
            yield pd.DataFrame(rows, columns=[*keys, "window", "power", "detected"])

    return df.select(*keys, v).mapInPandas(run, _kinds(df, keys) + "window int, power double, detected boolean")


def label_mode(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """The label that most chunks give; the smaller at a tie."""
    n = df.groupBy(*keys, label).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.max_by(label, F.struct("_n", -F.col(label))).alias(label))


def sample_vectors(df: DataFrame, chunk: Sequence[str], i: str, channel: str, v: str) -> DataFrame:
    """Long rows to one row per sample: ``c`` (its channels in order) and ``x`` (their values); missing values are left out."""
    own = df.filter(F.col(v).isNotNull()).groupBy(*chunk, i).agg(F.array_sort(F.collect_list(F.struct(F.col(channel).alias("c"), F.col(v).alias("v")))).alias("s"))
    return own.select(*chunk, F.col("s.c").alias("c"), F.col("s.v").alias("x"))


def gram_packs(vectors: DataFrame, chunk: Sequence[str], held: int = 32 << 20) -> DataFrame:
    """Partial sums of the channels' Gram matrix: chunk, ``c`` (the channels), ``n`` (samples) and ``g``, the upper triangle
    row by row.  ``vectors``: chunk, ``c``, ``x`` (an array per sample, channels in the order of ``c``; null or empty samples
    count for nothing).  A task multiplies the samples of a batch block by block and adds up what belongs to one chunk and
    set of channels, so that it hands on some matrices, not rows per pair and sample; it holds ``held`` bytes of them."""
    kinds, keys = dict(vectors.dtypes), [*chunk, "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        size = 0

        def packed() -> pa.RecordBatch:
            own = list(sums.values())
            tri = [g[np.triu_indices(len(g))] for _, _, g in own]
            columns = [pa.concat_arrays([first[k] for first, _, _ in own]) for k in range(len(keys))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n, _ in own], pa.int64()), pa.array(tri, pa.list_(pa.float64()))], names=[*keys, "n", "g"])

        for b in batches:
            b = b.filter(pc.greater(pc.fill_null(pc.list_value_length(b.column("x")), 0), 0))
            x, length = b.column("x"), pc.list_value_length(b.column("x")).to_numpy(zero_copy_only=False)
            c = b.column("c")
            alike = b.num_rows and len(c.flatten()) == b.num_rows * len(c[0]) and c[0] == c[-1] and (c.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) == np.array(c[0].as_py())).all()
            sets = [tuple(c[0].as_py())] * b.num_rows if alike else map(tuple, c.to_pylist())
            names = list(zip(*(b.column(k).to_pylist() for k in chunk), sets, strict=True))
            own: dict[tuple, list[int]] = {}
            for at, name in enumerate(names):
                own.setdefault(name, []).append(at)
            flat, ends = x.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(length)))
            for name, rows in own.items():
                nc, at = len(name[-1]), np.array(rows)
                if (length[at] != nc).any():
                    raise ValueError(f"samples of another length than their {nc} channels")
                block = flat[ends[at][:, None] + np.arange(nc)].astype(float)
                if name not in sums:
                    sums[name] = [[b.column(k).slice(rows[0], 1) for k in keys], 0, np.zeros((nc, nc))]
                    size += 8 * nc * nc
                sums[name][1] += len(rows)
                sums[name][2] += block.T @ block
                if size > held:
                    yield packed()
                    sums.clear()
                    size = 0
        if sums:
            yield packed()

    return vectors.select(*keys, "x").mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n long, g array<double>")


def channel_gram(packs: DataFrame, chunk: Sequence[str]) -> DataFrame:
    """Upper triangle of the channels' Gram matrix per chunk: ``a``, ``b``, ``g`` and ``n``, the samples that have both."""
    pair = F.expr("flatten(transform(c, (a, k) -> transform(slice(c, k + 1, size(c)), b -> struct(a as a, b as b))))")
    cells = packs.select(*chunk, "n", F.explode(F.arrays_zip(pair.alias("p"), F.col("g"))).alias("_p")).select(*chunk, "n", F.col("_p.p.a").alias("a"), F.col("_p.p.b").alias("b"), F.col("_p.g").alias("g"))
    return cells.groupBy(*chunk, "a", "b").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))


def low_rank_report(packs: DataFrame, chunk: Sequence[str], keep: float) -> DataFrame:
    """Kept rank (eigenvalues over ``keep`` times the largest), compression ratio and RMSE of the rest, per chunk, from
    ``gram_packs``.  A group of the numpy step is the packs of one chunk: a matrix of nc x nc per task that had samples."""
    kinds = dict(packs.dtypes)

    def run(t: pa.Table) -> pa.Table:
        sets = [np.array(c) for c in t.column("c").to_pylist()]
        channels, ns = np.unique(np.concatenate(sets)), t.column("n").to_numpy()
        g = np.zeros((len(channels),) * 2)
        for c, tri in zip(sets, t.column("g"), strict=True):
            at, (i, j) = np.searchsorted(channels, c), np.triu_indices(len(c))
            np.add.at(g, (at[i], at[j]), tri.values.to_numpy(zero_copy_only=False))
        w = np.linalg.eigvalsh(np.triu(g) + np.triu(g, 1).T)[::-1].clip(0)
        r, n, nc = max(1, int((w > keep * w[0]).sum())), int(ns.sum()), len(channels)
        numbers = {"nc": nc, "ns": n, "rank": r, "ratio": nc * n / (r * (nc + n)), "rmse": float(np.sqrt(w[r:].sum() / (n * nc))), "kept": float(w[:r].sum()), "total": float(w.sum())}
        return pa.table({k: t.column(k).slice(0, 1) for k in chunk} | {k: [v] for k, v in numbers.items()})

    return packs.groupBy(*chunk).applyInArrow(run, "".join(f"`{k}` {kinds[k]}, " for k in chunk) + "nc long, ns long, rank long, ratio double, rmse double, kept double, total double")


def detect_spikes(df: DataFrame, keys: Sequence[str], i: str, v: str, k: float) -> DataFrame:
    """Local minima below -k robust deviations of the channel."""
    s = df.groupBy(*keys).agg((F.median(F.abs(v)) / 0.6745).alias("_sd"))
    own = Window.partitionBy(*keys).orderBy(i)
    x = df.join(s, list(keys)).withColumn("_p", F.lag(v).over(own)).withColumn("_n", F.lead(v).over(own))
    return x.filter((F.col(v) < -k * F.col("_sd")) & (F.col(v) <= F.coalesce("_p", v)) & (F.col(v) < F.coalesce("_n", F.lit(float("inf"))))).drop("_sd", "_p", "_n")


def velocity(df: DataFrame, keys: Sequence[str], i: str, v: str, fs: float) -> DataFrame:
    """Central difference, one-sided at the ends."""
    own = Window.partitionBy(*keys).orderBy(i)
    a, b = F.coalesce(F.lag(v).over(own), F.col(v)), F.coalesce(F.lead(v).over(own), F.col(v))
    n = F.when(F.lag(i).over(own).isNull() | F.lead(i).over(own).isNull(), 1).otherwise(2)
    return df.withColumn("velocity", (b - a) * fs / n)


def waveform_features(df: DataFrame, keys: Sequence[str], v: str) -> DataFrame:
    """G4 in SQL functions: place and value of the largest sample in size (the first at a tie), the extreme of the other sign
    from there on (trough) and up to there (tip), and the whole range.  An empty array gives nulls."""
    x = df.select(*keys, F.transform(v, lambda z: z.cast("double")).alias("_w")).withColumn("_a", F.transform("_w", lambda z: F.abs(z)))
    x = x.withColumn("_k", F.array_position("_a", F.array_max("_a")).cast("int")).withColumn("peak_val", F.try_element_at("_w", F.nullif(F.col("_k"), F.lit(0))))
    at = F.greatest(F.col("_k"), F.lit(1))
    other = lambda part: F.when(F.col("peak_val") < 0, F.array_max(part)).otherwise(F.array_min(part))
    return x.select(
        *keys, (F.col("_k") - 1).alias("peak_time_idx"), "peak_val", other(F.slice("_w", at, F.size("_w"))).alias("trough_val"),
        other(F.slice("_w", F.lit(1), at)).alias("tip_val"), (F.array_max("_w") - F.array_min("_w")).alias("ptp"),
    )


def neighbours(df: DataFrame, channel: str, offsets: Sequence[int], n_channels: int, out: str = "channel") -> DataFrame:
    """Every row once per channel at an offset from its own, channels beyond either end left out; ``slot`` is the place of
    the offset in the list."""
    x = df.select("*", F.posexplode(F.array(*map(F.lit, offsets))).alias("slot", "_o")).withColumn(out, F.col(channel) + F.col("_o"))
    return x.filter((F.col(out) >= 0) & (F.col(out) < n_channels)).drop("_o")


def peak_traces(df: DataFrame, keys: Sequence[str], channel: str, v: str) -> DataFrame:
    """Per key the whole trace of the channel with the largest range, at a tie of the first channel.  The traces compete
    in a combining aggregate, so no key's channels are gathered."""
    ptp = (F.array_max(v) - F.array_min(v)).cast("double")
    best = F.max_by(F.struct(F.col(channel), F.col(v)), F.struct(ptp, -F.col(channel)))
    return df.filter(F.size(v) > 0).groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col(f"_b.{channel}").alias(channel), F.col(f"_b.{v}").alias("trace"))


def spectrum_summary(df: DataFrame, keys: Sequence[str], power: str, detected: str) -> DataFrame:
    """Per recording the mean over windows of the power that is summed over frequencies, and the number of detections.
    Rows are windows; ``power`` is an array over frequencies."""
    total = F.aggregate(power, F.lit(0.0), lambda a, z: a + F.coalesce(z.cast("double"), F.lit(0.0)))
    return df.groupBy(*keys).agg(F.avg(total).alias("power"), F.count("*").alias("n_windows"), F.count_if(detected).alias("n_detected"))


def targets(df: DataFrame, keys: Sequence[str], channel: str, v: str, kind: str, fs: float, bands: dict[str, tuple[float, float]] = kernels.BANDS) -> DataFrame:
    """Encoding targets of one schema (keys, ``kind``, ``target``, ``i``, ``y``) from rows that each hold a channel's samples
    as an array: ``raw``, the samples, one target per channel; ``band``, the log envelopes, one per channel and band.  Another
    kind is an error."""
    if kind == "raw":
        return df.select(*keys, F.lit(kind).alias("kind"), F.col(channel).cast("string").alias("target"), F.posexplode(v).alias("i", "y")).withColumn("y", F.col("y").cast("double"))
    if kind == "band":
        x = band_envelopes(df, list(dict.fromkeys([*keys, channel])), v, fs, bands)
        return x.select(*keys, F.lit(kind).alias("kind"), F.concat_ws("_", F.col(channel).cast("string"), "band").alias("target"), F.posexplode("envelope").alias("i", "y"))
    raise ValueError(f"no targets of kind {kind!r}")


def aggregate_probes(df: DataFrame, probe: str, channel: str, about: Sequence[str], features: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of one row per probe, channel and snippet three tables: channels (what is ``about`` a channel, which all its
    snippets share), features (mean and median of each over the snippets, and their number), and both merged."""
    by = df.groupBy(probe, channel)
    channels = by.agg(*(F.max(c).alias(c) for c in about))
    values = by.agg(*(x for c in features for x in (F.avg(c).alias(f"{c}_mean"), F.median(c).alias(f"{c}_median"))), F.count("*").alias("n_snippets"))
    return channels, values, channels.join(values, [probe, channel])


def uniform_trace(samples: DataFrame, keys: Sequence[str], dt: float, cut: float, size: int = 1 << 20, halo: int = 4096) -> DataFrame:
    """Irregular samples (keys, ``t``, ``v``) on a grid of step ``dt`` by linear interpolation, low-passed at ``cut`` (in
    samples a second), with the central difference of the result: keys, ``i``, ``t``, ``v``, ``velocity``.  Blocks of
    ``size`` grid samples are filtered by themselves, with ``halo`` samples on either side, so that no recording is one group.
    Only samples are shuffled: a block gets those within it and the nearest on either side, and its grid is made in the task."""
    at, kinds = F.col("t") / dt, dict(samples.dtypes)
    x = samples.select(*keys, F.col("t").cast("double").alias("t"), F.col("v").cast("double").alias("v")).filter("t is not null")
    x = x.withColumns({"_d": F.floor((at - halo) / size), "_u": F.floor((at + halo) / size), "_s": F.when(F.col("v").isNotNull() & ~F.isnan("v"), F.struct("t", "v"))})
    edges = x.groupBy(*keys, "_d", "_u").agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"), F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    ends = edges.groupBy(*keys).agg(F.ceil(F.min("_t0") / dt).alias("_a"), F.floor(F.max("_t1") / dt).alias("_z")).filter("_z >= _a")
    none = F.lit(None).cast("struct<t:double,v:double>")
    # a block's row, and a row of each edge at the last block that lies wholly before or the first wholly after it
    c = F.explode(F.sequence(F.floor(F.col("_a") / size), F.floor(F.col("_z") / size))).alias("_c")
    both = ends.select(*keys, c, "_a", "_z", none.alias("_lo"), none.alias("_hi"))
    for side, other in (("_d", "_lo"), ("_u", "_hi")):
        both = both.unionByName(edges.select(*keys, F.col(side).alias("_c"), F.col(other).alias(other)).filter(F.col(other).isNotNull()), allowMissingColumns=True)
    beyond = lambda v, f, order: f(v).over(Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, -1))
    both = both.withColumns({"_before": beyond("_hi", F.max, F.col("_c").asc()), "_after": beyond("_lo", F.min, F.col("_c").desc())}).filter("_a is not null")
    blocks = both.select(*keys, "_c", "_a", "_z", F.inline_outer(F.array_compact(F.array("_before", "_after"))))
    inside = x.filter("_s is not null").select(*keys, F.explode(F.sequence("_d", "_u")).alias("_c"), "t", "v")
    rows = blocks.unionByName(inside, allowMissingColumns=True)

    def run(f: pa.Table) -> pa.Table:
        first, last = pc.max(f.column("_a")).as_py(), pc.max(f.column("_z")).as_py()
        t, v = (f.column(k).to_numpy() for k in ("t", "v"))
        have = ~np.isnan(t)
        t, v, b = t[have], v[have], f.column("_c")[0].as_py()
        i = np.arange(0) if first is None else np.arange(max(first, b * size - halo), min(last, (b + 1) * size + halo - 1) + 1)
        order = np.lexsort((v, t))
        y = kernels.low_pass(kernels.between(t[order], v[order], i * dt), 1 / dt, cut)
        speed = np.gradient(y, dt) if len(y) > 1 else np.zeros(len(y))
        own = i // size == b
        cells = {k: pa.repeat(f.column(k)[0], int(own.sum())) for k in keys}
        return pa.table(cells | {"i": i[own].astype(np.int64), "t": (i * dt)[own], "v": pa.array(y[own], from_pandas=True), "velocity": pa.array(speed[own], from_pandas=True)})

    return rows.groupBy(*keys, "_c").applyInArrow(run, "".join(f"`{k}` {kinds[k]}, " for k in keys) + "i long, t double, v double, velocity double")
