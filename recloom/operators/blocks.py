"""Filters over recordings of any length: blocks of samples with all their channels, and the halo that a filter reaches.

Rows are samples: keys, ``i`` (from 0), ``n`` (samples of the recording) and ``x`` (an array over channels).  A sample goes to the
block that holds it and to those whose halo it lies in, so that a task works on one block of bounded size and gives what the
whole recording would.  Beyond the ends a signal goes on by odd reflection (twice the end less the mirrored sample; a halo
longer than the recording stays at its far end); a missing sample counts as zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recloom.functions import kernels
from recloom.operators.qc import quantiles
from recloom.operators.spikes import outside_labels


def extended(i: np.ndarray, x: np.ndarray, n: int, lo: int, hi: int, halo: int) -> np.ndarray:
    """Samples lo - halo to hi + halo of a recording of ``n``, from those at places ``i``."""
    out = np.zeros((hi - lo + 2 * halo, x.shape[1]))
    at = np.arange(lo - halo, hi + halo)
    inside = (i >= lo - halo) & (i < hi + halo)
    out[i[inside] - (lo - halo)] = x[inside]
    before, after = np.flatnonzero(at < 0), np.flatnonzero(at >= n)
    if len(before):
        out[before] = 2 * out[halo - lo] - out[np.minimum(-at[before], n - 1) + halo - lo]
    if len(after):
        end = n - 1 + halo - lo
        out[after] = 2 * out[end] - out[np.maximum(2 * (n - 1) - at[after], 0) + halo - lo]
    return out


def blocked(rows: DataFrame, keys: Sequence[str], size: int, halo: int, work: Callable[[np.ndarray, int, int], dict], columns: Mapping[str, str], each: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``work`` of every block, as rows of keys and ``columns``.  It gets samples lo - halo to hi + halo, lo and hi, and gives a list
    or array per column; a column of type ``array<double>`` is a matrix.  ``each`` is done to single samples before they go on
    beyond the ends."""
    if halo < 0 or size < 1:
        raise ValueError(f"no blocks of {size} samples with a halo of {halo}")
    kinds = dict(rows.dtypes)
    first = F.greatest(F.floor((F.col("i") - halo) / size), F.lit(0))
    last = F.least(F.floor((F.col("i") + halo) / size), F.floor((F.col("n") - 1) / size))
    spread = rows.select(*keys, F.col("i").cast("long").alias("i"), F.col("n").cast("long").alias("n"), F.transform("x", lambda v: v.cast("double")).alias("x"), F.explode(F.sequence(first, last)).alias("_b"))
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}

    def run(t: pa.Table) -> pa.Table:
        i, n, b = t.column("i").to_numpy(), t.column("n")[0].as_py(), t.column("_b")[0].as_py()
        x = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(i), -1)
        x = x if each is None else each(x)
        lo, hi = b * size, min(n, (b + 1) * size)
        got = work(extended(i, x, n, lo, hi, halo), lo, hi)
        length = len(next(iter(got.values())))
        own = [t.column(k).slice(0, 1).combine_chunks().take(pa.array(np.zeros(length, np.int64))) for k in keys]
        return pa.Table.from_arrays([*own, *(pa.array(list(got[c]), types[k]) for c, k in columns.items())], names=[*keys, *columns])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{c} {k}" for c, k in columns.items())])
    return spread.groupBy(*keys, "_b").applyInArrow(run, schema)


def referenced(x: np.ndarray, good: Sequence[int] | None = None) -> np.ndarray:
    """Less the median over channels (``good`` ones only) of each sample."""
    return x - np.median(x if good is None else x[:, good], axis=1, keepdims=True)


def low_pass_taps(q: int, reach: int = 14) -> np.ndarray:
    """A sinc with its half gain at 0.4 / q of the rate under a Blackman window of ``reach`` * q samples on either side; gains add
    up to 1.  From the new Nyquist rate, 0.5 / q, on under a thousandth is left."""
    k = np.arange(-reach * q, reach * q + 1)
    half = reach * q + 1
    h = np.sinc(0.8 * k / q) * (0.42 + 0.5 * np.cos(np.pi * k / half) + 0.08 * np.cos(2 * np.pi * k / half))
    return h / h.sum()


def decimated(rows: DataFrame, keys: Sequence[str], q: int, size: int = 15_000, reference: bool = True, good: Sequence[int] | None = None) -> DataFrame:
    """The common reference taken off each sample, a finite low-pass, and every q-th sample: keys, ``i`` (place among these)
    and ``x``.  Sample 0 is kept, so blocks agree whatever their size."""
    h = low_pass_taps(q)
    halo = len(h) // 2

    def work(x: np.ndarray, lo: int, hi: int) -> dict:
        at = np.arange(-(-lo // q) * q, hi, q)
        y = np.zeros((len(at), x.shape[1]))
        for k, weight in enumerate(h):
            y += weight * x[at - lo + k]
        return {"i": at // q, "x": y}

    return blocked(rows, keys, size, halo, work, {"i": "long", "x": "array<double>"}, (lambda x: referenced(x, good)) if reference else None)


def reach_of(fs: float, band: tuple[float, float], order: int = 4) -> int:
    """Samples after which a Butterworth band-pass has decayed by 1e-11, by its slowest pole."""
    half, centre = np.pi * (band[1] - band[0]), 2 * np.pi * np.sqrt(band[0] * band[1])
    low = half * np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    poles = np.concatenate([low + np.sqrt(low**2 - centre**2 + 0j), low - np.sqrt(low**2 - centre**2 + 0j)])
    return int(np.ceil(fs * np.log(1e11) / np.abs(poles.real).min()))


def band_amplitudes(rows: DataFrame, keys: Sequence[str], fs: float, bands: Mapping[str, tuple[float, float]] = kernels.BANDS, size: int = 15_000) -> DataFrame:
    """Keys, ``band``, ``i`` and ``x``, the Hilbert amplitude of each channel in each band."""
    halo = max(reach_of(fs, b) for b in bands.values())

    def work(x: np.ndarray, lo: int, hi: int) -> dict:
        n, spectrum = len(x), np.fft.rfft(x, axis=0)
        out = []
        for band in bands.values():
            half = np.zeros((n, x.shape[1]), complex)
            half[: len(spectrum)] = 2 * spectrum * kernels.band_gain(n, fs, band)[:, None]
            half[0] /= 2
            if n % 2 == 0:
                half[n // 2] /= 2
            out.append(np.abs(np.fft.ifft(half, axis=0))[halo : halo + hi - lo])
        return {"band": np.repeat(list(bands), hi - lo), "i": np.tile(np.arange(lo, hi), len(bands)), "x": np.concatenate(out)}

    return blocked(rows, keys, size, halo, work, {"band": "string", "i": "long", "x": "array<double>"})


def log_envelopes(amplitudes: DataFrame, keys: Sequence[str], floor: float = 1e-6) -> DataFrame:
    """Natural log of the amplitudes, which are raised by ``floor`` times their channel's exact median over the recording."""
    long = amplitudes.select(*keys, "band", F.posexplode("x").alias("channel", "v"))
    mid = quantiles(long, [*keys, "band", "channel"], "v", [0.5]).groupBy(*keys, "band")
    mid = mid.agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", F.col("q")[0].alias("m")))), lambda s: s["m"]).alias("_m"))
    x = amplitudes.join(mid, [*keys, "band"])
    return x.select(*keys, "band", "i", F.zip_with("x", "_m", lambda a, m: F.ln(a + floor * m + float(np.finfo(float).tiny))).alias("x"))


def channel_features(rows: DataFrame, keys: Sequence[str], fs: float, size: int, reach: int = 4, window: int = 256) -> DataFrame:
    """Per chunk of ``size`` samples and channel ``similarity``, the correlation with the median of the channels up to
    ``reach`` away, ``coherence`` with it, the mean over frequencies of Welch windows by that median's power, and ``high``, the
    mean power over 0.8 of the Nyquist rate.  A chunk that is under two windows long, as the last may be, is left out unless it is the only one."""

    def work(x: np.ndarray, lo: int, hi: int) -> dict:
        if lo and hi - lo < 2 * window:
            return {"chunk": [], "channel": [], "similarity": [], "coherence": [], "high": []}
        x = x - x.mean(0)
        nc, w = x.shape[1], min(window, len(x))
        near = np.stack([np.median(x[:, [d for d in range(max(0, c - reach), min(nc, c + reach + 1)) if d != c]], axis=1) if nc > 1 else np.zeros(len(x)) for c in range(nc)], 1)
        spread = np.sqrt((x**2).sum(0) * (near**2).sum(0))
        similarity = np.where(spread > 0, (x * near).sum(0) / np.where(spread > 0, spread, 1), 0.0)
        at = np.arange(0, len(x) - w + 1, max(1, w // 2))
        hann = np.hanning(w)[:, None]
        cut = lambda v: np.fft.rfft((v[at[:, None] + np.arange(w)] - v[at[:, None] + np.arange(w)].mean(1, keepdims=True)) * hann, axis=1)
        a, b = cut(x), cut(near)
        power, other, cross = (np.abs(a) ** 2).mean(0), (np.abs(b) ** 2).mean(0), (a * b.conj()).mean(0)
        both = power * other
        coherence = np.where(both > 0, np.abs(cross) ** 2 / np.where(both > 0, both, 1), 0.0)
        coherence = (coherence * other).sum(0) / np.maximum(other.sum(0), 1e-300)
        high = power[np.fft.rfftfreq(w, 1 / fs) >= 0.4 * fs].mean(0) / (fs * (hann**2).sum())
        return {"chunk": [lo // size] * nc, "channel": range(nc), "similarity": similarity, "coherence": coherence, "high": high}

    return blocked(rows, keys, size, 0, work, {"chunk": "int", "channel": "int", "similarity": "double", "coherence": "double", "high": "double"})


def chunk_labels(features: DataFrame, keys: Sequence[str], dead: float = 0.3, noisy: float = 4.0, drop: float = 0.3) -> DataFrame:
    """``label`` of each channel in each chunk: 3 outside, of the unbroken run at the end whose coherence is ``drop`` under the
    chunk's median; 2 noisy, with over ``noisy`` times the chunk's median power at high frequencies; 1 dead, whose similarity is
    under ``dead``; else 0."""
    mid = features.groupBy(*keys, "chunk").agg(F.median("high").alias("_high"))
    x = features.join(mid, [*keys, "chunk"])
    x = x.withColumn("label", F.when(F.col("high") > noisy * F.col("_high"), 2).when(F.col("similarity") < dead, 1).otherwise(0)).drop("_high")
    return outside_labels(x, [*keys, "chunk"], "channel", "coherence", drop=drop)


def csd_power(rows: DataFrame, keys: Sequence[str], q: int, h: float, size: int = 15_000) -> DataFrame:
    """Per channel the mean square of the second difference over depth of the signal, low-passed and thinned by ``q``; none for
    the channels at either end."""
    low = decimated(rows, keys, q, size, reference=False).select(*keys, F.col("x").alias("_x"))
    inner = F.sequence(F.lit(1), F.size("_x") - 2)
    at = lambda c, d: F.get("_x", c + d)
    cells = low.filter(F.size("_x") > 2).select(*keys, F.explode(F.transform(inner, lambda c: F.struct(c.alias("channel"), ((at(c, 1) - 2 * at(c, 0) + at(c, -1)) / (h * h)).alias("v")))).alias("_s"))
    return cells.groupBy(*keys, F.col("_s.channel").alias("channel")).agg(F.avg(F.col("_s.v") * F.col("_s.v")).alias("csd_power"))
