"""Event series (spikes): intervals, correlograms, refractory quality.

Pairs of events of one unit within a window come from a bucketed range join: buckets as wide as the window, each event
looked for in its own and the next bucket, so the join has an equality key and a pair is made once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recloom.functions.numbers import correlation


def seconds(ts: Column) -> Column:
    """Timestamps as seconds since 1970, in UTC."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def intervals(df: DataFrame, unit: Sequence[str], time: str, tie: str) -> DataFrame:
    """Time since the previous event of the unit, null for its first."""
    return df.withColumn("isi", F.col(time) - F.lag(time).over(Window.partitionBy(*unit).orderBy(time, tie)))


def contaminated(df: DataFrame, units: DataFrame, unit: Sequence[str], time: str, tie: str, threshold: float) -> DataFrame:
    """Smallest interval and whether it is under the threshold: false for one event, null for a unit without any."""
    got = intervals(df, unit, time, tie).groupBy(*unit).agg(F.min("isi").alias("min_isi"), F.coalesce(F.min("isi") < threshold, F.lit(False)).alias("is_contaminated"))
    return units.join(got, list(unit), "left")


def burstiness_memory(df: DataFrame, unit: Sequence[str], time: str, tie: str, least: int = 6) -> DataFrame:
    """(sd - mean) / (sd + mean) of the intervals and the correlation of consecutive ones; null under ``least``
    events (definitions: Goh and Barabasi 2008)."""
    own = Window.partitionBy(*unit).orderBy(time, tie)
    x = intervals(df, unit, time, tie).withColumn("nxt", F.lead("isi").over(own))
    x = x.groupBy(*unit).agg(F.count("*").alias("n"), F.avg("isi").alias("m"), F.stddev_pop("isi").alias("sd"), correlation("isi", "nxt").alias("c"))
    enough = F.col("n") >= least
    return x.select(*unit, "n", F.when(enough, F.try_divide(F.col("sd") - F.col("m"), F.col("sd") + F.col("m"))).alias("burstiness"), F.when(enough & ~F.isnan("c"), F.col("c")).alias("memory"))


def pairs(df: DataFrame, unit: Sequence[str], time: str, window: float, carry: Sequence[str] = ()) -> DataFrame:
    """Ordered pairs of a unit with 0 < lag <= window: ``unit``, ``lag`` and the first event's ``carry`` columns."""
    b = F.floor(F.col(time) / window)
    first = df.select(*unit, *carry, F.col(time).alias("_t0"), F.explode(F.array(b, b + 1)).alias("_b"))
    second = df.select(*unit, F.col(time).alias("_t1"), b.alias("_b"))
    out = first.join(second, [*unit, "_b"]).withColumn("lag", F.col("_t1") - F.col("_t0"))
    return out.filter((F.col("lag") > 0) & (F.col("lag") <= window)).select(*unit, *carry, "lag")


def correlograms(df: DataFrame, unit: Sequence[str], time: str, scales: dict[str, tuple[float, float]]) -> DataFrame:
    """One-sided counts per lag bin at several (bin, window) scales, from one pass over the widest window's pairs."""
    widest = max(w for _, w in scales.values())
    tagged = F.array_compact(F.array(*(F.when(F.col("lag") <= w, F.struct(F.lit(k).alias("scale"), F.floor(F.col("lag") / b).alias("bin"))) for k, (b, w) in scales.items())))
    x = pairs(df, unit, time, widest).select(*unit, F.explode(tagged).alias("s"))
    return x.groupBy(*unit, F.col("s.scale").alias("scale"), F.col("s.bin").alias("bin")).agg(F.count("*").alias("n"))


def log_bin(lag: Column, bin_size: float, window: float, bins: int, trim: float) -> Column:
    """Log-spaced bin of a lag that was first rounded to whole base bins; null under ``trim``."""
    d = F.bround(lag / bin_size) * bin_size
    return F.when(d >= trim, F.least(F.floor(F.log(d / trim) * bins / F.log(F.lit(window / trim))), F.lit(bins - 1)))


def log_acg(df: DataFrame, unit: Sequence[str], time: str, bin_size: float, window: float, bins: int = 128, trim: float = 1e-3) -> DataFrame:
    """Raw counts of a unit's auto-correlogram in log-spaced bins (own definition of the bins)."""
    x = pairs(df, unit, time, window).select(*unit, log_bin(F.col("lag"), bin_size, window, bins, trim).alias("bin")).filter("bin is not null")
    return x.groupBy(*unit, "bin").agg(F.count("*").alias("n"))


def normalised(counts: DataFrame, totals: DataFrame, unit: Sequence[str], n: str, total: str) -> DataFrame:
    """Counts by the unit's number of events."""
    return counts.join(totals, list(unit)).withColumn("rate", F.try_divide(F.col(n), F.col(total)))


def acg_by_rate_decile(df: DataFrame, unit: Sequence[str], time: str, tie: str, half_window: float, bin_size: float, window: float, bins: int = 100, trim: float = 1e-3) -> DataFrame:
    """Local rate of each event (events of the unit within +-``half_window``), its decile in the unit, and counts by
    decile of the first event and signed log-lag bin (-bins..bins, 0 for lags under ``trim``) per event of the decile."""
    half = round(half_window * 1e6)  # a range frame takes whole numbers: microseconds
    near = F.count("*").over(Window.partitionBy(*unit).orderBy(F.round(F.col(time) * 1e6).cast("long")).rangeBetween(-half, half))
    x = df.withColumn("_rate", near)
    x = x.withColumn("decile", F.ntile(10).over(Window.partitionBy(*unit).orderBy("_rate", time, tie)))
    size = x.groupBy(*unit, "decile").agg(F.count("*").alias("events"))
    after = pairs(x, unit, time, window, ["decile"])
    # the second event's decile for lags backwards in time: the same pairs seen from their end
    mirror = x.withColumn("_neg", -F.col(time))
    before = pairs(mirror, unit, "_neg", window, ["decile"])
    at = F.coalesce(log_bin(F.col("lag"), bin_size, window, bins, trim) + 1, F.lit(0))
    both = after.select(*unit, "decile", at.alias("bin")).unionByName(before.select(*unit, "decile", (-at).alias("bin")))
    return both.groupBy(*unit, "decile", "bin").agg(F.count("*").alias("n")).join(size, [*unit, "decile"]).withColumn("per_event", F.col("n") / F.col("events"))


def sliding_rp(df: DataFrame, unit: Sequence[str], time: str, duration: float, taus: Sequence[float], levels: Sequence[float], confidence: float = 70.0, contamination: float = 10.0, rp_reject: float = 5e-4) -> DataFrame:
    """Refractory violations per candidate period tau against the number expected under contamination c, about
    2 tau N R c (1 - c / 2) (Llobet et al. 2022); confidence is 100 (1 - P(violations or fewer)) under a Poisson law.
    ``forced``: passed, or no violation at any candidate, as a unit with few events can't reach the confidence.  Pairs up to
    the largest tau are counted once; the grid of tau x c is evaluated for a batch of units at a time in numpy."""
    n = df.groupBy(*unit).agg(F.count("*").alias("n_spikes"))
    edges = sorted(taus)
    got = pairs(df, unit, time, edges[-1]).select(*unit, *(F.when(F.col("lag") < x, 1).otherwise(0).alias(f"v{i}") for i, x in enumerate(edges)))
    got = got.groupBy(*unit).agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(len(edges))))
    wide = n.join(got, list(unit), "left").fillna(0)

    tau, grid_c = np.array(edges), np.array(levels) / 100
    ok, low = tau >= rp_reject, grid_c <= contamination / 100
    order = np.lexsort((np.tile(tau, len(levels)), np.repeat(levels, len(tau))))  # least contamination first, then least period
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                size, n = b.num_rows, b.column("n_spikes").to_numpy(zero_copy_only=False)
                obs = np.stack([b.column(f"v{i}").to_numpy(zero_copy_only=False) for i in range(len(tau))], 1).astype(float)
                mean = 2 * tau[:, None] * (n * (n / duration))[:, None, None] * (grid_c * (1 - grid_c / 2))
                conf = 100 * (1 - poisson_cdf(obs[:, :, None], mean))
                best = conf[:, ok][:, :, low].reshape(size, -1).max(1, initial=0.0)
                fits = ((conf >= confidence) & ok[:, None]).transpose(0, 2, 1).reshape(size, -1)[:, order]
                first, some = order[fits.argmax(1)], fits.any(1)
                passed = best >= confidence
                found = [n, n / duration, best, pa.array(np.array(levels, float)[first // len(tau)], mask=~some), pa.array(tau[first % len(tau)], mask=~some), obs[:, -1].astype(np.int64), passed, passed | (obs[:, -1] == 0)]
                yield pa.RecordBatch.from_arrays([*(b.column(u) for u in unit), *map(pa.array, found)], names=[*unit, "n_spikes", "firing_rate", "max_confidence", "min_contamination", "rp_min", "n_violations", "passed", "forced"])

    return wide.mapInArrow(run, ", ".join(f"`{u}` {kinds[u]}" for u in unit) + ", n_spikes long, firing_rate double, max_confidence double, min_contamination double, rp_min double, n_violations long, passed boolean, forced boolean")


#: Counts from which on the normal approximation stands for the Poisson law.
LARGE = 10_000


def poisson_cdf(k: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """P(X <= k) for whole numbers k, as the upper regularised incomplete gamma function of (k + 1, mean): its power series
    under the mean, its continued fraction over it, and the normal approximation of the cube root (Wilson and Hilferty 1931)
    from ``LARGE`` on.  All cells take a step at once and leave as they have converged; k and mean broadcast."""
    k, mean = np.broadcast_arrays(np.asarray(k, float), np.asarray(mean, float))
    a, x = np.ravel(k) + 1, np.ravel(mean)
    out = np.where(x <= 0, 1.0, 0.0)
    large, small = (x > 0) & (a >= LARGE), (x > 0) & (a < LARGE)
    if large.any():
        z = (np.cbrt(x[large] / a[large]) - (1 - 1 / (9 * a[large]))) * 3 * np.sqrt(a[large])
        out[large] = [0.5 * erfc(v / sqrt(2)) for v in z]
    if small.any():
        log_factorial = np.concatenate(([0.0, 0.0], np.cumsum(np.log(np.arange(1, a[small].max())))))  # of a - 1, at a
        out[small] = np.exp(a[small] * np.log(x[small]) - x[small] - log_factorial[a[small].astype(np.int64)])
        under = x < a + 1
        series, fraction = np.flatnonzero(small & under), np.flatnonzero(small & ~under)
        out[series] = 1 - out[series] * gamma_series(a[series], x[series])
        out[fraction] *= gamma_fraction(a[fraction], x[fraction])
    return np.clip(out, 0, 1).reshape(k.shape)


def gamma_series(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """1 / a + x / (a (a + 1)) + ..., for x < a + 1."""
    out = 1 / a
    live, term, total, n = np.arange(len(a)), out.copy(), out.copy(), a.copy()
    while len(live):
        n += 1
        term *= x / n
        total += term
        go = term > total * 1e-16
        out[live[~go]] = total[~go]
        live, term, total, n, x = (v[go] for v in (live, term, total, n, x))
    return out


def gamma_fraction(a: np.ndarray, x: np.ndarray, steps: int = 2000) -> np.ndarray:
    """The continued fraction for x >= a + 1, by Lentz's method."""
    b = x + 1 - a
    c, d = np.full(len(a), 1e300), 1 / b
    h = d.copy()
    out, live = h.copy(), np.arange(len(a))
    for n in range(1, steps):
        if not len(live):
            break
        step = -n * (n - a)
        b = b + 2
        d = step * d + b
        d = 1 / np.where(d == 0, 1e-300, d)
        c = b + step / c
        c[c == 0] = 1e-300
        h = h * (c * d)
        out[live] = h
        go = np.abs(c * d - 1) >= 1e-15
        live, a, b, c, d, h = (v[go] for v in (live, a, b, c, d, h))
    return out


def capped_events(df: DataFrame, unit: Sequence[str], key: str, most: int = 256, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """T5: at most ``most`` events per unit, drawn by a seeded hash of the event's key, or those lowest in ``draw``."""
    own = Window.partitionBy(*unit).orderBy(F.xxhash64(key, F.lit(seed)) if draw is None else draw, key)
    return df.withColumn("_rn", F.row_number().over(own)).filter(F.col("_rn") <= most).drop("_rn")


def window_average(events: DataFrame, signal: DataFrame, keys: Sequence[str], at: str, by: Sequence[str], lo: int, hi: int) -> DataFrame:
    """Mean of the signal (``i``, ``v``) at offsets lo..hi around events; an event whose window leaves the
    recording is dropped.  Events are counted per place first; offsets are exploded beside the places, so the join has equality
    keys only and no more rows than places times offsets."""
    by, at_once = list(by), list(dict.fromkeys([*keys, *by]))
    ends = signal.groupBy(*keys).agg(F.min("i").alias("_lo"), F.max("i").alias("_hi")) if keys else signal.agg(F.min("i").alias("_lo"), F.max("i").alias("_hi"))
    places = events.groupBy(*at_once, F.col(at).alias("_at")).agg(F.count("*").alias("_k"))
    inside = (places.join(ends, list(keys)) if keys else places.crossJoin(F.broadcast(ends))).filter((F.col("_at") + lo >= F.col("_lo")) & (F.col("_at") + hi <= F.col("_hi")))
    cut = inside.select(*at_once, "_at", "_k", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("offset")).withColumn("i", F.col("_at") + F.col("offset"))
    known = F.sum(F.when(F.col("v").isNotNull(), F.col("_k")))
    return cut.join(signal, [*keys, "i"]).groupBy(*by, "offset").agg((F.sum(F.col("v") * F.col("_k")) / known).alias("v"), F.sum("_k").alias("n"))


def coupling(bins: DataFrame, keys: Sequence[str], lo: int, hi: int) -> DataFrame:
    """Per unit the mean over its events of the population count (all other units) at an offset, less its mean.
    ``bins``: keys, ``unit``, ``i`` (time bin), ``n`` (events of the unit)."""
    total = bins.groupBy(*keys, "i").agg(F.sum("n").alias("all"))
    own = bins.groupBy(*keys, "unit").agg(F.sum("n").alias("events"))
    span = bins.groupBy(*keys).agg((F.max("i") - F.min("i") + 1).alias("n_bins"), F.min("i").alias("i0"), F.max("i").alias("i1"), F.sum("n").alias("sum_all"))
    ev = bins.join(span, list(keys)).filter((F.col("i") + lo >= F.col("i0")) & (F.col("i") + hi <= F.col("i1")))
    kept = ev.groupBy(*keys, "unit").agg(F.sum("n").alias("n_in"))
    cut = ev.select(*keys, "unit", F.col("n").alias("w"), F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("offset"), "i").withColumn("j", F.col("i") + F.col("offset"))
    other = cut.join(total.withColumnRenamed("i", "j"), [*keys, "j"], "left").join(bins.select(*keys, "unit", F.col("i").alias("j"), F.col("n").alias("self")), [*keys, "unit", "j"], "left")
    s = other.groupBy(*keys, "unit", "offset").agg(F.sum(F.col("w") * (F.coalesce("all", F.lit(0)) - F.coalesce("self", F.lit(0)))).alias("s"))
    s = s.join(kept, [*keys, "unit"]).join(own, [*keys, "unit"]).join(span, list(keys))
    return s.select(*keys, "unit", "offset", (F.col("s") / F.col("n_in") - (F.col("sum_all") - F.col("events")) / F.col("n_bins")).alias("v"))


def coupling_metrics(traces: DataFrame, keys: Sequence[str], offset: str, v: str, bin_size: float) -> DataFrame:
    """Strength, the trace at the first lag >= 0, and delay, the mean lag weighted by the trace's size (null for a trace
    of zeros)."""
    w = F.abs(v)
    x = traces.groupBy(*keys).agg(F.min_by(v, F.when(F.col(offset) >= 0, F.col(offset))).alias("strength"), F.sum(F.col(offset) * bin_size * w).alias("a"), F.sum(w).alias("b"))
    return x.select(*keys, "strength", F.when(F.col("b") != 0, F.col("a") / F.col("b")).alias("delay"))


def trial_counts(trials: DataFrame, events: DataFrame, keys: Sequence[str], trial: str, at: str, unit: str, time: str, start: float, size: float, n_bins: int) -> DataFrame:
    """Events per trial, unit and bin (``bin`` from 0) in ``n_bins`` windows of ``size`` from ``at`` + start on, half-open.
    Trials are spread over the two buckets that their span touches, so the join has equality keys.  Bins without events give
    no row."""
    span = size * n_bins
    w = trials.select(*keys, trial, (F.col(at) + start).alias("_from"))
    w = w.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_from") / span), F.floor((F.col("_from") + span) / span))))
    e = events.select(*keys, F.col(unit).alias("unit"), F.col(time).alias("_time"), F.floor(F.col(time) / span).alias("_b"))
    at_bin = F.floor((F.col("_time") - F.col("_from")) / size)
    x = w.join(e, [*keys, "_b"]).withColumn("bin", at_bin).filter((F.col("bin") >= 0) & (F.col("bin") < n_bins))
    return x.groupBy(*keys, trial, "unit", "bin").agg(F.count("*").alias("n"))
