"""Filters over blocks with halos against the same filters over whole recordings; bundles of features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recloom.functions import kernels
from recloom.operators import blocks as bk
from recloom.operators import features as ft
from recloom.operators import signal as sg

RNG = np.random.default_rng(8)


def recording(spark, x, pid="a", lost=()):
    rows = [(pid, i, len(x), v.tolist()) for i, v in enumerate(x) if i not in lost]
    return spark.createDataFrame(rows, "pid string, i long, n long, x array<double>").repartition(3)


def matrix(df, of="x"):
    return np.array([r[of] for r in df.orderBy("i").collect()])


def reflected(x, reach):
    at = np.arange(-reach, len(x) + reach)
    n = len(x)
    inside = x[np.clip(at, 0, n - 1)]
    low, high = 2 * x[0] - x[np.minimum(np.maximum(-at, 0), n - 1)], 2 * x[-1] - x[np.maximum(np.minimum(2 * (n - 1) - at, n - 1), 0)]
    return np.where((at < 0)[:, None], low, np.where((at >= n)[:, None], high, inside))


@pytest.mark.parametrize(("n", "size"), [(230, 7), (230, 100), (230, 1000), (30, 11), (1, 5)])
def test_decimated_blocks_are_the_whole(spark, n, size):
    x, q = RNG.normal(size=(n, 3)), 3
    h = bk.low_pass_taps(q)
    clean = x - np.median(x[:, [0, 2]], axis=1, keepdims=True)
    whole = np.stack([np.convolve(c, h, "valid") for c in reflected(clean, len(h) // 2).T], 1)[::q]
    got = bk.decimated(recording(spark, x), ["pid"], q, size, good=[0, 2])
    assert [r.i for r in got.orderBy("i").collect()] == list(range(-(-n // q))) and np.allclose(matrix(got), whole, atol=1e-12)


def test_tones_above_the_new_nyquist_rate_are_gone():
    for q in (2, 5, 10):
        h = bk.low_pass_taps(q)
        gain = lambda f: abs((h * np.exp(2j * np.pi * f * np.arange(len(h)))).sum())
        assert gain(0) == pytest.approx(1) and gain(0.25 / q) > 0.99 and max(gain(f) for f in np.arange(0.5 / q, 0.5, 1e-3)) < 1e-3


def test_a_missing_sample_is_zeros_and_bad_sizes_are_errors(spark):
    x = RNG.normal(size=(40, 2))
    filled = x.copy()
    filled[[5, 6, 39]] = 0
    got = matrix(bk.decimated(recording(spark, x, lost=(5, 6, 39)), ["pid"], 2, 9, reference=False))
    assert np.allclose(got, matrix(bk.decimated(recording(spark, filled), ["pid"], 2, 9, reference=False)), atol=1e-12)
    assert bk.decimated(recording(spark, x).limit(0), ["pid"], 2).count() == 0
    with pytest.raises(ValueError, match="no blocks"):
        bk.blocked(recording(spark, x), ["pid"], 0, 1, lambda *a: {}, {})


def test_envelopes_by_blocks(spark):
    fs, n = 250.0, 4000
    x = np.stack([np.sin(2 * np.pi * f * np.arange(n) / fs) + 0.1 * RNG.normal(size=n) for f in (2.0, 6.0, 20.0)], 1)
    df, bands = recording(spark, x), {"theta": (4.0, 8.0), "beta": (15.0, 30.0)}
    whole, parts = (bk.log_envelopes(bk.band_amplitudes(df, ["pid"], fs, bands, size), ["pid"]) for size in (n, 700))
    for b in bands:
        a, c = (matrix(e.filter(F.col("band") == b)) for e in (whole, parts))
        assert a.shape == (n, 3) and np.abs(a - c).max() < 1e-8
        halo = bk.reach_of(fs, bands[b])
        one = [kernels.envelope(v, fs, bands[b], min(halo, n - 1)) for v in x.T]
        assert np.abs(a - np.stack(one, 1))[500:-500].max() < 1e-6
    mid = a[500:-500].mean(0)
    assert np.argmax(mid) == 2 and mid[2] == pytest.approx(0, abs=0.05)  # a sine of amplitude 1 in its band


def test_planted_channels_are_labelled(spark):
    fs, n, nc = 500.0, 6000, 40
    slow = np.cumsum(RNG.normal(size=(n, 1)), axis=0) * 0.2
    x = slow + 0.5 * RNG.normal(size=(n, nc))
    x[:, 7] = 0
    x[:, 20] = 0.01 * RNG.normal(size=n)
    x[:, 12] += 8 * RNG.normal(size=n)
    x[:, 33:] = 0.5 * RNG.normal(size=(n, 7))
    x[2000:4000, 3] += 8 * RNG.normal(size=2000)  # noisy for a while only
    labels = bk.chunk_labels(bk.channel_features(recording(spark, x), ["pid"], fs, 2000), ["pid"])
    got = {r.channel: r.label for r in sg.label_mode(labels, ["pid", "channel"], "label").collect()}
    assert got == {c: 1 if c in (7, 20) else 2 if c == 12 else 3 if c >= 33 else 0 for c in range(nc)}
    assert {(r.chunk, r.label) for r in labels.filter("channel = 3").collect()} == {(0, 0), (1, 2), (2, 0)}


def test_a_short_last_chunk_is_left_out(spark):
    features = bk.channel_features(recording(spark, RNG.normal(size=(230, 3))), ["pid"], 100.0, 100, window=20).collect()
    assert {(r.chunk, r.channel) for r in features} == {(k, c) for k in range(2) for c in range(3)}
    assert {r.chunk for r in bk.channel_features(recording(spark, RNG.normal(size=(15, 1))), ["pid"], 100.0, 100, window=20).collect()} == {0}


def test_csd_power_of_a_slow_wave(spark):
    i = np.arange(400)
    x = np.array([c**2 * np.sin(2 * np.pi * i / 100) for c in range(5)])
    got = {r.channel: r.csd_power for r in bk.csd_power(recording(spark, x.T), ["pid"], 4, 1.0, 90).collect()}
    assert set(got) == {1, 2, 3} and all(abs(v - 2.0) < 0.05 for v in got.values())  # second difference 2, mean of its square's sine 1/2


def test_a_second_run_of_a_bundle_computes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(k, i, 30, RNG.normal(size=4).tolist()) for k in ("a", "b", "c") for i in range(30)], "pid string, i long, n long, x array<double>")
    asked = []

    def group(name, f):
        return lambda r: asked.append((name, {x.pid for x in r.select("pid").distinct().collect()})) or f(r)

    keys = ["pid"]
    groups = {"lf": group("lf", lambda r: ft.lf(r, keys, 100.0, 16)), "wav": group("wav", lambda r: ft.spiking(r, keys, 1.0, 1, 2, -2, 4)), "csd": group("csd", lambda r: ft.csd(r, keys, 2, 1.0))}
    some = rows.filter("pid != 'c'")
    first, n = ft.bundle(some, keys, f"file://{tmp_path}/f", groups)
    first = {(r.pid, r.channel): r for r in first.collect()}
    assert n == {"lf": 2, "wav": 2, "csd": 2} and len(first) == 8 and {x for x, _ in asked} == {"lf", "wav", "csd"}
    assert all(r.n_spikes > 0 and r.ptp is not None and (r.csd_power is None) == (c in (0, 3)) for (_, c), r in first.items())
    asked.clear()
    again, n = ft.bundle(some, keys, f"file://{tmp_path}/f", groups)
    assert n == {"lf": 0, "wav": 0, "csd": 0} and not asked and {(r.pid, r.channel): r for r in again.collect()} == first
    more, n = ft.bundle(rows, keys, f"file://{tmp_path}/f", groups)
    assert n == {"lf": 1, "wav": 1, "csd": 1} and all(p == {"c"} for _, p in asked) and more.count() == 12
    assert {(r.pid, r.channel): r for r in more.filter("pid != 'c'").collect()} == first
    assert {r.pid for r in ft.bundle(rows.filter("pid = 'b'"), keys, f"file://{tmp_path}/f", groups)[0].collect()} == {"b"}
