"""Saturation, separated events, cut-outs and labels against plain loops."""

import numpy as np
from pyspark.sql import functions as F

from recloom.operators import signal as sg
from recloom.operators import spikes as sp


def long(spark, x, first=0):
    return spark.createDataFrame([(0, c, first + i, None if np.isnan(v) else float(v)) for c, row in enumerate(x) for i, v in enumerate(row)], "pid int, c int, i long, v double")


def test_saturation_by_size_and_slew(spark):
    x = np.zeros((4, 8))
    x[:2, 2] = 9.0  # half of the channels over the limit, and jumps at 2 and 3
    x[0, 5], x[:, 6] = 9.0, np.nan
    got = {r.i: r.saturated for r in sp.saturation(long(spark, x), ["pid"], "c", "i", "v", 8.0, 5.0, 0.25).collect()}
    assert [i for i in sorted(got) if got[i]] == [2, 3]
    no_slew = {r.i for r in sp.saturation(long(spark, x), ["pid"], "c", "i", "v", 8.0, 99.0, 0.25).filter("saturated").collect()}
    assert no_slew == {2}
    spans = sg.islands(sp.saturation(long(spark, x), ["pid"], "c", "i", "v", 8.0, 5.0, 0.25), ["pid"], "i", F.col("saturated"))
    sizes = spark.createDataFrame([(0, 8), (1, 4), (2, 0)], "pid int, n long")
    rep = {r.pid: (r.n_intervals, r.seconds, r.fraction, r.muted) for r in sp.saturation_report(spans, sizes, ["pid"], 4.0).collect()}
    assert rep == {0: (1, 0.5, 0.25, False), 1: (0, 0.0, 0.0, False), 2: (0, 0.0, None, False)}


def test_separated_events_against_loops(spark):
    rng = np.random.default_rng(1)
    rows = [(int(p), int(c), int(i), float(v)) for p, c, i, v in zip(rng.integers(0, 2, 300), rng.integers(0, 6, 300), rng.integers(-40, 200, 300), rng.integers(-9, 0, 300), strict=True)]
    rows = list(dict(((r[:3]), r) for r in rows).values())
    got = {tuple(r) for r in sp.separate(spark.createDataFrame(rows, "pid int, c int, i long, v double"), ["pid"], "c", "i", "v", 1, 7).collect()}
    want = {r for r in rows if not any(o[0] == r[0] and abs(o[1] - r[1]) <= 1 and abs(o[2] - r[2]) <= 7 and (o[3], o[1], o[2]) < (r[3], r[1], r[2]) for o in rows)}
    assert got == want and 0 < len(want) < len(rows)


def test_cutouts_in_order_without_gaps(spark):
    s = spark.createDataFrame([(0, i, float(i * i)) for i in range(20) if i != 13] + [(0, 13, None)], "pid int, i long, v double")
    e = spark.createDataFrame([(0, 1, 1), (0, 2, 5), (0, 3, 12), (0, 4, 5), (9, 5, 5)], "pid int, event int, at long")
    cut = sp.cutouts(e, s, ["pid"], ["event"], "at", -2, 3)
    got = {r.event: r.waveform for r in cut.collect()}
    assert got == {k: [float(i * i) for i in range(3, 9)] for k in (2, 4)}
    mean = {r["sample"]: (r.v, r.n) for r in sp.mean_waveforms(cut, ["pid"]).collect()}
    assert mean == {k: (float((k + 3) ** 2), 2) for k in range(6)}


def test_cutouts_of_many_events_at_few_places(spark):
    s = spark.range(-70, 90).selectExpr("cast(id % 2 as int) pid", "floor(id / 2) i", "cast(id * id as double) v").filter("i != 20")
    e = spark.range(3000).selectExpr("cast(id % 3 as int) pid", "id event", "cast(id % 91 as int) - 45 at")
    want = e.join(s, "pid").filter("i between at - 7 and at + 8").groupBy("pid", "event", "at").agg(F.count("*").alias("n"), F.sum("v").alias("v")).filter("n = 16")
    want = {(r.pid, r.event, r["at"], r.v) for r in want.collect()}
    for few in (0, 159, 1000):
        cut = sp.cutouts(e, s, ["pid"], ["event"], "at", -7, 8, few=few)
        assert {(r.pid, r.event, r["at"], sum(r.waveform)) for r in cut.collect()} == want and len(want) > 600
        # windows are cut by place; no row of an event is multiplied by the window's length
        plan = cut._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence(" not in plan and plan.count("Generate") == 1


def test_neighbour_correlation_with_lags_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5, 60))
    x[4] = 1.0
    got = {r.channel: r.correlation for r in sp.neighbour_correlation(long(spark, x), ["pid"], "c", "i", "v", 2, 1).collect()}
    for c in range(4):
        every = []
        for d in (-2, -1, 1, 2):
            if 0 <= c + d < 4:
                every += [np.corrcoef(x[c][max(0, -k) : 60 - max(0, k)], x[c + d][max(0, k) : 60 + min(0, k)])[0, 1] for k in (-1, 0, 1)]
        assert abs(got[c] - max(every)) < 1e-12
    assert got[4] is None


def test_outside_is_the_run_at_the_end(spark):
    sim = [0.9] * 6 + [0.1] * 4 + [0.9] * 10 + [0.2] * 6
    f = spark.createDataFrame([(0, c, s, 1 if s < 0.3 else 0) for c, s in enumerate(sim)] + [(1, c, 0.9, 0) for c in range(4)], "pid int, c int, similarity double, label int")
    got = {(r.pid, r.c): r.label for r in sp.outside_labels(f, ["pid"], "c").collect()}
    assert [c for c in range(26) if got[0, c] == 3] == list(range(20, 26)) and all(got[0, c] == 1 for c in range(6, 10)) and not any(got[1, c] for c in range(4))


def test_geometry_without_stored_positions_is_skipped(spark):
    stored = spark.createDataFrame([("a", 0, 1.0), ("b", 0, None), ("c", 0, 1.0), ("d", 0, 1.0)], "pid string, ch int, x double")
    computed = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 1.0), ("c", 0, 2.0)], "pid string, ch int, x double")
    got = {r.pid: r.status for r in sg.geometry_check(stored, computed, ["pid", "ch"], ["x"], 0.1).collect()}
    assert got == {"a": "unchanged", "b": "skip", "c": "changed", "d": "no-map"}


def test_events_meet_those_of_near_channels_only(spark):
    """Many channels at one time: candidates are looked for in buckets of channels as well."""
    found = spark.range(3000).selectExpr("'a' k", "id % 1000 channel", "id div 1000 i", "-1.0 * ((id * 7919) % 1009) v")
    kept = sp.separate(found, ["k"], "channel", "i", "v", 2, 3)
    got = {(r.channel, r.i) for r in kept.collect()}
    e = {(n % 1000, n // 1000): (-float(n * 7919 % 1009), n % 1000, n // 1000) for n in range(3000)}
    want = {(c, i) for (c, i), own in e.items() if not any((o := e.get((c + d, i + k))) and o < own for d in range(-2, 3) for k in range(-3, 4))}
    join = next(x for x in kept._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x)
    assert got == want and "_d#" in join.split("LeftAnti")[0]


def test_a_sample_is_sorted_once_for_its_median(spark, tmp_path):
    from recloom.plans import signal

    x = np.random.default_rng(2).normal(size=(9, 64)).astype("float32")
    spark.createDataFrame([(k, 1 + (k > 4), v.tolist()) for k, v in enumerate(x)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = signal.snippets(spark, str(tmp_path))
    for r in df.collect():
        own = x[:5] if r.label == 1 else x[5:]
        assert np.array_equal(r.x, own[:, r.i].astype(float) - np.median(own[:, r.i].astype(float)))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort(x#") == 1
