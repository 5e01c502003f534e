"""Small functions on rows with nulls, ties, gaps and clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recloom.functions import kernels, numbers, text
from recloom.operators import catalog, qc, tables
from recloom.operators import events as ev
from recloom.operators import signal as sg


def got(df, *order):
    return sorted((tuple(r) for r in (df.select(*order) if order else df).collect()), key=repr)


def test_units_of_spikes(spark):
    spikes = spark.createDataFrame([(1, 7, 0.1), (1, 7, 0.2), (1, 8, 0.3), (2, 7, 0.4)], "pid int, c int, t double")
    clusters = spark.createDataFrame([(1, 7, 3, 0), (1, 8, 9, 1)], "pid int, c int, channel int, fail int")
    channels = spark.createDataFrame([(1, 3, "CA1")], "pid int, channel int, area string")
    assert got(tables.merged_units(spikes, clusters, channels, ["pid"], "c", "channel"), "pid", "c", "spike_count", "area") == [(1, 7, 2, "CA1"), (1, 8, 1, None), (2, 7, 1, None)]
    assert got(tables.attribute_of_unit(spikes, clusters, channels, ["pid"], "c", "channel"), "t", "area") == [(0.1, "CA1"), (0.2, "CA1")]
    assert got(catalog.good_units(clusters, "fail"), "c") == [(7,)]
    assert got(qc.unit_rates(spikes, ["pid", "c"], 4.0), "pid", "c", "firing_rate") == [(1, 7, 0.5), (1, 8, 0.25), (2, 7, 0.25)]
    assert got(qc.unit_rates(spikes, ["pid"], 0.0), "firing_rate") == [(None,), (None,)]
    assert got(qc.unit_counts(clusters, ["pid"], F.when(F.col("fail") == 0, True))) == [(1, 2, 1)]


def test_sets_and_columns(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(2,), (None,)], "k int")
    assert got(tables.union_rows([a, b])) == sorted([(1, "x"), (1, "y"), (None, "z"), (2, None), (None, None)], key=repr)
    assert got(tables.distinct_keys([a, b], "k")) == [(1,), (2,), (None,)] and got(tables.keys_without(a, b, "k")) == [(1,)]
    assert tables.reshaped(a.withColumns({"rp2_q": F.lit(1), "w": F.lit(2)}), {"k": "key"}, ["rp2_"], spark.createDataFrame([(1, 1)], "v int, key int"), ["key"]).columns == ["key", "w"]
    assert tables.reshaped(a).columns == ["k", "v"]
    assert got(tables.keyed(a, k=9, run=F.upper("v"))) == [(9, "X", "x"), (9, "Y", "y"), (9, "Z", "z")]
    assert got(tables.with_bands(a.filter("v = 'x'"), ["p", "q"])) == [(1, "x", 0, "p"), (1, "x", 1, "q")]


def test_files(spark):
    f = spark.createDataFrame([("a", "s/x.bin"), ("a", "y.bin"), ("n", "z.bin")], "repo string, rel string")
    r = spark.createDataFrame([("a", "/mnt/a"), ("b", "/mnt/b")], "repo string, root string")
    assert got(tables.repository_folders(f, r, "repo", "root", "rel"), "rel", "folder") == [("s/x.bin", "/mnt/a/s"), ("y.bin", "/mnt/a"), ("z.bin", None)]
    p = spark.createDataFrame([(1, "/b/x.meta"), (1, "/a/x.meta"), (1, "/a/x.bin"), (2, "/a/y.bin")], "k int, p string")
    assert got(tables.first_with_ending(p, ["k"], "p", ".meta")) == [(1, "/a/x.meta")]
    assert got(tables.siblings(p, "p")) == [("/a/x", ["/a/x.bin", "/a/x.meta"]), ("/a/y", ["/a/y.bin"]), ("/b/x", ["/b/x.meta"])]
    assert got(catalog.revision_choice(p, ["k"], "p", [".meta"], "late", "early")) == [(1, "late"), (2, "early")]


def test_columns(spark):
    x = spark.createDataFrame([("s__2020-01-02__001", '{"a": 1}', 3.0), ("s", "", -3.0), (None, "no json", None)], "key string, js string, v double")
    assert got(x.select(*text.key_fields(F.col("key"), ["s", "d", "n"]))) == sorted([("s", "2020-01-02", "001"), ("s", None, None), (None, None, None)], key=repr)
    assert [r[0] for r in x.select(text.json_fields(F.col("js"), "a int")["a"]).collect()] == [1, None, None]
    assert [r[0] for r in x.select(text.after(F.get(F.split("key", "__"), F.lit(1)), "2020-01-01", {"s": "2021-01-01"}, F.substring("js", 1, 1))).collect()] == [True, None, None]
    assert [r[0] for r in x.select(text.namespace(F.col("key"), {"one": "s__", "two": F.col("v") < 0}, "none")).collect()] == ["one", "two", "none"]
    assert [tuple(r) for r in x.select(numbers.clipped(F.col("v")), F.round(numbers.log_size(F.col("v")), 6)).collect()] == [(1.0, 1.098612), (-1.0, 1.098612), (None, None)]


def test_traces(spark):
    w = spark.createDataFrame([(1, 0, [0.0, -3.0, 1.0]), (1, 1, [0.0, 4.0, 0.0]), (1, 2, [0.0, 0.0, -4.0]), (2, 0, [])], "u int, c int, w array<double>")
    assert got(sg.peak_traces(w, ["u"], "c", "w")) == [(1, 0, [0.0, -3.0, 1.0])]  # all of one range: the first channel
    assert got(sg.waveform_features(w, ["u", "c"], "w"))[:3] == [(1, 0, 1, -3.0, 1.0, 0.0, 4.0), (1, 1, 1, 4.0, 0.0, 0.0, 4.0), (1, 2, 2, -4.0, -4.0, 0.0, 4.0)]
    assert got(sg.neighbours(w.select("u", "c"), "c", (-1, 1), 3, "near"))[:4] == [(1, 0, 1, 1), (1, 1, 0, 0), (1, 1, 1, 2), (1, 2, 0, 1)]
    with pytest.raises(ValueError, match="no targets"):
        sg.targets(w, ["u"], "c", "w", "spikes", 1.0)


def test_probe_tables(spark):
    x = spark.createDataFrame([("p", 0, "CA1", 1.0), ("p", 0, "CA1", 3.0), ("p", 0, "CA1", 8.0), ("p", 1, "DG", None)], "pid string, channel int, area string, rms double")
    channels, values, merged = sg.aggregate_probes(x, "pid", "channel", ["area"], ["rms"])
    assert got(channels) == [("p", 0, "CA1"), ("p", 1, "DG")]
    assert got(values) == [("p", 0, 4.0, 3.0, 3), ("p", 1, None, None, 1)] and merged.count() == 2


def test_uniform_trace_in_blocks_is_the_whole_one(spark):
    rng = np.random.default_rng(1)
    t = np.sort(rng.uniform(0, 60, 900))
    v = np.sin(t) + 0.1 * rng.normal(size=900)
    x = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, v, strict=True)], "k int, t double, v double")
    one = sorted(sg.uniform_trace(x, ["k"], 0.05, 2.0).collect(), key=lambda r: r.i)
    grid = np.array([r.t for r in one])
    want = kernels.low_pass(np.interp(grid, t, v), 20.0, 2.0)
    assert np.allclose([r.v for r in one], want) and np.allclose([r.velocity for r in one], np.gradient(want, 0.05))
    many = sorted(sg.uniform_trace(x, ["k"], 0.05, 2.0, size=300, halo=200).collect(), key=lambda r: r.i)
    assert [r.i for r in many] == [r.i for r in one] and np.abs(np.array([r.v for r in many]) - want).max() < 0.02


def test_uniform_trace_over_empty_blocks_and_without_values(spark):
    t, v = [0.3, 1.0, 2.0, 2999.5, 3000.0, 9000.2], [1.0, 4.0, 4.0, -2.0, 8.0, 3.0]
    rows = [(1, a, b) for a, b in zip(t, v, strict=True)] + [(1, 5000.0, None), (1, None, 7.0), (2, 0.0, None), (2, 4.0, None), (3, 0.2, 1.0), (3, 0.7, 1.0)]
    x = sg.uniform_trace(spark.createDataFrame(rows, "k int, t double, v double"), ["k"], 1.0, 1e9, size=64, halo=10)
    got = {(r.k, r.i): (r.v, r.velocity) for r in x.collect()}
    want = np.interp(np.arange(1, 9001), t, v)
    assert sorted(i for k, i in got if k == 1) == list(range(1, 9001))
    assert np.allclose([got[1, i][0] for i in range(1, 9001)], want) and np.allclose([got[1, i][1] for i in range(1, 9001)], np.gradient(want))
    assert {i: got[2, i] for k, i in got if k == 2} == {i: (None, None) for i in range(5)} and not [k for k in got if k[0] == 3]
    # rows that are shuffled are samples and blocks, not the grid's
    assert "sequence(_a" not in x._jdf.queryExecution().optimizedPlan().toString()


def test_spread_keeps_the_rows_of_a_task(spark):
    x = spark.range(4000).withColumnRenamed("id", "k")
    for rows, parts in ((10, 4), (4000, 40)):
        sizes = [len(p) for p in tables.spread(x, ["k"], rows, most=100).rdd.glom().collect()]
        assert len(sizes) == parts and sum(sizes) == 4000
    two = tables.spread(x, ["k"], 4000, most=100).join(tables.spread(x, ["k"], 4000, most=100).hint("merge"), "k")
    assert two.rdd.getNumPartitions() == 40


def test_window_average_counts_places(spark):
    signal = spark.createDataFrame([(i, None if i == 5 else float(i * i)) for i in range(12)], "i long, v double")
    at = [(["a", "b"][k % 2], k % 13 - 1) for k in range(500)]
    avg = ev.window_average(spark.createDataFrame(at, "g string, at long"), signal, [], "at", ["g"], -1, 2)
    want = {}
    for g, a in at:
        if a - 1 >= 0 and a + 2 <= 11:
            for o in range(-1, 3):
                want.setdefault((g, o), []).append(None if a + o == 5 else float((a + o) ** 2))
    have = {(r.g, r["offset"]): (r.v, r.n) for r in avg.collect()}
    assert have.keys() == want.keys()
    for k, v in want.items():
        known = [z for z in v if z is not None]
        assert have[k][1] == len(v) and abs(have[k][0] - sum(known) / len(known)) < 1e-9
    # events are summed up before the offsets multiply them
    plan = avg._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Generate") :].count("Aggregate") == 2
