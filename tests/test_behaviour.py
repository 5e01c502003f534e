"""Trials, streams and designs on small cases by hand."""

import math

import numpy as np
import pytest

from recloom.operators import behaviour as bh
from recloom.operators import encoding as en

NAN = float("nan")


def test_a_session_without_trials_is_an_error(spark):
    table = spark.createDataFrame([(1, 5.0, 0.5, None), (1, 2.0, None, 0.25), (1, None, NAN, NAN)], "eid int, on double, contrastRight double, contrastLeft double")
    one = spark.createDataFrame([(1,), (1,)], "eid int")
    got = {r.on: (r.trial, r.contrast) for r in bh.trials(table, one, ["eid"], "on").collect()}
    assert got == {2.0: (0, -0.25), 5.0: (1, 0.5), None: (2, 0.0)}
    with pytest.raises(Exception, match="no trials of session 7"):
        bh.trials(table, spark.createDataFrame([(1,), (7,)], "eid int"), ["eid"], "on").collect()


def test_stream_flags_never_fail(spark):
    s = spark.createDataFrame([(k,) for k in range(5)], "eid int")
    rows = [(0, "wheel", 0.0, 1.0), (0, "wheel", 1.0, NAN), (1, "wheel", 0.0, NAN), (1, "wheel", 1.0, NAN), (1, "wheel", 2.0, 1.0), (2, "wheel", 0.0, None), (3, "wheel", None, 1.0), (3, "wheel", 1.0, 1.0)]
    x = spark.createDataFrame(rows, "eid int, stream string, t double, v double")
    got = {(r.eid, r.stream): r.usable for r in bh.stream_flags(s, x, ["eid"]).collect()}
    assert got == {(k, st): (k, st) == (0, "wheel") for k in range(5) for st in bh.STREAMS}


def test_base_regressors_against_numpy(spark):
    rng = np.random.default_rng(3)
    n, dt = 50, 0.5
    grid = spark.createDataFrame([(0, i, i * dt) for i in range(n)], "eid int, i long, t double")
    tr = [(0, float(rng.uniform(-1, 27)), float(rng.uniform(0, 25)) if k % 4 else NAN, float(rng.uniform(0, 25)), float(rng.normal()), 1.0 if k % 3 else None, -1.0) for k in range(20)]
    trials = spark.createDataFrame(tr, "eid int, stimOn_times double, firstMovement_times double, feedback_times double, contrast double, choice double, feedbackType double")
    wheel = [(0, "wheel", float(t), float(v)) for t, v in zip(np.sort(rng.uniform(0, 24, 40)), rng.normal(size=40), strict=True)]
    wheel[7] = (*wheel[7][:3], NAN)
    pupil = [(0, "pupil", float(t), 1.0) for t in range(3)]  # covers too little
    traces = spark.createDataFrame(wheel + pupil, "eid int, stream string, t double, v double")
    one = grid.select("eid").distinct()
    used = bh.streams_in_use(bh.stream_flags(one, traces, ["eid"]), traces, grid, ["eid"])
    assert [r.stream for r in used.collect()] == ["wheel"]
    got = {(r.name, r.i): r.v for r in bh.base_regressors(trials, traces, used, grid, ["eid"], 0.0, dt, 4.0).collect()}
    want = {}
    for name, _, t, w in bh.EVENT_REGRESSORS:
        v = np.zeros(n)
        for r in trials.collect():
            weight = 1.0 if w is None else r[w]
            if weight is not None and math.isfinite(r[t]):
                v[min(max(math.ceil(r[t] / dt), 0), n - 1)] += weight
        want |= {(name, i): v[i] for i in range(n)}
    good = [(t, v) for _, _, t, v in wheel if math.isfinite(v)]
    v = np.interp(np.arange(n) * dt, *zip(*good, strict=True))
    for name, y in (("wheel_vel", v), ("wheel_speed", np.abs(v))):
        want |= {(name, i): z for i, z in enumerate((y - y.mean()) / y.std())}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    cols = bh.design_columns(bh.regressor_table(used, one, ["eid"]), 3, ["eid"]).orderBy("col").collect()
    assert [c.name for c in cols[:4]] == ["stimOn_on@b0", "stimOn_on@b1", "stimOn_on@b2", "stimOn_contrast@b0"] and len(cols) == 24
    assert {(c.grp, c["first"], c["last"]) for c in cols} == {("stimOn", 0, 5), ("move", 6, 11), ("feedback", 12, 17), ("wheel", 18, 23)}


def test_designs_of_several_sizes_in_one_fit(spark):
    """Recordings with 6 and 8 regressors give what each gives alone by least squares on the raw rows."""
    rng = np.random.default_rng(5)
    data, want = [], {}
    for eid, r in ((0, 6), (1, 8)):
        x = rng.normal(size=(60, r))
        y = x @ rng.normal(size=r) + rng.normal(size=60)
        data += [(eid, i, 60, x[i].tolist(), [float(y[i])]) for i in range(60)]
        xc, yc = x - x.mean(0), y - y.mean()
        w = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(r), xc.T @ yc)
        want[eid] = 1 - ((yc - xc @ w) ** 2).sum() / (yc**2).sum()
    rows = spark.createDataFrame(data, "eid int, i long, n long, x array<double>, y array<double>")
    scores = en.solve(en.chunk_packs(rows, ["eid"], np.ones((1, 1)), 0, 4, 17), ["eid"], bh.groups_by_size(), 1, 1, [2.0])
    table = en.score_table(scores, ["eid"], ["stimOn", "wheel"]).collect()
    assert len(table) == 4 and all(abs(r.r2_full - want[r.eid]) < 1e-9 and r.has_stimOn and r.has_wheel == (r.eid == 1) for r in table)
    assert all((r.dr2_wheel is not None) == r.has_wheel for r in table)


def test_settings_are_one_row(spark, tmp_path):
    from recloom.sources import writers

    writers.run_settings(spark, str(tmp_path), {"fs": 250.0}, {"groups": ["a", "b"]}, en.basis_table(spark, 1.0, 1.0, 1.0, 2))
    (row,) = spark.read.parquet(f"{tmp_path}/settings").collect()
    assert row.numbers == {"fs": 250.0} and row.lists == {"groups": ["a", "b"]} and spark.read.parquet(f"{tmp_path}/basis").count() == 6


@pytest.mark.parametrize("size", [7, 16, 1000])
def test_null_in_blocks_equals_the_null_by_rows(spark, size):
    rng = np.random.default_rng(8)
    data = [(k, i, n, rng.normal(size=2).tolist(), rng.normal(size=1).tolist()) for k, n in ((0, 53), (1, 20)) for i in range(n)]
    rows = spark.createDataFrame(data, "eid int, i long, n long, x array<double>, y array<double>")
    draws = en.shift_draws(rows.groupBy("eid").agg({"n": "max"}).withColumnRenamed("max(n)", "n"), ["eid"], 5, 3)
    b = np.array([[0.5, 0.0], [1.0, 0.2], [0.0, 1.0], [0.3, 0.1]])
    want = en.chunk_packs(en.null_rows(rows, ["eid"], draws), ["eid", "perm"], b, 1, 3)
    got = en.null_packs(rows, ["eid"], draws, b, 1, 3, size, 2)
    total = lambda packs: {(k, q, f): sum(np.array(r.s) for r in rs) for (k, q, f), rs in _by(packs.collect()).items()}
    a, z = total(got), total(want)
    assert a.keys() == z.keys() and all(np.allclose(a[k], z[k]) for k in z)


def _by(rows):
    out = {}
    for r in rows:
        out.setdefault((r.eid, r.perm, r.fold), []).append(r)
    return out


def test_regular_events_have_no_memory(spark):
    from recloom.operators import events as ev

    x = spark.createDataFrame([(0, float(i), i) for i in range(9)], "u int, t double, id int")
    (r,) = ev.burstiness_memory(x, ["u"], "t", "id").collect()
    assert r.n == 9 and r.burstiness == -1.0 and r.memory is None
