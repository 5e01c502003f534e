"""Catalogue filters, states of runs, steps and restricted statistics on small cases."""

import numpy as np
import pytest

from recloom.operators import catalog, steps
from recloom.operators import decoding as de
from recloom.operators import encoding as en


def test_terms(spark):
    x = spark.createDataFrame([("Ab", 1, True), ("abc", None, True), ("abd", 3, None), (None, 4, True)], "name string, n int, there boolean")
    names = lambda df: {r.name for r in df.collect()}
    assert names(catalog.catalogue(x, "there", name__startswith="AB")) == {"Ab", "abc"}
    assert names(catalog.catalogue(x, name__endswith="C", n__isnull=True)) == {"abc"} and names(catalog.catalogue(x, n=3)) == {"abd"}
    assert names(catalog.catalogue(x, n__in=[1, 4], n__lte=3)) == {"Ab"} and catalog.catalogue(x).count() == 4
    for wrong in ({"other": 1}, {"name__like": "a"}):
        with pytest.raises(ValueError, match="no such term"):
            catalog.catalogue(x, **wrong)


def test_freeze_and_lists(spark):
    x = spark.createDataFrame([("a", "1", True), ("b", "1", None), ("c", "2", True), ("d", None, False)], "pid string, freeze string, bwm boolean")
    keys = lambda df: [r.pid for r in df.orderBy("pid").collect()]
    assert keys(catalog.frozen(x, "1")) == ["a", "b"] and keys(catalog.frozen(x, None, member="bwm")) == ["a", "c"] and len(keys(catalog.frozen(x, None))) == 4
    assert keys(catalog.select_keys(x, "pid", ["d", "b", "z"], 1)) == ["b"] and keys(catalog.select_keys(x, "pid", n=2)) == ["a", "b"]


def test_state_and_run_list(spark):
    old = spark.createDataFrame([("a", 1, "failed"), ("b", 5, "done"), ("c", 2, "done"), ("e", None, "done")], "k string, at int, status string")
    new = spark.createDataFrame([("a", 1, "done"), ("b", 4, "failed"), ("d", 3, None)], "k string, at int, status string")
    gone, wanted = spark.createDataFrame([("c",)], "k string"), spark.createDataFrame([(k,) for k in "abcdef"], "k string")
    state, todo = catalog.merged_state(old, new, "k", "at", gone, wanted)
    assert {(r.k, r.status) for r in state.collect()} == {("a", "done"), ("b", "done"), ("d", None), ("e", "done")}
    assert {r.k for r in todo.collect()} == {"c", "d", "f"} and {r.k for r in catalog.merged_state(old, new, "k", "at")[1].collect()} == {"d"}


def test_unknown_step():
    with pytest.raises(ValueError, match="no step 'nothing'; there are acg, burstiness, cells"):
        steps.run("nothing")


def test_restricted_statistics_are_those_of_the_targets(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(20, 3)), rng.normal(size=(20, 4))
    whole = spark.createDataFrame([(0, 0, en.pack(x, y).tolist())], "pid int, fold int, s array<double>")
    (got,) = en.only_targets(whole, 3, 4, [1, 3]).collect()
    assert np.allclose(got.s, en.pack(x, y[:, [1, 3]]), rtol=1e-12, atol=1e-12)


def test_counts_around_trials_against_loops(spark):
    from recloom.operators import events as ev

    rng = np.random.default_rng(6)
    tr = [(int(k), i, float(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 2, 15), rng.integers(-20, 40, 15), strict=True))] + [(0, 99, None)]
    es = [(int(k), int(u), float(t)) for k, u, t in zip(rng.integers(0, 2, 200), rng.integers(0, 3, 200), rng.integers(-40, 60, 200) / 2, strict=True)] + [(0, 0, None)]
    x = ev.trial_counts(spark.createDataFrame(tr, "eid int, trial int, t double"), spark.createDataFrame(es, "eid int, u int, s double"), ["eid"], "trial", "t", "u", "s", -2.0, 0.5, 8)
    want = {}
    for k, i, t in tr:
        for k2, u, s in es:
            if k == k2 and t is not None and s is not None and 0 <= np.floor((s - (t - 2.0)) / 0.5) < 8:
                at = (k, i, u, int(np.floor((s - (t - 2.0)) / 0.5)))
                want[at] = want.get(at, 0) + 1
    assert {(r.eid, r.trial, r.unit, r.bin): r.n for r in x.collect()} == want and want


def test_two_classes_are_decoded(spark):
    rng = np.random.default_rng(7)
    rows = []
    for eid, gain in ((0, 6.0), (1, 0.0)):
        for i in range(120):
            y = float(rng.integers(0, 2))
            rows.append((eid, i, y, (rng.normal(size=4) + gain * y * np.array([1, 0, 0, 1])).tolist()))
    rows += [(2, i, 1.0, [float(i)] * 4) for i in range(10)] + [(3, 0, 1.0, [0.0] * 4)]
    x = spark.createDataFrame([(e, i, c, [y]) for e, i, y, c in rows], "eid int, trial int, x array<double>, y array<double>")
    got = {r.eid: r.score for r in de.decode_classes(x, ["eid"], "trial", 1).collect()}
    assert got[0] == 1.0 and 0.3 < got[1] < 0.7 and got[2] is None and got[3] is None
    line = {r.eid: r.score for r in de.decode(x, ["eid"], "trial", 1).collect()}
    assert line[0] > 0.8 and line[2] is None


def test_logistic_is_at_the_minimum():
    from recloom.functions.kernels import logistic

    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(80, 3)), rng.integers(0, 2, 80).astype(float)
    w = logistic(x, y, 2.0)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(x.T @ (p - y) + 2.0 * w[:-1]).max() < 1e-8 and abs((p - y).sum()) < 1e-6
