"""Decoding against direct fits, and its null."""

import numpy as np
from pyspark.sql import functions as F

from recloom.functions import kernels
from recloom.operators import decoding as de

RNG = np.random.default_rng(5)


def sessions(spark, sizes=(40, 12), p=6, t=3):
    x = {k: RNG.poisson(2.0, (n, p + k)).astype(float) for k, n in enumerate(sizes)}
    y = {k: np.column_stack([x[k][:, 0] - x[k][:, 1] + 0.1 * RNG.normal(size=n), RNG.normal(size=(n, t - 1))]) for k, n in enumerate(sizes)}
    df = spark.createDataFrame([(k, i, x[k][i].tolist(), y[k][i].tolist()) for k in x for i in range(len(x[k]))], "eid int, trial int, x array<double>, y array<double>")
    return x, y, df


def orders(df, runs):
    """Trials of every session and run in the order of their folds."""
    out = {}
    for r in sorted(de.runs_of(df, ["eid"], "trial", runs).select("eid", "run", "i", "trial").collect(), key=lambda r: r.i):
        out.setdefault((r.eid, r.run), []).append(r.trial)
    return out


def test_linear_equals_direct_ridge(spark):
    x, y, df = sessions(spark)
    order = orders(df, 2)
    assert order[0, 0] == list(range(40)) and order[0, 1] != order[0, 0] and sorted(order[0, 1]) == order[0, 0]
    want = {}
    for k in x:
        runs = []
        for run in range(2):
            a, b = x[k][order[k, run]], y[k][order[k, run]]
            fold, scores = ((np.arange(len(a)) + 1) * 4 - 1) // len(a), []
            for f in range(4):
                tr = fold != f
                mx, my = a[tr].mean(0), b[tr].mean(0)
                w = np.linalg.solve((a[tr] - mx).T @ (a[tr] - mx) + 2.0 * np.eye(a.shape[1]), (a[tr] - mx).T @ (b[tr] - my))
                res = b[~tr] - (a[~tr] - mx) @ w - my
                scores.append(1 - (res**2).sum(0) / ((b[~tr] - b[~tr].mean(0)) ** 2).sum(0))
            runs.append(np.mean(scores, 0))
        want |= {(k, t): v for t, v in enumerate(np.mean(runs, 0))}
    got = {(r.eid, r.series): r.score for r in de.decode(df, ["eid"], "trial", 3, 2, 4, 2.0).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and got[0, 0] > 0.8


def test_two_classes_equal_direct_fits(spark):
    x, y, df = sessions(spark, (40, 5), 6)
    flat = F.transform("y", lambda v: (v > 0).cast("double"))
    got = {(r.eid, r.series): r.score for r in de.decode_classes(df.withColumn("y", flat), ["eid"], "trial", 3, 1, 4).collect()}
    for k in x:
        b, fold = (y[k] > 0).astype(float), ((np.arange(len(x[k])) + 1) * 4 - 1) // len(x[k])
        for t in range(3):
            pred, known = np.zeros(len(b)), len(set(b[:, t])) == 2
            for f in range(4):
                tr = fold != f
                known &= len(set(b[tr, t])) == 2
                if known:
                    m = x[k][tr].mean(0)
                    w = kernels.logistic(x[k][tr] - m, b[tr, t], 1.0)
                    pred[~tr] = (x[k][~tr] - m) @ w[:-1] + w[-1] > 0
            want = np.mean([(pred[b[:, t] == c] == c).mean() for c in (0, 1)]) if known else None
            assert got[k, t] == want
    assert got[0, 0] > 0.8


def test_logistic_side_by_side_and_at_its_optimum():
    x, y = RNG.normal(size=(50, 3)), (RNG.normal(size=(50, 4)) > 0).astype(float)
    y[:, 3] = x[:, 0] > 0  # separable
    both = kernels.logistic(x, y, 0.5)
    for t in range(4):
        assert np.allclose(both[:, t], kernels.logistic(x, y[:, t], 0.5), atol=1e-6)
        p = 1 / (1 + np.exp(-(x @ both[:-1, t] + both[-1, t])))
        assert np.abs(x.T @ (p - y[:, t]) + 0.5 * both[:-1, t]).max() < 1e-5


def test_features_and_null_series(spark):
    trials = spark.createDataFrame([("a", 1, 0.0, 5.0), ("a", 2, 1.0, 6.0), ("a", 3, 2.0, None), ("b", 4, 0.0, 7.0), ("b", 5, 1.0, 8.0), ("b", 6, 2.0, 9.0), ("c", 7, 0.0, float("nan"))], "s string, trial int, t double, y double")
    counts = spark.createDataFrame([("a", 1, "u", 0, 2), ("a", 2, "v", 1, 3), ("b", 4, "w", 1, 1)], "s string, trial int, unit string, bin long, n long")
    x = {r.trial: r.x for r in de.features(counts, trials, ["s"], "trial", 2).collect()}
    assert x == {1: [2, 0, 0, 0], 2: [0, 0, 0, 3], 3: [0, 0, 0, 0], 4: [0, 1], 5: [0, 0], 6: [0, 0]}
    y = {r.trial: r.y for r in de.other_sessions(trials, "s", "trial", "t", "y", 2).collect()}
    assert y == {1: [5, 7, 7], 2: [6, 8, 8], 4: [7, 5, 5], 5: [8, 6, 6], 6: [9, 5, 5]}
    assert de.other_sessions(trials.filter("s = 'a'"), "s", "trial", "t", "y", 2).count() == 0
    scores = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.6), (1, 2, None), (2, 0, None), (2, 1, 0.1), (3, 0, 0.2)], "k int, series int, score double")
    got = sorted((r.k, r.score, r.p_value) for r in de.against_null(scores, ["k"]).collect())
    assert got == [(1, 0.5, 1.0), (2, None, 0.5), (3, 0.2, None)]


def test_models_of_a_stack_are_each_their_own():
    x, y, used = RNG.normal(size=(7, 20, 3)), (RNG.random((7, 20)) > 0.5).astype(float), RNG.random((7, 20)) > 0.2
    y[0] = x[0, :, 0] > 0  # separable
    got = kernels.logistics(x, y, used, 0.5)
    assert all(np.allclose(got[k], kernels.logistic(x[k][used[k]], y[k][used[k]], 0.5), atol=1e-7) for k in range(7))


def test_scores_are_computed_once(spark):
    """Against the null and alone a score is the same row, so that the models must not run again for each."""
    x, y, df = sessions(spark, (40, 5), 6)
    seen = spark.sparkContext.accumulator(0)
    scores = de.decode(df, ["eid"], "trial", 3, 1, 4).rdd.map(lambda r: seen.add(1) or r).toDF("eid int, series int, score double")
    got = {r.eid: r for r in de.against_null(scores, ["eid"]).collect()}
    assert seen.value == 6 and got.keys() == {0, 1} and got[0].p_value == 1 / 3
