"""Properties and numpy twins of the numeric operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recloom.functions import kernels
from recloom.operators import catalog, encoding, events, qc, signal, tables

RNG = np.random.default_rng(3)


def test_fold_label_is_truncated_linspace(spark):
    for n, k in ((5, 2), (17, 5), (103, 7), (400, 3)):
        edges = np.linspace(0, n, k + 1).astype(int)
        want = np.searchsorted(edges, np.arange(n), "right") - 1
        got = [r[0] for r in spark.range(n).orderBy("id").select(encoding.fold_label(F.col("id"), F.lit(n), k)).collect()]
        assert got == want.tolist()


def test_expand_is_the_direct_sum():
    base, b, n_pre = RNG.normal(size=(40, 2)), RNG.normal(size=(7, 3)), 2
    x = encoding.expand(base, b, n_pre)
    for i in range(40):
        for r in range(2):
            for k in range(3):
                want = sum(b[j, k] * base[i - (j - n_pre), r] for j in range(7) if 0 <= i - (j - n_pre) < 40)
                assert abs(x[i, r * 3 + k] - want) < 1e-10


def test_packs_merge_and_r2_equals_predictions():
    x, y = RNG.normal(size=(200, 5)), RNG.normal(size=(200, 2))
    y[:, 0] += x @ np.arange(5)
    whole, parts = encoding.pack(x, y), encoding.pack(x[:70], y[:70]) + encoding.pack(x[70:], y[70:])
    assert np.allclose(whole, parts)
    a = encoding.centred(whole[None], 5, 2)
    w, there = encoding.fits(a, np.eye(5), [1.0], np.arange(5))
    mx, my = x.mean(0), y.mean(0)
    assert there.all() and np.allclose(w[0, 0], np.linalg.solve((x - mx).T @ (x - mx) + np.eye(5), (x - mx).T @ (y - my)), atol=1e-12)
    pred = (x - mx) @ w[0, 0] + my
    want = 1 - ((y - pred) ** 2).sum(0) / ((y - my) ** 2).sum(0)
    assert np.allclose(encoding.r2(a, a, w, np.arange(5))[0, 0], want, atol=1e-12)
    flat = encoding.centred(encoding.pack(x, np.ones((200, 2)))[None], 5, 2)
    assert np.isnan(encoding.r2(flat, flat, np.zeros((1, 1, 5, 2)), np.arange(5))).all()


def test_penalties_by_one_factorisation_are_the_systems_own():
    """Against a solution per penalty, 0 and far apart, of a stack with a singular system."""
    x, y = RNG.normal(size=(3, 80, 8)) * [1, 50, 0.02, 1, 1, 3, 1, 1], RNG.normal(size=(3, 80, 2))
    x[1, :, 7] = 0
    pen = encoding.penalty(["a", "b"], 4, {"a": 1.0, "b": 1.0})
    lambdas, keep = [0.0, 1e-3, 1.0, 1e4], np.arange(8)
    got, there = encoding.fits(encoding.centred(np.stack([encoding.pack(a, b) for a, b in zip(x, y, strict=True)]), 8, 2), pen, lambdas, keep)
    assert there.tolist() == [[True] * 4, [False, True, True, True], [True] * 4]
    for k in range(3):
        a, b = x[k] - x[k].mean(0), y[k] - y[k].mean(0)
        for i, lam in enumerate(lambdas):
            if there[k, i]:
                assert np.allclose(got[k, i], np.linalg.solve(a.T @ a + lam * pen, a.T @ b), rtol=1e-8, atol=1e-9)
    none, there = encoding.fits(encoding.centred(np.stack([encoding.pack(x[0], y[0])]), 8, 2), pen, lambdas, keep[:0])
    assert none.shape == (1, 4, 0, 2) and there.all()


def recording(spark, n=230, pid="a", constant=False):
    x, y = RNG.normal(size=(n, 2)), RNG.normal(size=(n, 2))
    if constant:
        x[:, 1] = 0
    df = spark.createDataFrame([(pid, i, n, x[i].tolist(), y[i].tolist()) for i in range(n)], "pid string, i long, n long, x array<double>, y array<double>")
    return df, x, y


def test_statistics_do_not_depend_on_chunks(spark):
    df, x, y = recording(spark)
    b = RNG.normal(size=(9, 2))
    full = encoding.expand(x, b, 3)
    fold = ((np.arange(230) + 1) * 4 - 1) // 230
    for size in (1000, 37):
        got = {r.fold: np.array(r.s) for r in encoding.gathered(encoding.statistics(df, ["pid"], b, 3, 4, size), ["pid"]).collect()}
        for k in range(4):
            assert np.allclose(got[k], encoding.pack(full[fold == k], y[fold == k]))


def test_solve_matches_numpy_and_survives_singular(spark):
    df, x, y = recording(spark)
    bad, *_ = recording(spark, pid="b", constant=True)
    b = np.eye(1)
    out = encoding.solve(encoding.statistics(df.unionByName(bad), ["pid"], b, 0, 4), ["pid"], ["g", "h"], 1, 2, [0.0], drop=True).collect()
    assert {r.status == "ok" for r in out if r.pid == "a"} == {True}
    assert all(r.r2_cv is None and r.status != "ok" for r in out if r.pid == "b" and r.dropped != "h")
    fold = ((np.arange(230) + 1) * 4 - 1) // 230
    scores = []
    for k in range(4):
        tr = fold != k
        mx, my = x[tr].mean(0), y[tr].mean(0)
        w = np.linalg.lstsq(x[tr] - mx, y[tr] - my, rcond=None)[0]
        p, own = (x[~tr] - mx) @ w + my, y[~tr]
        scores.append(1 - ((own - p) ** 2).sum(0) / ((own - own.mean(0)) ** 2).sum(0))
    got = [r.r2_cv for r in sorted(out, key=lambda r: r.target) if r.pid == "a" and r.dropped == ""]
    assert np.allclose(got, np.mean(scores, 0))


def test_penalty_and_groups():
    assert np.array_equal(encoding.second_difference(2), np.eye(2))
    assert np.linalg.matrix_rank(encoding.second_difference(10)) == 8
    p = encoding.penalty(["a", "b"], 4, {"a": 2.0})
    assert np.array_equal(p[:4, :4], 2 * encoding.second_difference(4)) and not p[4:].any()
    assert np.array_equal(encoding.penalty(["a", "a"], 1, {"a": 3.0}), 3 * np.eye(2))


def test_left_out_columns_are_as_if_never_there():
    x, y = RNG.normal(size=(90, 4)), RNG.normal(size=(90, 2))
    keep = np.array([0, 3])
    whole, some = encoding.centred(encoding.pack(x, y)[None], 4, 2), encoding.centred(encoding.pack(x[:, keep], y)[None], 2, 2)
    w, _ = encoding.fits(whole, np.eye(4), [1.0, 7.0], keep)
    few, _ = encoding.fits(some, np.eye(2), [1.0, 7.0], np.arange(2))
    assert np.allclose(w, few) and np.allclose(encoding.r2(whole, whole, w, keep), encoding.r2(some, some, few, np.arange(2)))


def test_keys_stream_in_any_partition(spark):
    """Many keys, null ones and designs of two sizes, a stack of one key at a time or all at once, parts in pieces."""
    rows, want = [], {}
    for k in [*range(60), None]:
        p = 1 + (k or 0) % 2
        x, y = RNG.normal(size=(40, p)), RNG.normal(size=(40, 1))
        mx, my = x.mean(0), y.mean(0)
        want[k] = np.linalg.solve((x - mx).T @ (x - mx) + 2 * np.eye(p), (x - mx).T @ (y - my))
        rows += [(k, fold, encoding.pack(x[at], y[at]).tolist()) for fold in range(2) for at in (range(fold * 20, fold * 20 + 7), range(fold * 20 + 7, fold * 20 + 20))]
    RNG.shuffle(rows)
    packs = spark.createDataFrame([(k if k is None else int(k), int(f), list(s)) for k, f, s in rows], "pid int, fold int, s array<double>").repartition(5)
    for bytes_ in (1, 1 << 20):
        old, encoding.STACK_BYTES = encoding.STACK_BYTES, bytes_
        try:
            got = {}
            for r in encoding.weights(packs, ["pid"], {1: ["a"], 2: ["a", "b"]}, 1, 1, 2.0).collect():
                got.setdefault(r.pid, {})[r.r] = r.w
            fit = encoding.solve(packs, ["pid"], {1: ["a"], 2: ["a", "b"]}, 1, 1, [2.0, 5.0]).collect()
        finally:
            encoding.STACK_BYTES = old
        assert set(got) == set(want) and all(np.allclose([got[k][r] for r in range(len(want[k]))], want[k].ravel()) for k in want)
        assert len(fit) == sum(2 * (1 + len(w)) for w in want.values()) and all(r.status == "ok" and r.r2_cv is not None for r in fit)


def test_whole_recordings_are_fitted_where_they_lie(spark):
    """Samples and draws are what is shuffled; short and long recordings, gaps, and designs of two sizes score as from statistics."""
    rows, draws = [], []
    for k, n, p in (("a", 90, 2), ("b", 41, 1), ("c", 200, 2), ("d", 60, 2)):
        for i in range(n):
            if k != "d" or i % 7:
                rows.append((k, i, n, RNG.normal(size=p).tolist(), RNG.normal(size=2).tolist()))
        draws += [(k, m, 13 * m + 4) for m in range(3)]
    df = spark.createDataFrame(rows, "pid string, i long, n long, x array<double>, y array<double>")
    d = spark.createDataFrame(draws, "pid string, perm int, shift long")
    groups, b, f = {1: ["g"], 2: ["g", "h"]}, RNG.normal(size=(4, 2)), ["pid", "lam", "dropped", "target", "r2_full", "r2_cv"]
    for lambdas in ([2.0, 50.0], [0.0, 50.0]):
        fit, got = encoding.scoring(groups, 2, 2, lambdas), {}
        for name, x in {
            "seen": encoding.fit_rows(df, ["pid"], b, 1, 4, 2, fit, size=100).withColumn("perm", F.lit(-1)),
            "seen_packs": encoding.solve(encoding.chunk_packs(df, ["pid"], b, 1, 4), ["pid"], groups, 2, 2, lambdas).withColumn("perm", F.lit(-1)),
            "null": encoding.fit_rows(df, ["pid"], b, 1, 4, 2, fit, d, size=100),
            "null_packs": encoding.solve(encoding.null_packs(df, ["pid"], d, b, 1, 4), ["pid", "perm"], groups, 2, 2, lambdas),
        }.items():
            got[name] = {(r.pid, r.perm, r.lam, r.dropped, r.target): (r.r2_full, r.r2_cv) for r in x.select("perm", *f).collect()}
        for name in ("seen", "null"):
            assert got[name].keys() == got[name + "_packs"].keys() and len({k[0] for k in got[name]}) == 4
            assert all(np.allclose(v, got[name + "_packs"][k], atol=1e-9) for k, v in got[name].items())


def test_laid_samples_are_fitted_as_samples(spark, monkeypatch):
    """Recordings in one row, in several, with gaps, and long ones; draws as a table and as an array."""
    monkeypatch.setattr(encoding, "LAID", 50)
    rows = [(k, i, n, RNG.normal(size=p).tolist(), RNG.normal(size=2).tolist()) for k, n, p in (("a", 90, 2), ("b", 41, 1), ("c", 200, 2), ("d", 45, 2)) for i in RNG.permutation(n).tolist() if k != "d" or i % 7]
    df = spark.createDataFrame(rows, "pid string, i long, n long, x array<double>, y array<double>")
    laid = encoding.laid(df, ["pid"])
    assert sorted((r.pid, len(r.i), r.whole) for r in laid.collect()) == [("a", 40, False), ("a", 50, False), ("b", 41, True), *[("c", 50, False)] * 4, ("d", 38, False)]
    assert {(r.pid, r.i, r.n, *r.x, *r.y) for r in encoding.samples(laid, ["pid"]).collect()} == {(k, i, n, *x, *y) for k, i, n, x, y in rows}
    table = df.select("pid", "n").distinct().selectExpr("pid", "explode(sequence(0, 2)) as perm").withColumn("shift", F.col("perm") * 13 + 4)
    array = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda p: F.struct(p.alias("perm"), (p * 13 + 4).cast("long").alias("shift")))
    groups, b = {1: ["g"], 2: ["g", "h"]}, RNG.normal(size=(4, 2))
    for fit in (encoding.scoring(groups, 2, 2, [2.0, 50.0]), encoding.weighing(groups, 2, 2, 2.0)):
        for few in (0, 100):
            monkeypatch.setattr(encoding, "FEW_PRODUCTS", few)
            got = []
            for x, d in ((df, None), (laid, None), (df, table), (laid, table), (laid, array)):
                found = encoding.fit_rows(x, ["pid"], b, 1, 4, 2, fit, d, size=100)
                keys = [c for c, k in found.dtypes if k != "double"] + ["lam"] * ("lam" in found.columns)
                numbers = [c for c in found.columns if c not in keys]
                got.append({tuple(r[c] for c in keys): tuple(r[c] for c in numbers) for r in found.collect()})
            for want, other in ((0, 1), (2, 3), (2, 4)):
                assert got[want].keys() == got[other].keys() and len({k[0] for k in got[want]}) == 4
                assert all(np.allclose(v, got[other][k], atol=1e-9) for k, v in got[want].items())


def test_selection_rules(spark):
    rows = [("g", 1.0, 0.5), ("g", 1.0, -5.0), ("g", 10.0, 0.2), ("g", 10.0, 0.2), ("g", 100.0, 0.2), ("g", 100.0, 0.2), ("h", 1.0, -9.0), ("h", 10.0, float("nan")), ("h", 100.0, -8.0)]
    got = {r.grp: (r.lam, r.fell_back) for r in encoding.pick_lambda_robust(spark.createDataFrame(rows, "grp string, lam double, r2 double"), ["grp"]).collect()}
    assert got == {"g": (10.0, False), "h": (100.0, True)}


def test_p_value_with_ties_and_missing(spark):
    null = spark.createDataFrame([(1, 0.1), (1, 0.5), (1, float("nan")), (2, 0.9)], "t int, r2 double")
    seen = spark.createDataFrame([(1, 0.5), (2, float("nan"))], "t int, r2 double")
    got = {r.t: r.p_value for r in encoding.p_value(null, seen, ["t"]).collect()}
    assert got == {1: 2 / 4, 2: 1 / 2}


def test_null_rows_keep_all_samples(spark):
    df, x, y = recording(spark, 50)
    out = encoding.null_rows(df, ["pid"], spark.createDataFrame([("a", 50, 0, 12)], "pid string, n long, perm int, shift long")).orderBy("i").collect()
    assert np.allclose([r.x for r in out], np.roll(x, 12, axis=0)) and np.allclose([r.y for r in out], y)


def test_envelope_of_a_tone():
    t = np.arange(2000) / 250
    e = kernels.envelope(3 * np.sin(2 * np.pi * 6 * t), 250, (4, 8))
    assert abs(np.exp(e[500:1500]).mean() - 3) < 0.05
    assert np.exp(kernels.envelope(3 * np.sin(2 * np.pi * 60 * t), 250, (4, 8))[500:1500]).max() < 0.05
    assert len(kernels.envelope(np.zeros(300), 250, (4, 8))) == 300


def test_welch_finds_the_tone():
    f, p = kernels.welch(np.sin(2 * np.pi * 40 * np.arange(1000) / 250), 250, 100)
    assert f[p.argmax()] == 40 and abs(p.sum() * (f[1] - f[0]) - 0.5) < 0.3


def test_waveform_shape():
    w = np.zeros(60)
    w[20], w[30], w[10] = -4, 2, 1
    s = kernels.waveform_shape(w, 1.0, 5)
    assert (s["peak_time_idx"], s["peak_val"], s["trough_time_idx"], s["tip_time_idx"], s["recovery_time_idx"]) == (20, -4, 30, 10, 35)
    assert s["repolarisation_slope"] == pytest.approx(0.6)
    assert kernels.waveform_shape(np.zeros(5), 1.0)["peak_val"] == 0


def test_poisson():
    from math import exp, factorial

    for k, m in ((0, 0.5), (3, 2.0), (10, 4.0), (2, 0.0)):
        assert events.poisson_cdf(np.array([k]), np.array([m]))[0] == pytest.approx(sum(exp(-m) * m**i / factorial(i) for i in range(k + 1)) if m else 1.0)


def test_poisson_of_large_counts():
    for k, m in ((500, 480.0), (50, 90.0), (9000, 9100.0)):
        i = np.arange(k + 1)
        logs = i * np.log(m) - m - np.concatenate(([0], np.cumsum(np.log(np.arange(1, k + 1)))))
        assert events.poisson_cdf(np.array([k]), np.array([m]))[0] == pytest.approx(np.exp(logs).sum(), rel=1e-8)
    assert events.poisson_cdf(np.array([10**7]), np.array([1e7]))[0] == pytest.approx(0.5, abs=1e-3)
    assert events.poisson_cdf(np.array([10**7, 10]), np.array([1e6, 1e9])).tolist() == [1.0, 0.0]


def test_quantiles_are_exact(spark):
    skew = np.concatenate((RNG.normal(size=400), [1e6, -1e9, 5e-324, -5e-324, 1e308], 1e6 + RNG.normal(size=50) * 1e-6, np.zeros(300)))
    rows = [("a", float(v)) for v in skew] + [("b", 2.5)] * 7 + [("c", 1.0), ("c", 4.0), (None, 3.0), (None, 5.0), ("d", None), ("d", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    for cells in (1, 5, 4096):
        got = {r.g: r.q for r in qc.quantiles(df, ["g"], "v", probs, cells).collect()}
        assert set(got) == {"a", "b", "c", None}
        for g in got:
            assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g], probs))


def test_low_pass_keeps_tones_below_and_removes_those_above():
    t = np.arange(4000) / 1000
    tone = lambda f: np.abs(kernels.low_pass(np.sin(2 * np.pi * f * t), 1000, 0.4 * 250)[500:-500]).max()
    assert tone(60) > 0.99 and tone(130) < 0.001 and tone(400) < 1e-6


def test_interval_exclusion_with_nulls(spark):
    ev = spark.createDataFrame([(1, 5.0, None), (1, 50.0, "x"), (1, None, "y"), (None, 5.0, None), (1, 5.0, None), (1, -3.0, "z"), (1, 10.5, "w")], "k int, t double, note string")
    spans = spark.createDataFrame([(1, 4.0, 6.0), (None, 100.0, 101.0), (1, 9.0, 10.0)], "k int, start double, end double")
    for width in (0.7, 3.0, 1000.0):
        out = sorted((tuple(r) for r in signal.overlapping(ev, spans, ["k"], "t", -1.0, 0.5, width).collect()), key=str)
        assert out == sorted([(1, 50.0, "x"), (1, None, "y"), (None, 5.0, None), (1, -3.0, "z")], key=str)
        hit = [tuple(r) for r in signal.overlapping(ev, spans, ["k"], "t", -1.0, 0.5, width, "left_semi").collect()]
        assert sorted(hit, key=str) == sorted([(1, 5.0, None)] * 2 + [(1, 10.5, "w")], key=str)


def test_rates_within_parts_of_a_second(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate((0.0, 0.3, 0.45, 0.9, 2.0, 2.6))], "u int, id int, tm double")
    out = events.acg_by_rate_decile(df, ["u"], "tm", "id", 0.5, 0.01, 1.0, 10, 0.05)
    got = sum(r.n for r in out.collect())
    assert got == 2 * sum(1 for a in (0.0, 0.3, 0.45, 0.9, 2.0, 2.6) for b in (0.0, 0.3, 0.45, 0.9, 2.0, 2.6) if 0 < b - a <= 1.0)
    many = spark.createDataFrame([(1, i, t) for i, t in enumerate([0.0] + [10 + 0.1 * k for k in range(9)])], "u int, tm_id int, tm double")
    first = events.acg_by_rate_decile(many, ["u"], "tm", "tm_id", 0.5, 0.01, 1.0, 10, 0.05).filter("decile = 1")
    assert first.count() == 0  # the lone event has the lowest rate and no pair


@pytest.mark.parametrize("width", [None, 0.5, 3.0, 100.0])
def test_as_of_and_resample_in_buckets(spark, width):
    ts, at = np.sort(RNG.uniform(0, 20, 60)).round(2), np.sort(RNG.uniform(-2, 25, 40)).round(2)
    ts[10:13] = ts[10]
    grid = spark.createDataFrame([(k, i, float(t)) for k in (1, 2) for i, t in enumerate(at)], "k int, i long, t double")
    ev = spark.createDataFrame([(1, float(t), j) for j, t in enumerate(ts)], "k int, tm double, id long")
    got = {r.id: r.i for r in signal.as_of_next(ev, grid, ["k"], "tm", width).collect()}
    firsts = np.minimum(np.searchsorted(at, ts, "left"), len(at) - 1)
    assert [at[got[j]] for j in range(60)] == [at[i] for i in firsts]
    uniq = np.unique(ts)
    src = spark.createDataFrame([(1, float(t), float(np.sin(t))) for t in uniq], "k int, t double, v double")
    v = {r.i: r.v for r in signal.resample(src, grid, ["k"], width).collect() if r.k == 1}
    assert np.allclose([v[i] for i in range(40)], np.interp(at, uniq, np.sin(uniq)))


def test_unknown_kinds_have_no_settings(spark):
    ev, conf = spark.createDataFrame([(1, "a"), (2, "b")], "id int, kind string"), spark.createDataFrame([("a", 0.5)], "kind string, lo double")
    assert tables.settings_of(ev.filter("id = 1"), conf, "kind").first().lo == 0.5
    with pytest.raises(Exception, match="no kind b"):
        tables.settings_of(ev, conf, "kind").collect()


def test_pairs_are_all_pairs(spark):
    t = np.sort(RNG.uniform(0, 50, 80)).round(3)
    df = spark.createDataFrame([(1, float(x)) for x in t] + [(2, 5.0), (2, 5.0), (3, 1.0)], "u int, tm double")
    got = sorted(round(r.lag, 6) for r in events.pairs(df, ["u"], "tm", 4.0).collect())
    assert got == sorted(round(b - a, 6) for a in t for b in t if 0 < b - a <= 4.0)


def test_contaminated_has_three_states(spark):
    sp = spark.createDataFrame([(1, 0.0, 1), (1, 0.0015, 2), (2, 3.0, 3), (3, 0.0, 4), (3, 0.0014, 5)], "u int, tm double, id int")
    units = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "u int")
    got = {r.u: r.is_contaminated for r in events.contaminated(sp, units, ["u"], "tm", "id", 0.0015).collect()}
    assert got == {1: False, 2: False, 3: True, 4: None}


def test_position_join_ignores_the_origin(spark):
    pts = spark.createDataFrame([(1, i * 2, i * i) for i in range(9)], "pid int, x long, y long")
    ref = [(1, i * 2, i * i, i, f"r{i}") for i in range(9)]
    for dx, dy in ((0, 0), (50, -31)):
        tab = spark.createDataFrame([(p, x + dx, y + dy, o, a) for p, x, y, o, a in ref], "pid int, x long, y long, order int, acronym string")
        out = tables.position_join(pts, tab, "pid", ["x", "y"], 0.5, {"acronym": "void"}).collect()
        assert len(out) == 9 and all(r.acronym == f"r{r.x // 2}" for r in out)


def test_event_edges_and_collisions(spark):
    ev = spark.createDataFrame([(1, -5.0, 1.0), (1, 2.0, 1.0), (1, 1.2, 2.0), (1, 99.0, 4.0), (1, None, 8.0)], "k int, t double, w double")
    grid = spark.range(5).select(F.lit(1).alias("k"), F.col("id").alias("i"))
    got = {r.i: r.w for r in signal.event_to_grid(ev, grid, ["k"], "t", "w", 0.0, 1.0).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: 3.0, 3: 0.0, 4: 4.0}


def test_resample_is_interp(spark):
    ts, vs = np.sort(RNG.uniform(0, 10, 12)), RNG.normal(size=12)
    src = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(ts, vs, strict=True)] + [(1, 5.0, None), (1, 6.0, float("nan"))], "k int, t double, v double")
    grid = spark.createDataFrame([(1, i, float(i) - 2) for i in range(15)], "k int, i long, t double")
    got = [r.v for r in signal.resample(src, grid, ["k"]).orderBy("i").collect()]
    assert np.allclose(got, np.interp(np.arange(15) - 2.0, ts, vs))


def test_zscore_of_a_constant(spark):
    out = signal.zscore(spark.createDataFrame([(1, 4.0), (1, 4.0), (2, 1.0), (2, 3.0)], "k int, v double"), ["k"], "v").collect()
    assert sorted((r.k, r.z) for r in out) == [(1, 0.0), (1, 0.0), (2, -1.0), (2, 1.0)]


def test_low_rank_is_truncated_svd(spark):
    v = RNG.normal(size=(50, 6)) @ np.diag([9, 5, 1, 0.1, 0.05, 0.01])
    df = spark.createDataFrame([(0, i, c, float(v[i, c])) for i in range(50) for c in range(6)], "chunk int, i long, c int, v double").repartition(3)
    r = signal.low_rank_report(signal.gram_packs(signal.sample_vectors(df, ["chunk"], "i", "c", "v"), ["chunk"]), ["chunk"], 0.05).first()
    u, s, w = np.linalg.svd(v, full_matrices=False)
    approx = (u[:, : r["rank"]] * s[: r["rank"]]) @ w[: r["rank"]]
    assert r.rmse == pytest.approx(np.sqrt(((v - approx) ** 2).mean()), rel=1e-6)
    assert (r.nc, r.ns) == (6, 50) and r.total == pytest.approx((v**2).sum()) and r.kept == pytest.approx((approx**2).sum())


def test_gram_of_samples_that_lack_channels(spark):
    """Missing values and samples, null chunks, a budget of one matrix, and rows whose length is wrong."""
    rows = [(k, i, c, None if (i + c) % 5 == 0 else float(RNG.normal())) for k in ("a", None) for i in range(40) for c in range(4) if (i, c) != (3, 2)]
    df = spark.createDataFrame(rows, "chunk string, i long, c int, v double")
    vectors = signal.sample_vectors(df, ["chunk"], "i", "c", "v")
    for held in (1, 1 << 20):
        got = {(r.chunk, r.a, r.b): (r.g, r.n) for r in signal.channel_gram(signal.gram_packs(vectors, ["chunk"], held), ["chunk"]).collect()}
        of = {(k, i, c): v for k, i, c, v in rows if v is not None}
        want = {}
        for (k, i, c), v in of.items():
            for e in range(c, 4):
                if (k, i, e) in of:
                    g, n = want.get((k, c, e), (0, 0))
                    want[k, c, e] = g + v * of[k, i, e], n + 1
        assert set(got) == set(want) and all(got[x] == (pytest.approx(want[x][0]), want[x][1]) for x in want)
    empty = spark.createDataFrame([(1, [0, 1], []), (1, [0, 1], None), (2, [], [])], "chunk int, c array<int>, x array<double>")
    assert signal.gram_packs(empty, ["chunk"]).count() == 0
    with pytest.raises(Exception, match="another length"):
        signal.gram_packs(spark.createDataFrame([(1, [0, 1], [1.0])], "chunk int, c array<int>, x array<double>"), ["chunk"]).collect()


def test_strict_lookup_fails(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no k 2"):
        tables.strict_lookup(a, b, "k").collect()
    with pytest.raises(Exception, match="differ in length"):
        tables.common_grid(a, b, ["k"], strict=True).collect()


def test_ratio_and_histogram_edges(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(qc.ratio(F.col("a"), F.col("b"))).collect()] == [None, None]
    one = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    assert [tuple(r) for r in qc.histogram(one, "v").collect()] == [(0, 2)]
    assert qc.nan_to_null(spark.createDataFrame([(float("nan"),)], "v double"), "v").first()[0] is None


def test_ranks_without_one_task(spark):
    got = sorted((r.id, r["rank"]) for r in catalog.ranked(spark.range(500).repartition(7), "id").collect())
    assert got == [(i, i) for i in range(500)]


def test_one_group_equals_the_pooled_fit(spark):
    df, *_ = recording(spark)
    stats = encoding.statistics(df, ["pid"], np.eye(1), 0, 4)
    scores = encoding.solve(stats, ["pid"], ["g", "h"], 1, 2, [1.0, 10.0], drop=False)
    groups = spark.createDataFrame([(0, "all"), (1, "all")], "target int, grp string")
    got = encoding.per_group(scores, groups, spark.createDataFrame([("a", "all", 10.0)], "pid string, grp string, lam double"), ["pid"])
    pooled = encoding.solve(stats, ["pid"], ["g", "h"], 1, 2, [10.0], drop=False)
    want = {r.target: r.r2_cv for r in pooled.collect()}
    assert {r.target: r.r2_cv for r in got.collect()} == pytest.approx(want, rel=1e-9)
    with pytest.raises(Exception, match="no penalty for group all"):
        encoding.per_group(scores, groups, spark.createDataFrame([("a", "other", 10.0)], "pid string, grp string, lam double"), ["pid"]).collect()
