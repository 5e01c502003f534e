"""Published runs, streamed files, patch steps."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from recloom.operators import encoding as en
from recloom.operators import steps
from recloom.sources import files, readers, runs


def test_what_breaks_off_is_not_seen(spark, tmp_path):
    path, keys = f"file://{tmp_path}/run", ["source", "pid"]
    scores = spark.createDataFrame([("full", p, float(p)) for p in range(4)], "source string, pid int, r2 double")
    weights = spark.createDataFrame([("full", p, k, 1.0) for p in range(4) for k in range(2)], "source string, pid int, k int, w double")
    assert runs.pending(scores, path, keys).count() == 4
    with pytest.raises(ValueError, match="nothing is published"):
        runs.read(spark, path, "scores", keys)
    broken = weights.withColumn("w", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        runs.publish(path, {"scores": scores, "weights": broken}, keys)
    assert runs.pending(scores, path, keys).count() == 4
    with pytest.raises(ValueError, match="nothing is published"):
        runs.read(spark, path, "scores", keys)
    runs.publish(path, {"scores": scores.filter("pid < 2"), "weights": weights.filter("pid < 2")}, keys)
    assert {r.pid for r in runs.pending(scores, path, keys).collect()} == {2, 3}
    with pytest.raises(Exception, match="lost"):
        runs.publish(path, {"scores": scores.filter("pid >= 2"), "weights": broken}, keys)
    assert {r.pid for r in runs.read(spark, path, "scores", keys).collect()} == {0, 1} and runs.read(spark, path, "weights", keys).count() == 4
    runs.publish(path, {"scores": scores.filter("pid > 0").withColumn("r2", F.lit(9.0)), "weights": weights.filter("pid > 0")}, keys)
    assert {(r.pid, r.r2) for r in runs.read(spark, path, "scores", keys).collect()} == {(0, 0.0), (1, 9.0), (2, 9.0), (3, 9.0)}
    assert runs.read(spark, path, "weights", keys).count() == 8 and runs.pending(scores, path, keys).count() == 0


def test_p_values_at_the_rows_own_penalty(spark):
    scores = spark.createDataFrame([(1, "pooled", 0, 1.0, 0.5), (1, "per_target", 0, 10.0, 0.5), (2, "pooled", 0, 1.0, 0.1)], "pid int, mode string, target int, lam double, r2_cv double")
    null = spark.createDataFrame([(1, p, 0, lam, "", v) for lam, vs in ((1.0, (0.6, 0.7, 0.1)), (10.0, (0.1, 0.2, 0.3))) for p, v in enumerate(vs)], "pid int, perm int, target int, lam double, dropped string, r2_cv double")
    got = {(r.pid, r["mode"]): (r.p_value, r.null_p95) for r in en.with_null(scores, null, ["pid"]).collect()}
    assert got[1, "pooled"] == (0.75, pytest.approx(0.69)) and got[1, "per_target"] == (0.25, pytest.approx(0.29)) and got[2, "pooled"] == (None, None)
    meta = spark.createDataFrame([(1, 0, "raw", "CA1")], "pid int, target int, band string, acronym string")
    out = en.described(scores, meta, ["pid"])
    assert out.columns[:4] == ["pid", "target", "band", "acronym"] and sorted((r.pid, r.acronym or "") for r in out.collect()) == [(1, "CA1"), (1, "CA1"), (2, "")]


def test_large_files_are_streamed(spark, tmp_path):
    size = 3 << 30
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(size)
    (tmp_path / "small.bin").write_bytes(b"abc")
    own, folders = readers.checksums(spark, f"file://{tmp_path}", "*.bin")
    want = hashlib.md5()
    for _ in range(size >> 20):
        want.update(bytes(1 << 20))
    got = {os.path.basename(r.path): r.md5 for r in own.collect()}
    assert got == {"large.bin": want.hexdigest(), "small.bin": hashlib.md5(b"abc").hexdigest()}
    assert folders.first().md5 == hashlib.md5("".join(sorted(got.values())).encode()).hexdigest()


def test_only_the_end_of_a_log_is_read(spark, tmp_path):
    with open(tmp_path / "a.log", "wb") as f:
        f.truncate(1 << 30)
        f.seek(1 << 30)
        f.write(b"\nstep 3 s\ndone in 7200.0 s\n\n\n")
    (tmp_path / "b.log").write_bytes(b"x\n" + b"y" * 200_000 + b" 3600 s")
    (tmp_path / "c.log").write_bytes(b"\n\n\n")
    (tmp_path / "d.log").write_bytes(b"one line 1.2.3 s")
    (tmp_path / "e.log").write_bytes(b"")
    got = {os.path.basename(r.path): r.hours for r in readers.log_durations(spark, f"file://{tmp_path}/*.log").collect()}
    assert got == {"a.log": 2.0, "b.log": 1.0, "c.log": None, "d.log": None}
    lines = {os.path.basename(r.path): len(r.line) for r in files.last_lines(files.listing(spark, f"file://{tmp_path}/*.log", "*").filter("length > 0"), part=7).filter("path like '%b.log'").collect()}
    assert lines == {"b.log": 200_007}


def test_patches_change_their_columns_only(spark):
    spikes = spark.createDataFrame([(u, 10.0 * u + 0.3 * i * (1 + i % 3)) for u in range(3) for i in range(40)], "unit int, tm double")
    stored = spark.createDataFrame([(u, f"n{u}", 0.0, "old") for u in range(4)], "unit int, name string, slidingRP_n_spikes double, slidingRP_note string")
    options = {"unit": ["unit"], "time": "tm"}
    got = steps.run("patch_slidingrp", stored, spikes, **options, duration=100.0, taus=[0.1, 0.5, 1.0], levels=[1, 10])
    rows = {r.unit: r for r in got.collect()}
    assert set(rows) == {0, 1, 2, 3} and "slidingRP_note" not in got.columns and [rows[u].name for u in range(4)] == ["n0", "n1", "n2", "n3"]
    assert rows[0].slidingRP_n_spikes == 40 and rows[3].slidingRP_n_spikes is None
    again = steps.run("patch_slidingrp", got, spikes, **options, duration=100.0, taus=[0.1, 0.5, 1.0], levels=[1, 10])
    assert {r.unit: r for r in again.collect()} == rows
    acg = steps.run("patch_acg3d", stored, spikes.withColumn("event", F.monotonically_increasing_id()), **options, tie="event", half_window=2.0, bin_size=0.1, window=3.0, bins=5, trim=0.2)
    first = {r.unit: r.acg3d_counts for r in acg.collect()}
    assert first[3] is None and len(first[0]) > 5 and {c for c in acg.columns if c.startswith("slidingRP_")} == {"slidingRP_n_spikes", "slidingRP_note"}
    assert all(x["decile"] in range(1, 11) and x["n"] > 0 for x in first[0]) and first[0] == sorted(first[0], key=lambda x: (x["decile"], x["bin"]))
    with pytest.raises(ValueError, match="not in the stored table"):
        steps.run("patch_slidingrp", stored.filter("unit > 0"), spikes, **options, duration=100.0, taus=[0.1], levels=[1])
    with pytest.raises(ValueError, match="no step"):
        steps.run("patch", stored)
