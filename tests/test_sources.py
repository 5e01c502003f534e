"""Files of each format, written to a temporary folder."""

import numpy as np
import pytest

from recloom.sources import files, readers, writers
from recloom.streaming import incremental


def test_arrays(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6.0).reshape(2, 3))
    np.save(tmp_path / "b.npy", np.zeros((0, 3)))
    got = {r.path.rsplit("/", 1)[1]: (r.shape, r["values"]) for r in files.npy(spark, str(tmp_path)).collect()}
    assert got == {"a.npy": ([2, 3], [0, 1, 2, 3, 4, 5]), "b.npy": ([0, 3], [])}
    got = sorted((r.at, r["values"]) for r in files.npy(spark, str(tmp_path), "a.npy", values=4).collect())
    assert got == [(0, [0, 1, 2, 3]), (4, [4, 5])]
    np.save(tmp_path / "c.npy", np.asfortranarray(np.arange(6.0).reshape(2, 3)))
    with pytest.raises(Exception, match="column order"):
        files.npy(spark, str(tmp_path), "c.npy").collect()


def test_raw(spark, tmp_path):
    np.arange(8, dtype="float16").tofile(tmp_path / "x.bin")
    got = sorted((r.i, r.v) for r in files.raw(spark, str(tmp_path), 2).collect())
    assert got == [(i, [2.0 * i, 2.0 * i + 1]) for i in range(4)]
    got = sorted((r.i, r.v) for r in files.raw(spark, str(tmp_path), 2, samples=3).collect())
    assert got == [(i, [2.0 * i, 2.0 * i + 1]) for i in range(4)]
    (tmp_path / "empty.bin").write_bytes(b"")
    assert files.raw(spark, str(tmp_path), 2).count() == 4
    with pytest.raises(Exception, match="no whole number"):
        files.raw(spark, str(tmp_path), 3).collect()


def test_tree_tags_and_checksums(spark, tmp_path):
    for s, p, ms in (("s1", "p1", 200_000), ("s1", "p2", 800_000)):
        spark.createDataFrame([(1, 2.0)], "channel int, rms double").coalesce(1).toPandas().to_parquet(_made(tmp_path / s / p / f"T{ms:010d}") / "ap.pqt")
    got = sorted((r.subject, r.pid, r.t0, r.channel) for r in readers.keyed_tree(spark, str(tmp_path), "ap.pqt").collect())
    assert got == [("s1", "p1", 200.0, 1), ("s1", "p2", 800.0, 1)]
    files, folders = readers.checksums(spark, str(tmp_path), "*.pqt")
    assert files.count() == 2 and folders.select("md5").distinct().count() == 1
    words = {"pass": {"hard": "hard", "": "plain"}, "subset": {"some": "part", "all": "full"}}
    tags = readers.with_tags(spark.createDataFrame([("hard/x_HARD_some.h5",), ("hard/y.h5",)], "path string"), words).collect()
    assert [(r["pass"], r.subset) for r in tags] == [("hard", "part"), ("plain", None)]


def _made(p):
    p.mkdir(parents=True)
    return p


def test_lists_and_logs(spark, tmp_path):
    (tmp_path / "l.txt").write_text("/m/lab1/Subjects/s1/2020-01-01/001/raw\n# no\n\n/m/lab2/Subjects/s2/2020-01-02/002/raw\n")
    got = [(r.lab, r.subject, r.date, r.number) for r in readers.path_list(spark, str(tmp_path / "l.txt")).collect()]
    assert got == [("lab1", "s1", "2020-01-01", "001"), ("lab2", "s2", "2020-01-02", "002")]
    (tmp_path / "a.log").write_text("start\nend after 7200.0s\n")
    (tmp_path / "b.log").write_text("start 3s\nkilled\n")
    (tmp_path / "c.log").write_text("")
    (tmp_path / "d.log").write_text("step 1 s\nstep 3600 s")
    found = readers.log_durations(spark, str(tmp_path / "*.log")).collect()
    got = {r.path.rsplit("/", 1)[1]: r.hours for r in found}
    assert len(found) == len(got) and got.pop("d.log") == 1.0  # one row a file, however many lines it has
    assert got.pop("c.log", None) is None and got == {"a.log": 2.0, "b.log": None}


def test_resume_keeps_what_is_done(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    writers.by_key(df, str(tmp_path / "t"), ["k"])
    again = df.selectExpr("k", "v * 10 as v").unionByName(spark.createDataFrame([("c", 3)], "k string, v int"))
    writers.by_key(again, str(tmp_path / "t"), ["k"], spark.createDataFrame([("a",)], "k string"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("k", "v").collect()) == [("a", 1), ("b", 20), ("c", 3)]


def test_half_precision_and_annotation_guard(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.1, 70000.0])], "k int, v array<float>")
    writers.both_precisions(df, str(tmp_path / "h"), ["v"])
    v = spark.read.parquet(str(tmp_path / "h/float16")).first().v
    assert v[0] == float(np.float16(0.1)) and np.isinf(v[1])
    _, changed = writers.annotated(df.select("k"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, note string"), "k")
    assert changed.count() == 1  # a key that occurs twice would double rows


def test_failing_key_is_a_row(spark):
    def fn(f):
        if f.v.iloc[0] < 0:
            raise ValueError("negative")
        return {"total": float(f.v.sum())}

    good, bad = writers.per_key(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", -1.0)], "k string, v double"), ["k"], fn, "total double")
    assert [tuple(r) for r in good.collect()] == [("a", 3.0)]
    assert [(r.k, r.error) for r in bad.collect()] == [("b", "ValueError: negative")]


def test_stream_counts_equal_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    src = spark.range(40).select((F.col("id") % 3).alias("u"), F.timestamp_seconds(F.col("id") * 30).alias("ts"), F.lit(1.0).alias("value"))
    src.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    out = incremental.windowed_counts(live, "ts", ["u"], "5 minutes", "1 minute")
    q = out.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = src.groupBy(F.window("ts", "5 minutes"), "u").count().agg(F.sum("count"), F.count("*")).first()
    assert tuple(spark.table("counted").agg(F.sum("n"), F.count("*")).first()) == tuple(want)
    a = spark.createDataFrame([(1, 2.0)], "k int, v double")
    assert incremental.merged_sums([a, a, a], ["k"]).first().v == 6.0


def test_keys_are_streamed_over_batches(spark):
    """Keys that end within a batch, at its end, or go on over several; null keys; no group is made per key."""
    rows = [(None if k == 5 else k, "b" if k % 2 else None, j) for k in range(12) for j in range(1 + 5 * k % 7)]

    def fn(f):
        if f["j"].sum() == 3:
            raise ValueError("three")
        return {"n": len(f), "first": int(f.loc[0, "j"] >= 0)}

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in (1, 3, 1000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        try:
            good, bad = writers.per_key(spark.createDataFrame(rows, "k int, s string, j long"), ["k", "s"], fn, "n long, first long")
            got = {(r.k, r.s): r.n for r in good.collect()} | {(r.k, r.s): r.error for r in bad.collect()}
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
        assert got == {(None if k == 5 else k, "b" if k % 2 else None): "ValueError: three" if 1 + 5 * k % 7 == 3 else 1 + 5 * k % 7 for k in range(12)}
    assert "FlatMapGroups" not in good._jdf.queryExecution().toString()


def test_many_logs_are_few_tasks(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    for k in range(900):
        (tmp_path / "logs" / f"run_{k}.log").write_text(f"start\ndone in {k * 36}.00 s\n")
    (tmp_path / "logs" / "other.txt").write_text("done in 1 s\n")
    x = readers.log_durations(spark, str(tmp_path / "logs"), "*.log")
    assert sorted(r.hours for r in x.collect()) == [k / 100 for k in range(900)]
    assert x.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism


def test_lines_of_a_file_come_from_many_tasks(spark, tmp_path):
    x = spark.range(5000).selectExpr("if(id % 10 = 0, 'b/small.csv', 'a/large.csv') name", "(id * 37) % 5000 k", "id", "concat(id, ',', (id * 37) % 5000) line")
    files.write_lines(x, f"file://{tmp_path}", ["k", "id"], part=1000)
    for name in ("b/small.csv", "a/large.csv"):
        want = sorted((i * 37 % 5000, i) for i in range(5000) if (i % 10 == 0) == (name[0] == "b"))
        assert (tmp_path / name).read_text() == "".join(f"{i},{k}\n" for k, i in want)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]


def test_folders_are_listed_by_tasks(spark, tmp_path):
    for name in ("a.log", "b.txt", "x/c.log", "x/y/z/d.log", "x/k=1/_k=2.log", "x/_metadata.log", "empty/e.txt", ".f/f.log", "_g/g.log", "x/_h.log", "x/.i.log", "x/j.log._COPYING_", "äö/ü.log"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("l" * len(name))
    (tmp_path / "x/nothing.log").write_text("")
    by_spark = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    for glob in ("*.log", "*", "[a-c].*", "[^a]*.log", "{a,d}.log", "none"):
        found = files.listing(spark, str(tmp_path), glob)
        want = by_spark.option("pathGlobFilter", glob).load(str(tmp_path))
        assert sorted(map(tuple, found.collect())) == sorted((r.path, r.length) for r in want.select("path", "length").collect())
        assert not found.inputFiles()  # the driver holds no path of a file
    assert [r.length for r in files.listing(spark, f"file://{tmp_path}/x/c.log", "*").collect()] == [7]
    with pytest.raises(Exception, match="exist"):
        files.listing(spark, str(tmp_path / "none"), "*")


def test_logs_of_a_query_do_not_pass_the_driver(spark):
    from recloom.plans import registry
    from tests.session import TESTDATA

    x = registry.QUERIES["log_files"](spark, f"{TESTDATA}/sf0.001")
    assert x.count() == spark.read.parquet(f"{TESTDATA}/sf0.001/orders.parquet").select("o_custkey").distinct().count()
    assert not x.inputFiles()
