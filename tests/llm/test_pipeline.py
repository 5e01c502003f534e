"""The pipeline's stages on small tables: columns, planted cases, and what must stay."""

import hashlib

import corpus_pipeline as cp
from recloom.llm.store import Scratch
from tests.llm.test_operators import awkward, none
from tests.session import TESTDATA

SMALL = f"{TESTDATA}/sf0.001"


def test_stages_run_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    cols, last = docs.columns, None
    for name, stage in cp.STAGES:
        before = docs.count()
        docs = Scratch(spark, "t").save(stage(spark, docs, SMALL), "x")
        if name != "tokens":
            assert docs.columns == cols and 0.5 * before <= docs.count() <= before
            last = docs
    want = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in last.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in docs.collect()} == want


def test_each_stage_takes_awkward_and_empty_tables(spark):
    docs = awkward(spark).selectExpr("*", "1 as score", "2 as predicted", "3 as n_lines", "4 as n_removed", "5 as component_id", "6 as row", "7 as item_id")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() > 0 and (name == "tokens" or out.columns == docs.columns)
        assert stage(spark, none(spark), SMALL).count() == 0


def test_lines_stage_keeps_what_is_left(spark):
    """A document of boilerplate and a few words of its own stays with these; one of boilerplate alone goes."""
    shared = "\n".join(f"a line of boilerplate number {i} that stands on very many sites" for i in range(30))
    rows = [(i, f"{shared}\nown {i}") for i in range(1, 12)] + [(20, shared), (21, f"\n{shared}\n \n"), (22, None), (23, ""), (24, "   ")]
    docs = spark.createDataFrame([(i, t, "en", f"s{i}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in cp.by_lines(spark, docs, SMALL).collect()}
    assert set(got) == {*range(1, 12), 22, 23, 24}
    assert got[1].text == rows[0][1] and all(got[i].text == f"own {i}" and got[i].n_chars == len(got[i].text) for i in range(2, 12))


def test_benchmark_stage_looks_at_rows_without_an_id(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    rows = [(None, f"before it {item} after it"), (None, "clean words of its own"), (1, item), (2, "clean too"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in cp.by_benchmark(spark, docs, SMALL).collect()} == {rows[1], rows[3], rows[4]}


def test_planted_cases(spark):
    base = " ".join(f"word{i} thing{i * 7 % 50}" for i in range(60))
    near = base.replace("word30 ", "other ")
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    shared = "a line that stands on very many sites"
    rows = [(1, base), (2, base), (3, near), (4, f"before it {item} after it"), (5, "a clean and short text of its own")]
    rows += [(100 + i, f"{shared}\nown text number {i} with its own words {i * 13} and {i * 17}") for i in range(12)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in cp.by_similarity(spark, docs, SMALL).collect()} >= {1, 4, 5} and {2, 3}.isdisjoint(r.doc_id for r in cp.by_similarity(spark, docs, SMALL).collect())
    assert {r.doc_id for r in cp.by_benchmark(spark, docs, SMALL).collect()} == {i for i, _ in rows} - {4}
    lines = {r.doc_id: r for r in cp.by_lines(spark, docs, SMALL).collect()}
    assert set(lines) == {i for i, _ in rows}
    assert lines[100].text.startswith(shared) and all(shared not in lines[i].text and lines[i].n_chars == len(lines[i].text) for i in range(101, 112))
