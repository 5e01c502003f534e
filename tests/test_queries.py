"""Every registered query against its SQL in DuckDB, on the smallest tables; the others must run and keep their schema."""

import math

import duckdb
import pytest

from recloom.plans.registry import ORACLE, QUERIES
from tests.session import TESTDATA

D = f"{TESTDATA}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for name in TABLES.split():
        c.execute(f"create view {name} as select * from '{D}/{name}.parquet'")
    return c


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 9) if isinstance(v, float) else v


def rows(names, got, order):
    at = [names.index(c) for c in order]
    return sorted((tuple(norm(r[i]) for i in at) for r in got), key=repr)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, D)
    got = df.collect()
    if name not in ORACLE:
        assert df.columns and len(got) > 0
        return
    want = duck.execute(ORACLE[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got, sorted(names)) == rows(names, want.fetchall(), sorted(names))


def test_entry_and_guard():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.WITH_LLM == ("pipeline" in e.queries())


@pytest.mark.parametrize("name", ["null_r2", "grouped_fit"])
def test_null_of_every_recording(spark, duck, name, monkeypatch):
    from recloom.operators import encoding

    draws, seen = encoding.shift_draws, []
    monkeypatch.setattr(encoding, "shift_draws", lambda *a: seen.append(a[2]) or draws(*a))
    got = {r.pid for r in QUERIES[name](spark, D).collect()}
    assert got == {r[0] for r in duck.execute("select distinct l_suppkey from lineitem").fetchall()} and seen == [30]


def test_low_rank_report_has_all_channels(spark):
    assert {r.nc for r in QUERIES["low_rank_report"](spark, D).collect()} == {64}


def test_scored_one_fits_each_recording_once(spark, monkeypatch):
    from recloom.plans import encoding

    stored, labels, fits, made = encoding.stored, [], encoding.en.fit_rows, []
    monkeypatch.setattr(encoding, "stored", lambda s, x, label: labels.append(label) or stored(s, x, label))
    monkeypatch.setattr(encoding.en, "fit_rows", lambda *a, **k: made.append(1) or fits(*a, **k))
    assert QUERIES["scored_one"](spark, D).count() > 0
    assert labels == ["scored_rows", "scored_fits"] and len(made) == 2  # scores with their null, and weights


def test_scored_one_shuffles_samples_once(spark, duck, monkeypatch):
    """Only what is read of a line item goes through one shuffle; a recording is then a row, and is fitted where it lies."""
    from recloom.plans import encoding

    stored, seen = encoding.stored, {}
    monkeypatch.setattr(encoding, "stored", lambda s, x, label: seen.setdefault(label, (x, stored(s, x, label)))[1])
    assert QUERIES["scored_one"](spark, D).count() > 0
    made, rows = seen["scored_rows"]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "array(" not in plan[plan.index("Exchange hashpartitioning") :]
    sizes = dict(duck.execute("select l_suppkey, count(*) from lineitem group by 1").fetchall())
    assert {r.pid: len(r.i) for r in rows.collect()} == sizes and rows.count() == len(sizes)
