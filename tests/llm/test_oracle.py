"""Queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from recloom.llm.queries import ORACLE, QUERIES
from tests.session import TESTDATA

D = f"{TESTDATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("pages", "documents", "conversations", "benchmark", "labels"):
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    want = c.execute(ORACLE[name])
    names = [x[0] for x in want.description]
    df = QUERIES[name](spark, D)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)
