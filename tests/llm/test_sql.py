"""Queries with SQL agree with DuckDB on the whole of a small table."""

import os

import duckdb
import pytest

from palisade.llm import queries as q

SMALL = os.environ.get("LLM_TEST_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", q.oracle_sql())
def test_sql(spark, name):
    con = duckdb.connect()
    for name_ in ("documents", "benchmark"):
        con.execute(f"create view {name_} as select * from '{SMALL}/{name_}.parquet'")
    found = con.execute(q.oracle_sql()[name])
    cols = sorted(c[0] for c in found.description)
    names = [c[0] for c in found.description]
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in found.fetchall())
    df = q.queries()[name](spark, SMALL)
    assert sorted(df.columns) == cols
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == want
