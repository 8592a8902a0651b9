"""Every query runs on the smallest tables; those with SQL agree with DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from palisade.queries import oracle_sql, queries

DATA = os.environ.get("QUERY_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(row):
    return repr(tuple(round(v, 6) if isinstance(v, float) else v for v in row))


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(plain(r) for r in df.select(*cols).collect())
    if name in oracle_sql():
        found = duck.execute(oracle_sql()[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == cols
        assert got == sorted(plain([r[names.index(c)] for c in cols]) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
