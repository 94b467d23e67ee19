"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from echoloom import queries as core

QUERIES, SQL = core.queries(), core.oracle_sql()


@pytest.fixture(scope="module")
def db(small_dir):
    con = duckdb.connect()
    for f in os.listdir(small_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small_dir}/{f}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, db, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    columns = sorted(df.columns)
    result = db.execute(SQL[name])
    there = [x[0] for x in result.description]
    assert sorted(there) == columns
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(norm(r[there.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want
