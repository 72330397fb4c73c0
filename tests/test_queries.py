"""Every core query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from helixframe.plans import file_queries, queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = queries.oracle_sql() | file_queries.oracle_sql()
QUERIES = queries.queries() | file_queries.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


#: Approximate: tests/test_index.py measures its recall.
WITHOUT_SQL = {"vector_index_topk"}


def test_each_has_sql():
    assert QUERIES.keys() == SQL.keys() | WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    assert sorted(str(tuple(r)) for r in df.select(columns).collect()) == sorted(str(r) for r in duck.sql(f"select {', '.join(columns)} from ({SQL[name]})").fetchall())
