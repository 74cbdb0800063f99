"""Queries of the operators against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from vistamap.llm import queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.exists(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    expected = duck.sql(queries.oracle_sql()[name]).to_arrow_table()
    got = queries.queries()[name](spark, DIR).toArrow()
    columns = sorted(expected.column_names)
    assert sorted(got.column_names) == columns
    rows = lambda t: sorted(map(repr, zip(*(t[c].to_pylist() for c in columns))))
    assert rows(got) == rows(expected) and got.num_rows > 0
