"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from vistamap.plans import queries as core

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.exists(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def rows(table, columns):
    return sorted(map(repr, zip(*(table[c].to_pylist() for c in columns))))


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    got = core.QUERIES[name](spark, DIR).toArrow()
    assert got.num_rows > 0
    if name not in core.SQL:
        return
    expected = duck.sql(core.SQL[name]).to_arrow_table()
    columns = sorted(expected.column_names)
    assert sorted(got.column_names) == columns
    assert rows(got, columns) == rows(expected, columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(core.QUERIES) <= set(__spark_entry__.queries())
