"""Every query that has SQL gives what its SQL gives; the others run."""

import pytest
from oracle import DATA, connect, rows_of_spark, rows_of_sql

from shelfmark.plans import catalogue, files, training

QUERIES = catalogue.QUERIES | files.QUERIES | training.QUERIES
SQL = catalogue.SQL | files.SQL | training.SQL


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, str(DATA))
    assert len(set(df.columns)) == len(df.columns)
    got = rows_of_spark(df)
    if name in SQL:
        assert got == rows_of_sql(con, SQL[name], df.columns)
