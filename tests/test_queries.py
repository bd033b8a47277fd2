from __future__ import annotations

import pytest
from oracle import DATA, connection, rows

from tidemill.queries import problems, reference

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")
QUERIES = reference.queries() | problems.queries()
SQL = reference.oracle_sql() | problems.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    found, want = QUERIES[name](spark, str(DATA)).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
