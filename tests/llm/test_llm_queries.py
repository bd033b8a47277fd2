from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import DATA, connection, rows

from tidemill.llm.queries import oracle_sql, queries

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, name):
    found, want = queries()[name](spark, str(DATA)).toPandas(), connection().sql(oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, name):
    assert queries()[name](spark, str(DATA)).count() > 0
