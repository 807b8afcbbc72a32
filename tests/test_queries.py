"""Every registered query against its SQL, on the smallest given data."""
import os

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    assert differences(queries()[name](spark, SF), con, oracle_sql()[name]) is None


def test_entry_returns_the_first_page(spark):
    rows = entry(spark).collect()
    assert len(rows) == 25
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)
