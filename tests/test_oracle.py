"""Every query with a DuckDB statement, on the smallest test tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_queries import compare, connect  # noqa: E402

from shelfcast.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_duckdb(spark, con, name):
    result = compare(con, QUERIES[name](spark, SF), ORACLES[name])
    assert result.startswith("ok"), result


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 110


def test_entry_runs(spark):
    import __spark_entry__ as entry

    plan = entry.entry(spark)
    assert plan.count() > 0
    assert "reorder_point" in plan.columns
