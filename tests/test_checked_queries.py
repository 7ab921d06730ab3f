"""Every registered query against DuckDB on the smallest tables, and the driver contract."""

import pytest

import __spark_entry__ as entry
from registry.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, duck, name):
    problem, rows = compare(entry.queries()[name](spark, SF), duck, entry.oracle_sql().get(name))
    assert problem == ""
    assert rows > 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1
