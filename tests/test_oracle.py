"""Every registered query with SQL, against DuckDB on the smallest scale factor."""

import os

import compare
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
SQL = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    status, rows, got, want = compare.compare(spark, con, SF, name, SQL[name])
    assert got[0] == want[0]
    assert rows > 0
    assert status == "ok"


def test_flagship_entry(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 28 and df.columns[0] == "g"
