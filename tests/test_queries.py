"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.harness import compare, duck

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toArrow()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got.num_rows > 0
    else:
        assert compare(got, con.sql(sql).to_arrow_table()) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_no_check_without_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
