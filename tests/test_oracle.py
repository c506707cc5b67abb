"""Every registered query against the same question in SQL."""

import pytest

import __spark_entry__ as entry
import check
from consigna.catalog import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert check.compare(spark, con, FOLDER, name, entry.oracle_sql().get(name)) == ""


def test_entry(spark):
    assert entry.entry(spark).columns == ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_cents", "field", "message"]
    assert set(ORACLE) == set(QUERIES) <= set(entry.queries())
