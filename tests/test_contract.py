"""Every registered query against its SQL twin on the small tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_flagship(spark):
    assert entry.entry(spark).columns[0] == "listing_id"


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con):
    _, problem = compare(name, spark, con, SF_DIR, QUERIES, ORACLES)
    assert problem is None, problem
