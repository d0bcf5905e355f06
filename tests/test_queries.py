"""Every named query against its SQL twin."""

import os

import pytest
from compare import difference, duck

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    assert difference(spark, con, SF, name) is None


def test_every_query_has_a_twin():
    from topicflow.plans.oracle import ORACLE
    from topicflow.plans.queries import QUERIES

    assert set(ORACLE) == set(QUERIES)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
