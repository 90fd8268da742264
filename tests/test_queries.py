"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from workload.check import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, contract.queries()[name], contract.oracle_sql().get(name), SF)
    assert ok, note


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["qid", "part", "text"] and frame.count() > 0
