"""Every registered query against its SQL twin on the smallest data."""

import os

import pytest

import __spark_entry__ as contract
from check import compare, connect
from workload import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ENTRIES = registry()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query(spark, con, name):
    outcome, _ = compare(spark, con, SF_DIR, name, ENTRIES[name])
    assert outcome.startswith(("ok", "rows"))


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
