"""Every registered query against its SQL oracle on the smallest tables."""

import pytest

import oracle
from corpusloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLE)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_oracle(spark, con, name):
    diff, _ = oracle.differences(spark, con, registry.QUERIES[name], registry.ORACLE[name], SF)
    assert diff == ""


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).columns == ["id", "conversations"]
    assert set(registry.QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
