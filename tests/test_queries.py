"""Every named query against its SQL oracle on the smallest test set."""

import pytest
from compare import connect, differences

import __spark_entry__ as contract
from tapeworks.plans import CATALOG

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(CATALOG))
def test_query(spark, oracle, name):
    df = CATALOG[name].run(spark, SF_DIR)
    if CATALOG[name].sql is None:
        assert df.count() > 0
    else:
        assert differences(df, oracle, CATALOG[name].sql) == []


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
