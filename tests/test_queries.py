"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from check_queries import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, con, name):
    verdict = compare(spark, con, name, SF_DIR)
    assert verdict.startswith(("ok", "rows only")), verdict


def test_oracles_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_stable_schema(spark):
    df = contract.entry(spark)
    assert df.columns == ["word", "rank", "context", "count"]
    assert df.count() > 0
