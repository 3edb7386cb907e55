import pytest

from __spark_entry__ import entry
from check import check, connect
from docquarry.plans.catalog import QUERIES
from docquarry.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def connection(small):
    return connect(small)


def test_every_query_has_its_statement():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_statement(spark, connection, small, name):
    assert check(spark, connection, small, name) is None


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns == ["query_id", "prompt"] and rows.count() == 40
