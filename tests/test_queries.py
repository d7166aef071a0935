"""Every query against its SQL, over whole tables at the smallest scale."""

import pytest

import __spark_entry__ as entry
from meterloom.plans.oracles import ORACLES
from meterloom.plans.queries import QUERIES

from .compare import connect, differences


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, data, name):
    assert differences(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], data) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
