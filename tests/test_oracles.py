"""Every registered query against its SQL oracle at the smallest scale."""

import pytest

import __spark_entry__ as entry
from palisade.plans import catalog
from tests.check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    assert compare(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name]) == ""
