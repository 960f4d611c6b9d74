"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import compare, duck
from registry.queries import QUERIES
from registry.sql import ORACLE

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    assert compare(spark, connection, name, SF) == ""


def test_contract(spark):
    assert driver.queries().keys() >= driver.oracle_sql().keys()
    assert set(ORACLE) <= set(QUERIES)
    assert driver.entry(spark).count() == 10
