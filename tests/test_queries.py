"""Every query of the catalogue against its SQL, on the smallest tables."""

import pytest

from rampart import catalog
from tests.oracle import check, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_each_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    check(catalog.QUERIES[name](spark, SF), con, catalog.ORACLE[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
