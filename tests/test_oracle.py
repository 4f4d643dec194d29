"""Every query with a DuckDB statement, at the smallest scale."""

import pytest

from quern import catalog
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert catalog.queries()[name](spark, SF).count() >= 0
    else:
        compare(spark, con, catalog.queries()[name], sql, SF)
