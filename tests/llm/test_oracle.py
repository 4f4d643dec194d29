"""The llm queries that SQL can express, at the smallest scale."""

import pytest

from quern.llm import queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, name):
    assert compare(spark, connect(SF), queries.QUERIES[name], queries.ORACLE[name], SF)
