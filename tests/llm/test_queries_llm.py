"""Queries of the training-data operators against their SQL."""

import pytest

from codeloom.llm import queries
from tests.conftest import assert_same


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_is_its_sql(spark, medium, name):
    assert assert_same(queries.QUERIES[name](spark, medium), queries.ORACLE_SQL[name], medium) > 0
