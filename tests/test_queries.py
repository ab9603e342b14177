"""Every query of the catalog against its SQL, and the driver's entry points."""

import pytest

import __spark_entry__ as entry
from codeloom.plans import every as catalog
from tests.conftest import assert_same


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_is_its_sql(spark, medium, name):
    assert name in catalog.ORACLE_SQL
    assert assert_same(catalog.QUERIES[name](spark, medium), catalog.ORACLE_SQL[name], medium) > 0


def test_entry_has_rows_and_a_stable_schema(spark):
    first, second = entry.entry(spark), entry.entry(spark)
    assert first.schema == second.schema and first.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
