"""Each registered query against its SQL, and that those without SQL give rows."""

import pytest

from fedloom.plans import catalog

from .helpers import same_as_sql

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, data, name):
    same_as_sql(catalog.queries()[name](spark, data), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_gives_rows(spark, data, name):
    df = catalog.queries()[name](spark, data)
    assert not df.isEmpty()


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.entry(spark).columns) == {"grp", "idx", "value"}
    assert set(e.oracle_sql()) <= set(e.queries())
