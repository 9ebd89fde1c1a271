"""Every registered query runs, and equals its SQL twin where it has one."""

import pytest
from compare import database, same

from gridspan import catalog


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, con, sf, name):
    query, sql = catalog.queries()[name], catalog.oracle_sql().get(name)
    if sql:
        same(spark, con, query, sql, sf)
    else:
        assert query(spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
