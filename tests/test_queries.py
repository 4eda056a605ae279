"""Every registered query of the engine against its SQL, over the smallest tables."""

import pytest
from sqlcheck import SF, connection, same_rows

from lodestar.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection()


def test_catalogue():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        same_rows(df, con, SQL[name])
    else:
        assert df.count() > 0
