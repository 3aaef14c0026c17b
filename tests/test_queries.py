"""Every registered query that has SQL gives the same rows as DuckDB."""

import pytest

from lectern.oracles import ORACLES
from lectern.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.oracle import connection, same


@pytest.fixture(scope="module")
def con():
    return connection(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    same(QUERIES[name](spark, SF_SMALL), con, ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())
