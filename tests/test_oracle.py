"""Every registered query with SQL gives the rows of its SQL."""

import pytest

from docloom import queries
from tests import oracle

Q, SQL = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def con(sf001):
    return oracle.connect(sf001)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf001, con, name):
    assert oracle.differences(spark, name, Q[name], SQL[name], sf001, con) is None


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_query_without_sql_runs(spark, sf001, name):
    assert Q[name](spark, sf001).count() >= 0
