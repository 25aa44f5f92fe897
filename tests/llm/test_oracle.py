"""Queries of this package that SQL can express give the rows of their SQL."""

import pytest

from docloom.llm import queries
from tests import oracle

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf001, name):
    assert oracle.differences(spark, name, queries.queries()[name], SQL[name], sf001, oracle.connect(sf001)) is None
