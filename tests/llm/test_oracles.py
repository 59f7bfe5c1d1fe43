"""The queries that have SQL of their own, held against DuckDB on the smallest tables."""

import os

import pytest

from orrery.llm import queries
from tests.test_oracles import TABLES, duck, rows  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query(spark, duck, name):  # noqa: F811
    own = queries.QUERIES[name](spark, TABLES)
    result = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert rows(own.columns, own.collect()) == rows(columns, result.fetchall())
