import pytest
from test_entry import TABLES, compare, db  # noqa: F401

import __spark_entry__
from sonargrid.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, db, name):  # noqa: F811
    compare(spark, db, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, TABLES).count() > 0


def test_entry_adds_them():
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
