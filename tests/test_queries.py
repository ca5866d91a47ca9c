import pytest

import __spark_entry__ as entry
from palimpsest.plans import engine_oracles, engine_queries, oracles, queries

from .compare import rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries.QUERIES | engine_queries.QUERIES, oracles.ORACLE_SQL | engine_oracles.ORACLE_SQL


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) and len(QUERIES) == len(queries.QUERIES) + len(engine_queries.QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    mine, theirs = rows_of_spark(QUERIES[name](spark, SF)), rows_of_sql(SQL[name], SF)
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    assert mine[1] == theirs[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
