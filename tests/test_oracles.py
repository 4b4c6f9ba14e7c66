"""Every query with SQL agrees with it, and every other one runs."""

import pytest

import __spark_entry__ as entry_point
from tests.compare import differences

QUERIES, SQL = entry_point.base_queries(), entry_point.base_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, sf_dir, name):
    assert differences(spark, QUERIES[name], SQL[name], sf_dir) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
