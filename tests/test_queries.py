"""Every registered query of the library against its SQL, on the smallest tables; those without SQL must run."""

import pytest

from strandgraph.plans import registry

from .compare import assert_same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, duck, name):
    assert_same(QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"l07_window_recommendation", "l09_window_analysis", "j10_root_community"}))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
