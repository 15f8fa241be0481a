"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from oracle_check import connect, same

from postloom.plans.core_oracle import SQL
from postloom.plans.core_queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    same(QUERIES[name](spark, sf_dir), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_divergence_covers_every_term(spark, sf_dir):
    every, probes = (QUERIES[n](spark, sf_dir) for n in ("idf_divergence_all", "idf_divergence"))
    assert every.count() == QUERIES["shard_globals"](spark, sf_dir).count() and probes.exceptAll(every).isEmpty()
