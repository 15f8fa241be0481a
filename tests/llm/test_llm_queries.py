"""Every query of the training-data operators against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from oracle_check import connect, same

from postloom.llm.oracle import SQL
from postloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    same(QUERIES[name](spark, sf_dir), con, SQL[name])


COLUMNS = {
    "p2_found": {"build_id", "field", "entry", "mark"}, "p3_found": {"page_id", "kind"}, "p4_found": {"query_id", "doc_id"},
    "p5_found": {"field", "id_a", "id_b"}, "p6_found": {"build_id", "doc_id", "term"}, "p7_ids": {"doc_id", "ids"},
    "p8_found": {"doc_id", "item_id"}, "p9_found": {"doc_id"},
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert name not in COLUMNS or set(df.columns) == COLUMNS[name]
    rows = df.collect()
    assert rows
    if name.endswith("_found"):
        assert len(set(map(tuple, rows))) == len(rows)
