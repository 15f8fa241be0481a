from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from postloom.operators import skew


def _heavy(n=3000, seed=1):
    """A key with a third of all rows, many light ones, repeated rows and nulls."""
    r = random.Random(seed)
    out = [("big", r.randrange(400), r.choice([1, 2, None])) for _ in range(n // 3)]
    out += [(r.choice([None, "b", "c", f"k{r.randrange(300)}"]), r.choice([None, *range(50)]), 1) for _ in range(n - n // 3)]
    r.shuffle(out)
    # one posting never differs in what it counts
    tf = {}
    return [(k, d, tf.setdefault((k, d), t)) for k, d, t in out]


@pytest.mark.parametrize("chunk", [1, 7, 100, 10_000])
def test_stats_equal_plain_counting(spark, chunk):
    rows = _heavy()
    df = spark.createDataFrame(rows, "k string, d int, t int")
    got = {r.k: (r.n_rows, r.n_distinct, r.sum_t) for r in skew.chunked_group_stats(df, ["k"], ["d"], ["t"], chunk, 5).collect()}
    n, d = Counter(k for k, _, _ in rows), defaultdict(dict)
    for k, x, t in rows:
        d[k][x] = t or 0
    assert got == {k: (n[k], len(d[k]), sum(d[k].values())) for k in n}


def test_numbers_have_no_gaps_and_follow_the_order(spark):
    df = spark.createDataFrame(_heavy(), "k string, d int, t int")
    got = skew.number_rows(df, ["k"], ["d"], partitions=7).orderBy("row_no").collect()
    assert [r.row_no for r in got] == list(range(3000))
    key = [((r.k is not None, r.k or ""), (r.d is not None, r.d or 0)) for r in got]
    assert key == sorted(key)


@pytest.mark.parametrize("chunk", [1, 13, 5000])
def test_ranks_run_from_one(spark, chunk):
    df = spark.createDataFrame(_heavy(), "k string, d int, t int")
    got = defaultdict(list)
    for r in skew.key_ranks(df, ["k"], ["d"], chunk_rows=chunk, partitions=4).collect():
        got[r.k].append(r.key_rank)
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in got.values())


def test_one_value_that_repeats_is_spread(spark):
    df = spark.range(0, 4000, 1, 8).select(F.lit("x").alias("k"), F.lit(1).alias("d"))
    parts = skew.number_rows(df, ["k"], ["d"], partitions=4)
    sizes = [r["count"] for r in parts.groupBy(F.floor(F.col("row_no") / 1000)).count().collect()]
    assert sizes == [1000] * 4
    one = skew.chunked_group_stats(df, ["k"], ["d"], chunk_rows=100, partitions=4).first()
    assert (one.n_rows, one.n_distinct) == (4000, 1)


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "k string, d int, n long, chunk int, new boolean")
    assert skew.chunked_group_stats(empty, ["k"], ["d"]).count() == 0
    df = spark.createDataFrame([("a", 1, 5, 9, True)], "n string, chunk int, k long, row_no int, new boolean")
    r = skew.chunked_group_stats(df, ["n"], ["chunk"], ["k"]).first()
    assert (r.n, r.n_rows, r.n_distinct, r.sum_k) == ("a", 1, 1, 5)
    with pytest.raises(ValueError):
        skew.chunked_group_stats(df, [], ["chunk"])


def test_document_frequencies_count_each_document_once(spark):
    p = spark.createDataFrame([(1, "a", 1, 2), (1, "a", 1, 2), (1, "a", 2, 1), (1, None, 3, 1), (2, "a", 9, 4), (None, "a", 1, 1), (1, "b", None, 1)], "build_id int, term string, doc_id long, tf int")
    got = {(r.build_id, r.term): (r.df, r.tot) for r in skew.document_frequencies(p).collect()}
    assert got == {(1, "a"): (2, 3), (2, "a"): (1, 4)}
    g = spark.createDataFrame([(1, "s", "a", 2), (1, "s", "a", 2), (1, "t", "a", 3), (1, "s", "zz", 1), (1, "s", "q", None), (1, "s", None, 0)], "build_id int, shard string, term string, global_df int")
    wrong = {(r.shard, r.term) for r in skew.wrong_global_df(g, p).collect()}
    assert wrong == {("t", "a"), ("s", "zz")}


@pytest.mark.parametrize("rows,most", [(1, 3), (10, 100), (10_000, 10)])
def test_lookup_join_keeps_every_row(spark, rows, most):
    left = spark.createDataFrame([(k, i) for i, (k, _, _) in enumerate(_heavy(600))], "k string, i int")
    right = spark.createDataFrame([("big", 1), ("b", 2), ("k1", 3), ("nowhere", 4)], "k string, v int")
    want = sorted(map(tuple, left.join(right, "k", "left").collect()), key=repr)
    assert sorted(map(tuple, skew.lookup_join(left, right, ["k"], None, rows, most).collect()), key=repr) == want


@pytest.mark.parametrize("counted", [True, False])
def test_lookup_join_of_heavy_keys_with_several_rows(spark, counted):
    """A heavy key that has several lookup rows meets each of them with every row, once."""
    left = spark.range(900).selectExpr("if(id % 3 < 2, 'big', concat('k', id % 50)) as k", "id", "id % 5 as v")
    right = spark.createDataFrame([("big", 1, 600), ("big", 2, 600), ("k1", 3, 6), ("none", 4, 0), (None, 5, 0)], "k string, w int, n int")
    got = skew.lookup_join(left, right, ["k"], "n" if counted else None, min_rows=20, most=100)
    plain = left.join(right, ["k"], "left")
    assert set(got.columns) == set(plain.columns)
    rows = sorted(tuple(r) for r in got.select(plain.columns).fillna(-1).collect())
    assert rows == sorted(tuple(r) for r in plain.fillna(-1).collect()) and len(rows) == 600 * 2 + 300


def test_small_join_beyond_its_bound(spark):
    left, right = spark.range(40).selectExpr("id % 7 as k", "id"), spark.range(5).selectExpr("id as k", "id * 2 as w")
    want = sorted(tuple(r) for r in left.join(right, ["k"], "left").fillna(-1).collect())
    for most in (100, 2):
        assert sorted(tuple(r) for r in skew.small_join(left, right, ["k"], most).fillna(-1).collect()) == want
