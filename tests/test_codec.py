from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postloom.functions import codec
from postloom.operators import storage


@given(st.lists(st.integers(0, 2**40)))
def test_values_round_trip(values):
    assert codec.decode_values(codec.encode_values(np.array(values, np.uint64))).tolist() == values


@pytest.mark.parametrize("value,n", [(0, 1), (127, 1), (128, 2), (16383, 2), (16384, 3), (2**62, 9)])
def test_sizes(value, n):
    assert len(codec.encode_values(np.array([value]))) == n


@given(st.dictionaries(st.integers(1, 10_000), st.integers(1, 50)))
@settings(max_examples=50)
def test_postings_round_trip(postings):
    ids = np.array(sorted(postings), np.int64)
    got = codec.decode_postings(codec.encode_postings(ids, np.array([postings[i] for i in ids], np.int64)))
    assert got[0].tolist() == ids.tolist() and got[1].tolist() == [postings[i] for i in ids]


@pytest.mark.parametrize("ids", [[5, 3], [5, 5], [0]])
def test_bad_postings(ids):
    with pytest.raises(ValueError):
        codec.encode_postings(np.array(ids), np.ones(len(ids)))


def test_native_varints_equal_the_vectorised_ones(spark):
    values = [0, 1, 127, 128, 300, 16384, 2**40, 2**62, None]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for r in df.select("v", codec.varint(F.col("v")).alias("code"), codec.varint_length(F.col("v")).alias("n")).collect():
        assert r.v is None and r.code is None or bytes(r.code) == codec.encode_values(np.array([r.v])) and r.n == len(r.code)
    with pytest.raises(Exception, match="negative"):
        spark.createDataFrame([(-1,)], "v long").select(codec.varint(F.col("v"))).collect()


def test_lists_in_blocks(spark):
    rows = [("a", 0, 3), ("a", 5, 1), ("a", (1 << 20) + 7, 2), ("b", 1 << 21, 9)]
    df = spark.createDataFrame(rows, "term string, doc_id long, tf int")
    lists = storage.encode_lists(df)
    assert lists.count() == 3
    assert sorted(map(tuple, storage.decode_lists(lists).collect())) == sorted(rows)
    sizes = {r.term: (r.df, r.nbytes) for r in storage.list_sizes(df).collect()}
    assert sizes == {t: (sum(1 for x in rows if x[0] == t), sum(len(r.data) for r in lists.collect() if r.term == t)) for t in "ab"}


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_prefix_sums(spark, chunk):
    df = spark.createDataFrame([(i, i * i) for i in range(50)], "k int, v long")
    got = {r.k: r.before for r in storage.prefix_sums(df, "k", "v", chunk).collect()}
    assert got == {i: sum(j * j for j in range(i)) for i in range(50)}
