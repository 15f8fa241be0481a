"""How often every distinct value occurs, and in how many records: counting over integer codes.

A dictionary numbers the distinct values of all groups from 0 without gaps, in their order. The rows are
encoded with it, each task adds up count arrays over its block of rows, and the arrays of all blocks are
summed by range of identifiers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators.skew import lookup_join, number_rows, small_join
from postloom.session import write_stage

RANGE = 1024  # identifiers per count array
LIVE_RANGES = 16_384  # arrays a task holds before it hands them on: 16,384 x 1024 x 16 bytes = 256 MB


def _emit(live: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    keys = sorted(live)
    for at in range(0, len(keys), 256):
        some = keys[at : at + 256]
        used = [np.flatnonzero(live[k][1]) for k in some]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(some, pa.int64()),
                pa.array([u.astype(np.int32) for u in used], pa.list_(pa.int32())),
                pa.array([live[k][0][u] for k, u in zip(some, used, strict=True)], pa.list_(pa.int64())),
                pa.array([live[k][1][u] for k, u in zip(some, used, strict=True)], pa.list_(pa.int64())),
            ],
            ["range_no", "slots", "occ", "rec"],
        )


def _count_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n) rows of one block -> its count arrays, without the empty slots."""
    live: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        ids, n = b.column("id").to_numpy(zero_copy_only=False), b.column("n").to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        ids, n = ids[order], n[order]
        which = ids // RANGE
        cuts = np.flatnonzero(np.diff(which)) + 1
        for i, m in zip(np.split(ids, cuts), np.split(n, cuts), strict=True):
            if not len(i):
                continue
            occ, rec = live.setdefault(int(i[0] // RANGE), (np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64)))
            np.add.at(occ, i % RANGE, m)
            np.add.at(rec, i % RANGE, 1)
        if len(live) > LIVE_RANGES:
            yield from _emit(live)
            live = {}
    yield from _emit(live)


def _sum_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays sorted by range -> one row per identifier. Holds the arrays of one range at a time."""
    now, occ, rec = None, np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64)

    def out() -> pa.RecordBatch:
        used = np.flatnonzero(rec)
        return pa.RecordBatch.from_arrays([pa.array(now * RANGE + used), pa.array(occ[used]), pa.array(rec[used])], ["id", "occurrences", "records"])

    for b in batches:
        cols = [b.column(c) for c in ("slots", "occ", "rec")]
        for k, r in enumerate(b.column("range_no").to_pylist()):
            if r != now:
                if now is not None:
                    yield out()
                now, occ, rec = r, np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64)
            s, o, d = (c[k].values.to_numpy(zero_copy_only=False) for c in cols)
            occ[s] += o
            rec[s] += d
    if now is not None:
        yield out()


def value_frequencies(rows: DataFrame, group: Sequence[str], entry: str, record: str, n: str | None = None) -> DataFrame:
    """(group..., entry, occurrences, records): how often each value occurs and in how many records.

    ``n`` is the number of occurrences a row stands for (1 if not given; null counts as 0). Rows equal in
    (group, entry, record) are one row delivered again and count once, with the largest ``n``. Rows in
    which the group, the value or the record is null count for nothing. An empty table gives an empty
    result. Other columns are ignored.
    """
    g = [f"g{i}" for i in range(len(group))]
    slim = rows.select(
        *(rows[c].alias(a) for a, c in zip(g, group, strict=True)), rows[entry].alias("e"), rows[record].alias("r"),
        (F.coalesce(rows[n].cast("long"), F.lit(0)) if n else F.lit(1).cast("long")).alias("n"),
    ).dropna(subset=[*g, "e", "r"])
    once = write_stage(slim.groupBy(*g, "e", "r").agg(F.max("n").alias("n")), "occurrences")
    # counted for the sake of heavy values only; written, as numbering reads its input twice
    known = write_stage(once.groupBy(*g, "e").agg(F.count(F.lit(1)).alias("n_rows")), "values")
    dictionary = number_rows(known, [*g, "e"], [], ["n_rows"]).withColumnRenamed("row_no", "id")
    coded = lookup_join(once, dictionary, [*g, "e"], "n_rows").select("id", "n")
    arrays = coded.mapInArrow(_count_block, "range_no long, slots array<int>, occ array<long>, rec array<long>")
    sums = arrays.repartition("range_no").sortWithinPartitions("range_no").mapInArrow(_sum_ranges, "id long, occurrences long, records long")
    got = sums.join(dictionary.drop("n_rows"), "id")
    return got.select(*(F.col(a).alias(c) for a, c in zip(g, group, strict=True)), F.col("e").alias(entry), "occurrences", "records")


def build_frequencies(postings: DataFrame, indexed_docs: DataFrame) -> DataFrame:
    """(build_id, field, entry, occurrences, records, n_docs, rare, common) of terms and lengths.

    Terms are rare below 4 occurrences or 2 documents and common in more than a tenth of the build's
    documents; lengths are rare in one document and common in more than a twentieth. A build without
    indexed documents has 0 of them.
    """
    terms = postings.select("build_id", F.lit("term").alias("field"), F.col("term").alias("entry"), "doc_id", F.col("tf").cast("long").alias("n"))
    lengths = indexed_docs.select(
        "build_id", F.lit("length").alias("field"), F.col("length").cast("string").alias("entry"), "doc_id", F.lit(1).cast("long").alias("n")
    )
    freq = value_frequencies(terms.unionByName(lengths), ["build_id", "field"], "entry", "doc_id", "n")
    docs = indexed_docs.dropna(subset=["build_id", "doc_id"]).select("build_id", "doc_id").distinct().groupBy("build_id").agg(F.count(F.lit(1)).alias("n_docs"))
    got = small_join(freq, docs, ["build_id"]).withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    is_term = F.col("field") == "term"
    return got.withColumn("rare", F.when(is_term, (F.col("occurrences") < 4) | (F.col("records") < 2)).otherwise(F.col("records") == 1)).withColumn(
        "common", F.when(is_term, F.col("records") * 10 > F.col("n_docs")).otherwise(F.col("records") * 20 > F.col("n_docs"))
    )


def marked(freq: DataFrame) -> DataFrame:
    """(build_id, field, entry, mark): one row per mark an entry bears."""
    marks = F.array_compact(F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common"))))
    return freq.select("build_id", "field", "entry", F.explode(marks).alias("mark"))
