"""Storing an index: sorted Parquet tables, compressed postings lists, and the term directory."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.functions.codec import decode_postings, encode_postings, varint_length
from postloom.operators.index import Index
from postloom.operators.skew import CHUNK_ROWS, number_rows
from postloom.session import remove, sized_partitions, write_stage

BLOCK_BITS = 20  # a list is stored in blocks of ids, so no list outgrows a task
PARTS = ("postings", "docs", "terms", "stats")


def _shift(post: DataFrame) -> DataFrame:
    # ids on the wire start at 1
    return post.select("term", F.shiftright("doc_id", BLOCK_BITS).alias("block"), (F.col("doc_id") + 1).alias("id"), "tf")


def encode_lists(post: DataFrame) -> DataFrame:
    """(term, block, df, data): the postings lists, gaps and frequencies as varints.

    A list is cut into blocks of 2^20 ids, each coded by itself; with fewer documents than that, every list
    is one block. Ids are stored one higher, since the code starts at 1. Ids must be unique within a term.
    """
    lists = _shift(post).groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("id", "tf"))).alias("x"))
    lists = lists.select("term", "block", F.col("x.id").alias("ids"), F.col("x.tf").alias("tfs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                ids, tfs = part.column(2), part.column(3)
                data = [encode_postings(i.values.to_numpy(), t.values.to_numpy()) for i, t in zip(ids, tfs, strict=True)]
                df = pa.array([len(i.values) for i in ids], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), df, pa.array(data, pa.binary())], ["term", "block", "df", "data"])

    return lists.mapInArrow(run, "term string, block long, df int, data binary")


def decode_lists(lists: DataFrame) -> DataFrame:
    """(term, doc_id, tf) from (term, block, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                got = [decode_postings(x.as_py()) for x in part.column(1)]
                if got:
                    ids, tfs = (np.concatenate(x) for x in zip(*got, strict=True))
                    rows = pa.array(np.repeat(np.arange(len(got)), [len(i) for i, _ in got]))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(rows), pa.array(ids - 1), pa.array(tfs.astype(np.int32))], ["term", "doc_id", "tf"])

    return lists.select("term", "data").mapInArrow(run, "term string, doc_id long, tf int")


def list_sizes(post: DataFrame) -> DataFrame:
    """(term, df, nbytes) of the coded lists, without coding them."""
    w = Window.partitionBy("term", "block").orderBy("id")
    gap = F.col("id") - F.coalesce(F.lag("id").over(w), F.lit(0))
    return _shift(post).select("term", (varint_length(gap) + varint_length(F.col("tf"))).alias("n")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("n").alias("nbytes")
    )


def prefix_sums(df: DataFrame, order: str, value: str, chunk_rows: int = CHUNK_ROWS, payload: Sequence[str] = ()) -> DataFrame:
    """(order, value, payload..., before): for each row the sum of ``value`` over all smaller ones, without a global window.

    Rows are numbered in order and cut into equal chunks; only one total per chunk passes through one task.
    """
    rows = number_rows(df, [order], [value], payload).withColumn("_chunk", F.floor(F.col("row_no") / chunk_rows))
    totals = rows.groupBy("_chunk").agg(F.sum(value).alias("_t"))
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_chunk", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_chunk").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(starts, "_chunk").select(order, value, *payload, (F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).alias("before"))


def term_directory(post: DataFrame) -> DataFrame:
    """(term, byte_offset, nbytes, df) of the lists written one after another in order of terms."""
    sizes = write_stage(list_sizes(post), "sizes")
    placed = prefix_sums(sizes, "term", "nbytes", payload=["df"]).withColumnRenamed("before", "byte_offset")
    return placed.select("term", "byte_offset", "nbytes", "df")


def write_index(index: Index, path: str, partitions: int | None = None) -> None:
    """Write the tables of an index, each by itself readable as Parquet.

    ``postings`` are put into buckets by document and sorted by term within each: a reader skips what can't hold its
    terms, and adds up scores where the postings are. ``terms`` holds (term, df, byte_offset, nbytes) in order of terms.
    """
    spark = index.postings.sparkSession
    n = partitions or sized_partitions(index.postings)
    post = index.postings.select("term", "doc_id", "tf", "length")
    # one task per bucket, so one file per bucket
    name = f"postloom_{uuid.uuid4().hex}"
    remove(spark, f"{path}/postings")
    filed = post.repartition(n, "doc_id").sortWithinPartitions("term", "doc_id")
    filed.write.mode("overwrite").option("path", f"{path}/postings").bucketBy(n, "doc_id").sortBy("term").format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    spark.createDataFrame([(n,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    kept = spark.read.parquet(f"{path}/postings")
    term_directory(kept).repartitionByRange(sized_partitions(kept.select("term")), "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    index.stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def open_index(spark: SparkSession, path: str) -> Index:
    """A written index. Its postings are a table that knows its buckets, so sums per document need no exchange."""
    n = spark.read.parquet(f"{path}/layout").first()[0]
    plain = spark.read.parquet(f"{path}/postings")
    name = f"postloom_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    where = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (doc_id) SORTED BY (term) INTO {n} BUCKETS LOCATION '{where}/postings'")
    terms = spark.read.parquet(f"{path}/terms")
    return Index(spark.read.parquet(f"{path}/docs"), spark.table(name), terms.select("term", "df"), spark.read.parquet(f"{path}/stats"))


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """(term, df, byte_offset, nbytes) of a written index."""
    return spark.read.parquet(f"{path}/terms").select("term", "df", "byte_offset", "nbytes")


def is_stored(spark: SparkSession, path: str) -> bool:
    """Whether all parts of an index were written to the end."""
    jvm = spark._jvm
    for part in PARTS:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}/_SUCCESS")
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return False
    return True


def open_or_build(spark: SparkSession, path: str | None, build: Callable[[], Index]) -> Index:
    """The stored index, or one that is built now, stored, and read back. Without a path it stays in memory."""
    if not path:
        return build()
    if not is_stored(spark, path):
        write_index(build(), path)
    return open_index(spark, path)
