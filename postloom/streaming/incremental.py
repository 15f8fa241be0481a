"""An index that grows with a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from postloom.operators.index import Index, corpus_stats, counted, document_frequency, postings


def append_batch(batch: DataFrame, path: str, batch_id: int) -> None:
    """Add one micro-batch of documents (doc_id, url, title, text) to the index at ``path``.

    A batch overwrites its own folder, so a repeated batch changes nothing. Of a document delivered again
    within a batch one row counts.
    """
    counts = counted(batch.dropDuplicates(["doc_id"])).persist()
    try:
        counts.select("doc_id", "url", "title", "length").write.mode("overwrite").parquet(f"{path}/docs/batch={batch_id}")
        postings(counts).sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings/batch={batch_id}")
    finally:
        counts.unpersist()


def index_stream(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Index what a stream of documents holds now, and end."""
    sink = docs.writeStream.foreachBatch(lambda batch, n: append_batch(batch, path, n))
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_growing(spark: SparkSession, path: str) -> Index:
    """The index of all batches so far; of a document in several batches the latest counts."""
    docs = spark.read.parquet(f"{path}/docs")
    latest = docs.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    docs = docs.join(latest, ["doc_id", "batch"]).drop("batch")
    post = spark.read.parquet(f"{path}/postings").join(latest, ["doc_id", "batch"]).select("term", "doc_id", "tf", "length")
    return Index(docs, post, document_frequency(post), corpus_stats(docs))


def query_traffic(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, events, mean_value) per window of event time; events later than ``late`` are dropped."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    per = timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("events"), F.avg("value").alias("mean_value"))
    return per.select(F.col("window.start").alias("start"), "event_type", "events", "mean_value")
