"""Measures around an index: latency percentiles, vocabulary growth, workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.operators.skew import number_rows


def percentiles(values: DataFrame, value: str, points: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """One row: n, median, the values at index int(n * p) of the sorted ones for each point, and the maximum.

    Exact and without gathering: rows are numbered in order and the wanted ones picked. Nulls don't count.
    """
    rows = number_rows(values.filter(F.col(value).isNotNull()).select(F.col(value).alias("v")), ["v"], ["v"])
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    every = rows.crossJoin(n)  # one row

    def at(i):
        return F.max(F.when(F.col("row_no") == i, F.col("v")))

    middle = (at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2
    picks = [at(F.least(F.floor(F.col("n") * p), F.col("n") - 1)).alias(f"p{round(p * 100)}") for p in points]
    return every.agg(F.count(F.lit(1)).alias("n"), middle.alias("median"), *picks, F.max("v").alias("max"))


def vocabulary_growth(post: DataFrame, docs: DataFrame, steps: int = 4) -> DataFrame:
    """(documents, vocabulary): distinct terms in the first 1/steps, 2/steps, ... of the documents by id."""
    placed = number_rows(docs.select("doc_id"), ["doc_id"], ["doc_id"])
    n = placed.agg(F.count(F.lit(1)).alias("n"))
    bucket = F.floor(F.col("row_no") * steps / F.col("n"))
    where = placed.crossJoin(n).select("doc_id", bucket.alias("b"), "n")
    first = post.join(where, "doc_id").groupBy("term").agg(F.min("b").alias("b"), F.max("n").alias("n"))
    per = first.groupBy("b").agg(F.count(F.lit(1)).alias("new"), F.max("n").alias("n"))
    grown = per.withColumn("vocabulary", F.sum("new").over(Window.orderBy("b")))  # ``steps`` rows
    # documents whose number times steps / n falls below b + 1
    return grown.select(F.ceil((F.col("b") + 1) * F.col("n") / steps).alias("documents"), "vocabulary")


def heaps(growth: DataFrame) -> DataFrame:
    """(k, b) of vocabulary = k * documents ^ b, by least squares on logarithms."""
    x, y = F.log("documents"), F.log("vocabulary")
    return growth.agg(F.exp(F.regr_intercept(y, x)).alias("k"), F.regr_slope(y, x).alias("b"))


def zipf_workload(items: DataFrame, item: str, draws: int = 2000, most: int = 200, seed: int = 42) -> DataFrame:
    """(n, item): draws from the ``most`` items of the smallest hash, the r-th with weight 1 / r.

    The draws depend on the seed only, not on partitions. At most ``most`` items are weighed. Hashes are MD5 of the seed
    and the item or the number of the draw, of which 52 bits make a uniform number.
    """
    place = F.md5(F.concat_ws("#", F.lit(str(seed)), "item"))
    few = items.select(F.col(item).cast("string").alias("item")).distinct().orderBy(place, "item").limit(most)
    w = Window.orderBy(place, "item")
    ranked = few.withColumn("r", F.row_number().over(w)).withColumn("hi", F.sum(1 / F.col("r")).over(w))
    arcs = ranked.select("item", "hi", (F.col("hi") - 1 / F.col("r")).alias("lo"), F.max("hi").over(Window.partitionBy()).alias("all"))
    spark = items.sparkSession
    uniform = F.conv(F.substring(F.md5(F.concat_ws("#", F.lit(str(seed)), F.col("n").cast("string"))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    drawn = spark.range(draws).select(F.col("id").alias("n")).withColumn("u", uniform)
    got = drawn.join(F.broadcast(arcs), (F.col("u") * F.col("all") >= F.col("lo")) & (F.col("u") * F.col("all") < F.col("hi")))
    return got.select("n", "item")
