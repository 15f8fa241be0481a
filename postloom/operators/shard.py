"""Consistent hashing, shards with global statistics, scatter and gather."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.operators import rank
from postloom.operators.index import Index

REPLICAS = 1000
MOST_POINTS = 1_000_000  # a ring is broadcast; beyond this it is refused
_PREFIX = 3  # hex digits of the equality part of the ring lookup


def ring(spark: SparkSession, shards: Sequence[str], replicas: int = REPLICAS) -> DataFrame:
    """(pt, shard): the points of the ring, as 32 hex digits, whose order is that of the numbers."""
    if not shards:
        raise ValueError("a ring needs a shard")
    if len(set(shards)) * replicas > MOST_POINTS:
        raise ValueError(f"a ring has at most {MOST_POINTS} points")
    names = spark.createDataFrame([(s,) for s in sorted(set(shards))], "shard string")
    points = names.select("shard", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("i"))
    return points.select(F.md5(F.concat_ws("#", "shard", "i")).alias("pt"), "shard")


def _arcs(points: DataFrame) -> DataFrame:
    """(prefix, lo, hi, shard): hashes from lo up to but not at hi belong to the shard of the point hi.

    The last arc wraps round to the first point. An arc that spans several prefixes is listed under each.
    """
    w = Window.orderBy("pt")  # over the points of a ring, which are bounded
    arcs = points.select(F.coalesce(F.lag("pt").over(w), F.lit("")).alias("lo"), F.col("pt").alias("hi"), "shard")
    ends = points.agg(F.max("pt").alias("lo"), F.min_by("shard", "pt").alias("shard")).select("lo", F.lit("g").alias("hi"), "shard")
    top = 16**_PREFIX - 1
    number = lambda c: F.conv(F.rpad(F.substring(c, 1, _PREFIX), _PREFIX, "0"), 16, 10).cast("int")
    every = arcs.unionByName(ends).withColumn("a", F.when(F.col("lo") == "", 0).otherwise(number("lo")))
    every = every.withColumn("b", F.when(F.col("hi") == "g", top).otherwise(number("hi")))
    return every.select(F.explode(F.sequence("a", "b")).alias("prefix"), "lo", "hi", "shard")


def assign(keys: DataFrame, points: DataFrame, key: Column, out: str = "shard") -> DataFrame:
    """``keys`` with the shard of each: that of the first point beyond the key's hash, round the ring."""
    h = F.md5(key)
    arcs = F.broadcast(_arcs(points).withColumnRenamed("shard", out))  # at most MOST_POINTS and the prefixes
    hashed = keys.withColumn("_h", h).withColumn("_p", F.conv(F.substring(h, 1, _PREFIX), 16, 10).cast("int"))
    found = hashed.join(arcs, (F.col("_p") == F.col("prefix")) & (F.col("_h") >= F.col("lo")) & (F.col("_h") < F.col("hi")))
    return found.select(*keys.columns, out)


def doc_key() -> Column:
    return F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))


def moves(keys: DataFrame, before: DataFrame, after: DataFrame, key: Column) -> DataFrame:
    """(source, target, moved): how many keys go from which shard to which, those that stay included."""
    both = assign(assign(keys, before, key, "source"), after, key, "target")
    return both.groupBy("source", "target").agg(F.count(F.lit(1)).alias("moved"))


def balance(keys: DataFrame, shards: Sequence[str], replicas: Sequence[int], key: Column) -> DataFrame:
    """(replicas, max_deviation): how far the fullest or emptiest shard is from a fair share."""
    out = None
    for r in replicas:
        per = assign(keys, ring(keys.sparkSession, shards, r), key).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
        fair = F.sum("n") / F.lit(len(shards))
        # a shard without keys is as far off as can be
        off = F.greatest(F.max("n") / fair - 1, 1 - F.when(F.count(F.lit(1)) < len(shards), F.lit(0)).otherwise(F.min("n")) / fair)
        one = per.agg(off.alias("max_deviation")).select(F.lit(r).alias("replicas"), "max_deviation")
        out = one if out is None else out.unionByName(one)
    return out


def summary(docs: DataFrame, post: DataFrame) -> DataFrame:
    """(shard, documents, total_length, terms, postings) from sharded documents and postings."""
    a = docs.groupBy("shard").agg(F.count(F.lit(1)).alias("documents"), F.sum("length").cast("long").alias("total_length"))
    b = post.groupBy("shard", "term").agg(F.count(F.lit(1)).alias("n")).groupBy("shard").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("postings"))
    return a.join(b, "shard", "left").select("shard", "documents", "total_length", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("postings", F.lit(0)).alias("postings"))


def shard_globals(post: DataFrame) -> DataFrame:
    """(shard, term, global_df, local_df): the counts over all shards of the terms that a shard holds."""
    local = post.groupBy("shard", "term").agg(F.count(F.lit(1)).alias("local_df"))
    whole = local.groupBy("term").agg(F.sum("local_df").alias("global_df"))
    return local.join(whole, "term").select("shard", "term", "global_df", "local_df")


def manifest(docs: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: the shards in order, and the statistics over all of them."""
    names = docs.select("shard").distinct().agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    return names.crossJoin(stats).select("shards", F.col("n").alias("global_document_count"), F.col("avgdl").alias("global_avgdl"))


def write_shards(index: Index, path: str, shards: Sequence[str], replicas: int = REPLICAS) -> None:
    """Route every document, and write the shards with what each needs to score like one index.

    ``docs`` and ``postings`` are partitioned by shard; ``globals`` holds the counts over all shards of the
    terms that a shard holds, ``manifest`` the shards and the statistics over all of them.
    """
    points = ring(index.docs.sparkSession, shards, replicas)
    docs, post = assign(index.docs, points, doc_key()), assign(index.postings, points, doc_key())
    docs.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/docs")
    # a shard's postings are spread over as many files as tasks hold them, sorted by term within each
    post.sortWithinPartitions("shard", "term", "doc_id").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/postings")
    shard_globals(post).select("shard", "term", "global_df").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/globals")
    manifest(docs, index.stats).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def open_shard(spark: SparkSession, path: str, name: str) -> Index:
    """One written shard: its own documents and postings, the counts and statistics of all shards."""
    mine = F.col("shard") == name  # only this shard's folders are read
    docs, post, df = (spark.read.parquet(f"{path}/{t}").filter(mine).drop("shard") for t in ("docs", "postings", "globals"))
    kept = spark.read.schema("shards array<string>, global_document_count long, global_avgdl double").json(f"{path}/manifest")
    stats = kept.select(F.col("global_document_count").alias("n"), (F.col("global_document_count") * F.col("global_avgdl")).cast("long").alias("total_length"), F.col("global_avgdl").alias("avgdl"))
    return Index(docs, post, df.withColumnRenamed("global_df", "df"), stats)


def divergence(docs: DataFrame, post: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(shard, term, local_share, global_share) of the given terms, or of all: how far local counts are from global ones."""
    if terms is not None:
        post = post.join(terms.select("term").distinct(), "term", "left_semi")
    own = post.groupBy("shard", "term").agg(F.count(F.lit(1)).alias("local_df"))
    size = docs.groupBy("shard").agg(F.count(F.lit(1)).alias("local_n"))
    total = size.agg(F.sum("local_n").alias("n"))
    whole = own.groupBy("term").agg(F.sum("local_df").alias("df"))
    got = own.join(whole, "term").join(size, "shard").crossJoin(total)
    return got.select("shard", "term", (F.col("local_df") / F.col("local_n")).alias("local_share"), (F.col("df") / F.col("n")).alias("global_share"))


def scatter_gather(index: Index, queries: DataFrame, k: int = rank.TOP_K, down: Sequence[str] = ()) -> DataFrame:
    """(query_id, rank, doc_id, score, shard): the best k of each shard that answers, merged.

    ``index.postings`` carry the shard of their document, and those of shards that are down are not read.
    Statistics are those of all shards, so scores are those of one index. Each shard keeps its k best,
    in the order of ``rank.top_k``. The lists are merged by their heads, of which the one of the highest score, then of the
    greatest document id goes first. A document can't overtake the one before it in its list, so among equal scores
    the merged order is that of the smallest id so far in the list, from the greatest down.
    """
    post = index.postings.filter(~F.col("shard").isin(*down)) if down else index.postings
    scored = rank.scores(Index(index.docs, post, index.df, index.stats), queries)
    own = Window.partitionBy("query_id", "shard").orderBy(rank.compared().desc(), F.col("first_pos").asc(), F.col("doc_id").asc())
    local = scored.withColumn("r", F.row_number().over(own)).filter(F.col("r") <= k)
    ties = Window.partitionBy("query_id", "shard", rank.compared()).orderBy("r")
    heads = local.withColumn("head", F.min("doc_id").over(ties))  # at most k rows per query and shard
    order = [rank.compared().desc(), F.col("head").desc(), F.col("r").asc()]
    merged = heads.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)
    return merged.select("query_id", "rank", "doc_id", "score", "shard")


def answer(hits: DataFrame, queries: DataFrame, shards: Sequence[str], down: Sequence[str] = ()) -> DataFrame:
    """One row per query: its hits in order, which shards failed, and whether the answer is degraded."""
    failed = sorted(set(shards) & set(down))
    row = F.struct("rank", "doc_id", F.round("score", 4).alias("score"), "shard")
    own = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("results"))
    got = queries.select("query_id").distinct().join(own, "query_id", "left")
    return got.select(
        "query_id", F.coalesce(F.size("results"), F.lit(0)).cast("int").alias("n_results"), "results",
        F.lit(len(set(shards))).alias("shards_queried"), F.lit(",".join(failed)).alias("shards_failed"), F.lit(bool(failed)).alias("degraded"),
    )
