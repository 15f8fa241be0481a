"""BM25 over the index tables: bag-of-words queries with OR semantics, one or many at a time.

A score is a sum over query terms, partially aggregated before the shuffle on (query, document). Equal
scores keep the order of the first matching query term, then of document ids; scores are compared at ten
decimals, so that the order of the additions decides nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.analyze import with_terms
from postloom.operators.index import Index
from postloom.session import write_stage

K1, B, TOP_K = 1.2, 0.75, 10


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def saturation(tf: Column, length: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    norm = F.lit(1 - b) + F.lit(b) * (length / avgdl)
    return tf * F.lit(k1 + 1) / (tf + F.lit(k1) * norm)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times, first_pos) from (query_id, query): a repeated term counts each time."""
    every = with_terms(queries, "query").select("query_id", F.posexplode("terms").alias("pos", "term"))
    return every.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"), F.min("pos").alias("first_pos"))


FEW_TERMS = 200  # terms that are sought one by one; build_session lets as many be pushed down to Parquet
MOST_TERMS = 50_000  # (query, term) rows that are brought to the driver and sent out with the plan


def asked(queries: DataFrame, most: int = MOST_TERMS) -> tuple[DataFrame, list[str] | None]:
    """The terms of the queries, and the distinct ones as a list if there are at most ``most`` rows of them.

    The queries are analysed once: few rows become part of the plan, more are written.
    """
    rows = query_terms(queries)
    some = rows.coalesce(1).limit(most + 1).toArrow()  # one task reads on until it has as many
    if some.num_rows > most:
        return write_stage(rows, "asked"), None
    return rows.sparkSession.createDataFrame(some, rows.schema), sorted(set(some.column("term").to_pylist()))


def holding(df: DataFrame, words: list[str]) -> DataFrame:
    """The rows that may hold one of some terms, by what the scan can skip: each term if they are few, else their range."""
    if len(words) <= FEW_TERMS:
        return df.filter(F.col("term").isin(words))
    return df.filter(F.col("term").between(words[0], words[-1]))


def scores(index: Index, queries: DataFrame, k1: float = K1, b: float = B, counts: DataFrame | None = None, most: int = MOST_TERMS) -> DataFrame:
    """(query_id, doc_id, score, first_pos) of every document that holds a term of the query.

    The terms asked for are literals of the plan, so a stored index reads only the row groups and pages that may
    hold them, of the postings and of the table of terms; they are weighed by the document frequencies found there (or in ``counts``:
    term, df, as for a shard) and broadcast. Postings are not shuffled; where they are stored by document, their
    sums are not either. Beyond ``most`` rows of query terms, terms and postings are joined by shuffle.
    """
    terms, words = asked(queries, most)
    post, df = index.postings, index.df if counts is None else counts
    if words is not None:
        post, df = holding(post, words), holding(df, words)
    weighed = terms.join(df, "term").crossJoin(index.stats).filter("avgdl > 0")  # one row of statistics
    weighed = weighed.select("query_id", "term", "first_pos", "avgdl", (F.col("times") * idf(F.col("n"), F.col("df"))).alias("w"))
    hits = post.join(weighed if words is None else F.broadcast(weighed), "term")  # at most as many rows as query terms
    part = F.col("w") * saturation(F.col("tf"), F.col("length"), F.col("avgdl"), k1, b)
    held = ["shard"] if "shard" in post.columns else []
    return hits.groupBy("query_id", "doc_id", *held).agg(F.sum(part).alias("score"), F.min("first_pos").alias("first_pos"))


def compared() -> Column:
    """What scores are compared by: units of 1e-10. Rounding to a decimal goes through big decimals, which is slow."""
    return F.rint(F.col("score") * 1e10)


def _order() -> list[Column]:
    return [compared().desc(), F.col("first_pos").asc(), F.col("doc_id").asc()]


def top_k(scored: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best of each query, in order."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*_order())))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def total_hits(scored: DataFrame) -> DataFrame:
    """(query_id, total_hits): documents that match at least one term, whatever k is."""
    return scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_hits"))


def with_titles(best: DataFrame, docs: DataFrame) -> DataFrame:
    """The ranked hits with title, url and the score at four decimals, rounded after ranking."""
    # best holds at most k rows a query and is the small side; which side is broadcast is left to its measured size
    return best.join(docs.select("doc_id", "title", "url"), "doc_id").withColumn("score", F.round("score", 4))


def display_titles(hits: DataFrame) -> DataFrame:
    """Hits without a title show their id instead."""
    shown = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.format_string("(untitled, doc %d)", "doc_id"))
    return hits.withColumn("title", shown)


def idf_table(index: Index) -> DataFrame:
    return index.df.crossJoin(index.stats).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def lookup(index: Index, terms: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """(term, df, doc_id, tf) of the given terms, one row per posting; a term that is not there has one row of 0 documents."""
    wanted = terms.select("term").distinct()
    words = sorted(r.term for r in wanted.limit(most + 1).collect())
    post, df = index.postings, index.df
    if len(words) <= most:
        post, df = holding(post, words), holding(df, words)
        wanted = F.broadcast(wanted)
    own = post.join(wanted, "term", "left_semi").select("term", "doc_id", "tf")
    known = wanted.join(df, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))
    # a row for every term, so the few terms are kept and their postings are what is joined
    return known.join(own, "term", "left").select("term", "df", "doc_id", "tf")
