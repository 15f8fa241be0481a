"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import distinctive, encode, frequency, leakage, lookalike, markup, quality, topn, wrapper
from postloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# ---- 2: frequency of every distinct value --------------------------------------------------------


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    return frequency.build_frequencies(table(spark, d, "postings"), table(spark, d, "indexed_docs"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return frequency.marked(_frequencies(spark, d))


@query
def p2_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(spark, d).select("build_id", "field", "entry", "occurrences", "records", "rare", "common")


# ---- 3: markup residue ----------------------------------------------------------------------------


@query
def p3_method(spark: SparkSession, d: str) -> DataFrame:
    """Pages of one name space stand for the pages of one host: the table states no address."""
    return wrapper.induce_wrappers(table(spark, d, "stream_articles"), "page_id", "ns", "text")


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.markup_kinds(table(spark, d, "stream_articles"))


@query
def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_texts(table(spark, d, "stream_articles"))


# ---- 4: top N items within every group -----------------------------------------------------------


def _results(spark: SparkSession, d: str) -> DataFrame:
    cols = ("query_id", "doc_id", "score")
    return table(spark, d, "shard_results").select(*cols).unionByName(table(spark, d, "search_results").select(*cols))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(_results(spark, d), "query_id", "doc_id", "score").select("query_id", "doc_id")


@query
def p4_ranked(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(_results(spark, d), "query_id", "doc_id", "score").select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


# ---- 5: visually identical text ------------------------------------------------------------------


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.titles_and_texts(table(spark, d, "indexed_docs"), table(spark, d, "stream_articles"))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.pairs_of(_entries(spark, d))


@query
def p5_method(spark: SparkSession, d: str) -> DataFrame:
    """The strict rule: only mixed-script tokens are repaired, and only to words that stand in the corpus."""
    return lookalike.pairs_of(_entries(spark, d), strict=True)


@query
def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.normal_forms(_entries(spark, d)).select("field", "id", "form")


# ---- 6: how distinctive a term is ----------------------------------------------------------------


@query
def p6_method(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.parsimonious(table(spark, d, "postings"))


@query
def p6_steps(spark: SparkSession, d: str) -> DataFrame:
    """The model after three steps, of every posting."""
    got = distinctive.parsimonious(table(spark, d, "postings"), tolerance=0.0, iterations=3)
    return got.select("build_id", "doc_id", "term", F.round("p", 7).alias("p"))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.best_terms(table(spark, d, "postings"), table(spark, d, "indexed_docs")).select("build_id", "doc_id", "term")


# ---- 7: encoding of the corpus -------------------------------------------------------------------


@query
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(table(spark, d, "documents"))


@query
def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, tokens, same): the number of tokens, and whether decoding gives the text again."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = encode.encode_texts(docs)
    back = encode.decode_ids(ids).withColumnRenamed("text", "back")
    sizes = ids.select("doc_id", F.size("ids").cast("long").alias("tokens"))
    return docs.join(back, "doc_id").join(sizes, "doc_id").select("doc_id", "tokens", (F.col("back") == F.col("text")).alias("same"))


@query
def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text, encoded and decoded again."""
    return encode.decode_ids(encode.encode_texts(table(spark, d, "documents"))).select("doc_id", "text")


# ---- 8: evaluation texts in training text --------------------------------------------------------


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.exact_leaks(leakage.leaked(table(spark, d, "documents"), table(spark, d, "benchmark")))


@query
def p8_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def p8_runs(spark: SparkSession, d: str) -> DataFrame:
    """The longest run of equal words of each leak."""
    found = leakage.leaked(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.join(leakage.exact_leaks(found), ["doc_id", "item_id"], "left_semi").select("doc_id", "item_id", "item_words", "equal_run")


# ---- 9: text quality -----------------------------------------------------------------------------


def _shares(spark: SparkSession, d: str) -> DataFrame:
    return quality.class_shares(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.no_prose(_shares(spark, d))


@query
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _shares(spark, d)


@query
def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.document_statistics(table(spark, d, "documents"))
