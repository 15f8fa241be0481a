"""The inverted index as DataFrames: postings, document lengths, term and corpus statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions.analyze import with_counts, with_terms
from postloom.session import spread, write_stage


class DuplicateDocuments(ValueError):
    """Raised when a corpus holds a document id more than once."""


def analyzed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, terms): the terms of every document, also of those without any."""
    return with_terms(spread(docs.select("doc_id", F.col(text).alias("text")))).select("doc_id", "terms")


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, term): every term at its position, from 0."""
    return analyzed(docs).select("doc_id", F.posexplode("terms").alias("pos", "term"))


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, url, title, length, counts) of every document, as far as the columns are there."""
    own = [c for c in ("doc_id", "url", "title") if c in docs.columns]
    return with_counts(spread(docs.select(*own, F.col(text).alias("text"))))


def postings(counts: DataFrame) -> DataFrame:
    """(term, doc_id, tf, length): one row per term of a document, without a shuffle.

    The length of the document goes along, so that scoring needs no join with the documents.
    """
    return counts.select("doc_id", "length", F.explode("counts").alias("x")).select("x.term", "doc_id", "x.tf", "length")


def lengths(counts: DataFrame) -> DataFrame:
    """(doc_id, length): documents without terms have length 0."""
    return counts.select("doc_id", "length")


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(length: DataFrame) -> DataFrame:
    """One row (n, total_length, avgdl); avgdl is 0 for an empty corpus."""
    total = F.coalesce(F.sum("length"), F.lit(0)).cast("long")
    one = length.agg(F.count(F.lit(1)).alias("n"), total.alias("total_length"))
    return one.withColumn("avgdl", F.when(F.col("n") > 0, F.col("total_length") / F.col("n")).otherwise(0.0))


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, copies) of the ids that occur more than once."""
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


@dataclass(frozen=True)
class Index:
    """The tables that queries read. ``docs``: doc_id, url, title, length. ``postings``: term, doc_id, tf, length."""

    docs: DataFrame
    postings: DataFrame
    df: DataFrame
    stats: DataFrame

    @classmethod
    def build(cls, corpus: DataFrame, check: bool = True) -> Index:
        """From (doc_id, url, title, text); ids must be unique."""
        if check and not duplicates(corpus).isEmpty():
            raise DuplicateDocuments("a document id occurs more than once")
        # analysed once and written: the tables below read what they need of it
        counts = write_stage(counted(corpus), "index")
        docs, post = counts.select("doc_id", "url", "title", "length"), postings(counts)
        return cls(docs, post, document_frequency(post), corpus_stats(docs))

    @property
    def vocabulary_size(self) -> int:
        return self.df.count()

    def without_orphans(self) -> Index:
        """The index without the postings of documents that it does not hold, which then score and count no more.

        Built and stored indexes have none; tables that come from elsewhere, or whose documents were removed, may.
        Document frequencies stay those of all postings.
        """
        return Index(self.docs, self.postings.join(self.docs.select("doc_id"), "doc_id", "left_semi"), self.df, self.stats)
