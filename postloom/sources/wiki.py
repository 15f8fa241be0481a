"""Wiki dumps: reading and writing them, and cleaning article text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from postloom.operators.skew import number_rows

LEAST = 500  # articles must be longer than this after cleaning
_PAGE = StructType(
    [
        StructField("title", StringType()), StructField("ns", StringType()), StructField("id", StringType()),
        StructField("revision", StructType([StructField("text", StringType())])),
    ]
)
_BLANK = r"[\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
# What is taken out of article text, in this order, after links have been replaced by their labels.
_REMOVED = (
    r"\{\{[^}]*\}\}", r"(?s)<ref[^>]*>.*?</ref>", r"<[^>]+>", r"\[\[(?:File|Image|Category):[^\]]*\]\]", r"https?://\S+", r"'{2,}", r"={2,}",
)


def clean(markup: Column) -> Column:
    text = F.regexp_replace(markup, r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1")
    text = F.regexp_replace(text, r"\[\[([^\]|]+)\]\]", "$1")
    for pattern in _REMOVED:
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(F.regexp_replace(text, _BLANK, " "))


def articles(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, title, text) of the pages of name space 0 whose cleaned text is longer than 500 characters.

    ``pages``: id, title, ns, text. A limit of 0 or none means all; it takes the smallest ids.
    """
    got = pages.filter((F.col("ns") == "0") & F.col("text").isNotNull() & (F.col("text") != ""))
    got = got.select("id", F.coalesce("title", F.lit("")).alias("title"), clean(F.col("text")).alias("text")).filter(F.length("text") > LEAST)
    return got.orderBy("id").limit(limit) if limit else got


def numbered(found: DataFrame) -> DataFrame:
    """(doc_id, title, text) of articles (id, title, text): numbered from 1 in the order of the dump, that of page ids."""
    return number_rows(found, ["id"], [], ["title", "text"]).select((F.col("row_no") + 1).alias("doc_id"), "title", "text")


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, ns, text) of a MediaWiki XML dump, plain or compressed by bzip2."""
    raw = spark.read.format("xml").option("rowTag", "page").schema(_PAGE).load(path)
    return raw.select(F.col("id").cast("long").alias("id"), "title", "ns", F.col("revision.text").alias("text"))


def write_dump(pages: DataFrame, path: str) -> None:
    """Pages (id, title, ns, text) as a compressed dump of several files."""
    rows = pages.select("title", F.col("ns").cast("string").alias("ns"), F.col("id").cast("string").alias("id"), F.struct("text").alias("revision"))
    rows.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").option("compression", "bzip2").save(path)
