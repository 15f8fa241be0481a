"""Crawling as dataflow: frontier, breadth-first traversal with a page budget, politeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions.urls import canonical_url
from postloom.operators.skew import key_ranks, number_rows
from postloom.session import write_stage
from postloom.sources.pages import THIN

MAX_PAGES, MAX_DEPTH = 100, 3


def frontier(candidates: DataFrame, max_depth: int = MAX_DEPTH, seen: DataFrame | None = None) -> DataFrame:
    """(url, depth, seq): what a frontier accepts of (url, depth, seq), in canonical form.

    The first of equal addresses counts, unless it is too deep or was seen before; addresses that can't be
    read are left out.
    """
    known = candidates.filter(F.col("depth") <= max_depth).withColumn("url", canonical_url("url")).filter("url is not null")
    first = known.groupBy("url").agg(F.min(F.struct("seq", "depth")).alias("x")).select("url", "x.depth", "x.seq")
    return first if seen is None else first.join(seen.select("url"), "url", "left_anti")


def frontier_counts(accepted: DataFrame, taken: int) -> DataFrame:
    """One row: addresses seen, how many wait after ``taken`` of them were handed out, and the depth of the next one.

    Addresses are handed out in the order of (depth, seq), first in, first out.
    """
    placed = number_rows(accepted.select("depth", "seq"), ["depth"], ["seq"])
    waits = F.col("row_no") >= taken
    return placed.agg(F.count(F.lit(1)).alias("seen"), F.count_if(waits).alias("waiting"), F.min(F.when(waits, F.col("depth"))).cast("long").alias("next_depth"))


def crawl(
    pages: DataFrame, links: DataFrame, seeds: DataFrame, max_pages: int = MAX_PAGES, max_depth: int = MAX_DEPTH, thin: int = THIN
) -> tuple[DataFrame, dict[str, int]]:
    """Breadth-first over ``pages`` (id, text) and ``links`` (src, pos, dst) from ``seeds`` (id, seq).

    Gives the visited pages (id, depth, seq, outcome) and the counters. A page that is missing or shorter
    than ``thin`` is skipped and its links are not followed; the crawl ends when ``max_pages`` are indexed.
    One join per depth; each level is written, so lineage and driver hold nothing that grows.
    """
    spark = pages.sparkSession
    kind = F.when(F.col("text").isNull(), "failed").when(F.length("text") < thin, "thin").otherwise("indexed")
    known = write_stage(pages.select("id", kind.alias("outcome")), "pages")  # texts are read once, and move nowhere
    level = seeds.groupBy("id").agg(F.min("seq").alias("seq"))
    visited, seen, indexed, discovered = None, None, 0, 0
    for depth in range(max_depth + 1):
        ordered = number_rows(level, ["seq"], ["id"]).select("id", F.col("row_no").alias("n"))
        ordered = ordered.join(known, "id", "left").select("id", "n", F.coalesce("outcome", F.lit("failed")).alias("outcome"))
        ordered = write_stage(ordered, "level")
        size = ordered.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("outcome") == "indexed").alias("good")).first()
        if not size["all"]:
            break
        left = max_pages - indexed
        if size["good"] >= left:
            # the budget ends in this level: up to the last page it pays for
            last = ordered.filter("outcome = 'indexed'").orderBy("n").limit(left).agg(F.max("n")).first()[0]
            ordered = ordered.filter(F.col("n") <= (-1 if last is None else last))
        indexed += min(left, size["good"])
        done = ordered.select("id", F.lit(depth).alias("depth"), "n", "outcome")
        visited = done if visited is None else visited.unionByName(done)
        seen = level.select("id") if seen is None else seen.unionByName(level.select("id"))
        if depth == max_depth:  # what these pages link to is too deep
            break
        out = ordered.filter("outcome = 'indexed'").select(F.col("id").alias("src"), "n").join(links, "src")
        found = out.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("n", "pos")).alias("seq"))
        level = write_stage(found.join(seen, "id", "left_anti"), "frontier")
        discovered += level.count()
        if indexed >= max_pages:
            break
        seen = write_stage(seen, "seen")
    empty = spark.createDataFrame([], "id long, depth int, n long, outcome string")
    visited = visited if visited is not None else empty
    counts = {r.outcome: r.n for r in visited.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
    skipped = counts.get("thin", 0) + counts.get("failed", 0)
    fetched = counts.get("indexed", 0) + counts.get("thin", 0)
    return visited, {"fetched": fetched, "indexed": counts.get("indexed", 0), "skipped": skipped, "discovered": discovered}


def politeness(requests: DataFrame, delay: float = 1.0) -> DataFrame:
    """(host, seq, start) of (host, seq): requests to one host start ``delay`` seconds apart, in order.

    The place of a request among those of its host comes from exact chunking, so a host with most of the
    requests does not fill one task.
    """
    ranked = key_ranks(requests, ["host"], ["seq"])
    return ranked.select("host", "seq", ((F.col("key_rank") - 1) * F.lit(delay)).alias("start"))
