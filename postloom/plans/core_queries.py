"""Registered queries of the core engine: name -> (session, data folder) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.api import Engine
from postloom.conf import EngineConf
from postloom.functions import analyze, codec, urls
from postloom.operators import crawl, index, metrics, rank, shard, skew, state, storage
from postloom.session import shared_dir, write_stage
from postloom.sources import pages, wiki
from postloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# ---- a few keys holding most records ------------------------------------------------------------


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.wrong_global_df(table(spark, d, "index_globals"), table(spark, d, "postings"))


@query
def p1_document_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return skew.document_frequencies(table(spark, d, "postings"))


@query
def p1_posting_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Position of each posting in its term's list, summed up per term: ranks must run from 1 to n."""
    kept = table(spark, d, "postings").select("build_id", "term", "doc_id").dropna()
    ranked = skew.key_ranks(kept, ["build_id", "term"], ["doc_id"])
    return ranked.groupBy("build_id", "term").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("key_rank").alias("first_rank"), F.max("key_rank").alias("last_rank"),
        F.sum("key_rank").alias("rank_sum"),
    )


# ---- fixtures: the tables in the roles that the operators need ---------------------------------------

QUERY = "the famous library and the old map of the library near the river"
PROBES = ("librari", "river", "map", "absent")
SHARDS = ("shard-0", "shard-1", "shard-2")
EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"
ROBOTS = (
    ("sihiba.example", "User-agent: *\nDisallow: /wiki/\n"),
    ("pebapi.example", "User-agent: *\nDisallow: /private/\nAllow: /\n"),
)
RESPONSES = (
    (1, 200, "text/html; charset=utf-8", 1000), (2, 404, "text/html", 10), (3, 200, "application/pdf", 1000), (4, 200, "Application/XHTML+XML", 5),
    (5, 200, "text/html", 10 * 1024 * 1024), (6, 200, "text/html", 10 * 1024 * 1024 + 1), (7, None, None, None), (8, 200, None, 7),
)
CALLS = ((1, "shard-0", 0.05), (1, "shard-1", 3.3), (1, "shard-2", 0.2), (2, "shard-0", 3.2), (2, "shard-1", 0.1), (2, "shard-2", None))
# pages as they come from the web, and their title, text and links as read off them by hand
PAGES = (
    (1, "https://a.example/x/y", "<html><head><title> River &amp; Mill </title><style>p{}</style></head><body><h1>Hi</h1><p>one <b>two</b></p></body></html>", "River & Mill", "River & Mill Hi one two", ()),
    (2, "https://a.example/x/y", "<p>a<a href='z'>b</a><a href=\"/q?r=1#s\">c</a><a href='//b.example/d'>d</a><a href='#top'>t</a><a href='mailto:a@b'>m</a></p>", "", "a b c d t m", ("https://a.example/x/z", "https://a.example/q?r=1#s", "https://b.example/d")),
    (3, "https://a.example/", "x<script>var a = '<p>no</p>';</script>y<noscript>n<p>o</p></noscript><svg><title>s</title></svg>z", "", "x y z", ()),
    (4, "https://a.example/", "<title>first</title><title>second</title><p>caf&eacute; &#8212; &lt;b&gt;", "first", "first second caf\u00e9 \u2014 <b>", ()),
    (5, "https://a.example/d/", "<ul><li>one<li>two<br>three</ul><a>no address</a><a href=''>self</a><a href='../up'>up</a>", "", "one two three no address self up", ("https://a.example/d/", "https://a.example/up")),
    (6, "https://a.example/", "", "", "", ()),
    (7, "https://a.example/", "<!-- <p>hidden</p> --><p>shown</p><a href='javascript:f()'>j</a><a href='HTTP://C.example/E'>k</a>", "", "shown j k", ("HTTP://C.example/E",)),
)
KEYS = ("  Solar   System ", "solar system", "Caf\u00e9", "cafe", "", "A\u3000B\tc")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """The documents, with their first line as title and an address made of host and id."""
    t = table(spark, d, "documents")
    return t.select(
        "doc_id", F.concat_ws("/", F.coalesce("source", F.lit("")), F.col("doc_id").cast("string")).alias("url"),
        F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"), "text",
    )


def _index(spark: SparkSession, d: str) -> index.Index:
    return index.Index.build(corpus(spark, d), check=False)


def _one_query(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, QUERY)], "query_id long, query string")


def _batch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _probes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in PROBES], "term string")


def _sharded(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return shard.assign(docs, shard.ring(spark, SHARDS), shard.doc_key())


def _seconds():
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts)") / F.lit(1e6)


def _web(spark: SparkSession, d: str) -> DataFrame:
    """The wiki pages as the pages of a crawl; of one delivered twice, the later."""
    t = table(spark, d, "stream_articles")
    last = t.groupBy("page_id").agg(F.max_by(F.struct("title", "ns", "text"), "loaded_at").alias("x"))
    return last.select(F.col("page_id").alias("id"), "x.title", "x.ns", "x.text")


def _links(web: DataFrame) -> DataFrame:
    """Three links from each page, to pages (7 * id + i) mod n."""
    n = web.agg(F.max("id").alias("n"))
    every = web.select(F.col("id").alias("src")).crossJoin(n)  # one row
    return every.select("src", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("pos"), "n").select("src", "pos", F.expr("(7 * src + pos) % n").alias("dst"))


# ---- text analysis and index -------------------------------------------------------------------------


@query
def analyze_terms(spark: SparkSession, d: str) -> DataFrame:
    return index.occurrences(corpus(spark, d)).select("doc_id", F.col("pos").cast("long").alias("pos"), "term")


@query
def postings(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(index.counted(corpus(spark, d))).select("term", "doc_id", F.col("tf").cast("long").alias("tf"))


@query
def duplicate_doc_ids(spark: SparkSession, d: str) -> DataFrame:
    """Of the indexed documents, where rows are delivered twice."""
    return index.duplicates(table(spark, d, "indexed_docs"))


@query
def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return index.lengths(index.counted(corpus(spark, d))).select("doc_id", F.col("length").cast("long").alias("length"))


@query
def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return index.document_frequency(index.postings(index.counted(corpus(spark, d))))


@query
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    i = _index(spark, d)
    return i.stats.crossJoin(i.df.agg(F.count(F.lit(1)).alias("vocabulary")))


@query
def postings_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The postings of a few terms, in one row each to be shown."""
    got = rank.lookup(_index(spark, d), _probes(spark)).groupBy("term").agg(F.max("df").alias("df"), F.sort_array(F.collect_list("doc_id")).alias("doc_ids"), F.sum("tf").alias("tf_sum"))
    return got.withColumn("tf_sum", F.coalesce("tf_sum", F.lit(0)).cast("long"))


@query
def postings_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same as they are read: one row per posting."""
    return rank.lookup(_stored(spark, d)[1], _probes(spark)).select("term", "df", "doc_id", F.col("tf").cast("long").alias("tf"))


# ---- ranking -----------------------------------------------------------------------------------------


@query
def idf_table(spark: SparkSession, d: str) -> DataFrame:
    return rank.idf_table(_index(spark, d)).select("term", "df", F.round("idf", 9).alias("idf"))


@query
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    best = rank.top_k(rank.scores(_index(spark, d), _one_query(spark)))
    return best.select(F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


@query
def bm25_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    best = rank.top_k(rank.scores(_index(spark, d), _batch(spark, d)))
    return best.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


@query
def bm25_param_sweep(spark: SparkSession, d: str) -> DataFrame:
    i, q, out = _index(spark, d), _one_query(spark), None
    for k1, b in ((1.2, 0.75), (2.0, 0.75), (1.2, 0.0), (0.0, 0.5)):
        best = rank.top_k(rank.scores(i, q, k1, b), 5)
        one = best.select(F.lit(k1).alias("k1"), F.lit(b).alias("b"), F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def total_hits(spark: SparkSession, d: str) -> DataFrame:
    return rank.total_hits(rank.scores(_index(spark, d), _batch(spark, d)))


@query
def bm25_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Postings of documents that are gone, those whose language is missing, neither score nor count."""
    i = _index(spark, d)
    held = i.docs.join(table(spark, d, "documents").filter("lang is not null").select("doc_id"), "doc_id", "left_semi")
    scored = rank.scores(index.Index(held, i.postings, i.df, i.stats).without_orphans(), _one_query(spark))
    return rank.top_k(scored).join(rank.total_hits(scored), "query_id").select(F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"), "total_hits")


@query
def search_response(spark: SparkSession, d: str) -> DataFrame:
    i = _index(spark, d)
    best = rank.with_titles(rank.top_k(rank.scores(i, _one_query(spark))), i.docs)
    return best.select(F.col("rank").cast("long").alias("rank"), "doc_id", "title", "url", "score")


@query
def display_results(spark: SparkSession, d: str) -> DataFrame:
    """Titles as shown: of indexed documents, an empty or missing title gives way to the id."""
    docs = table(spark, d, "indexed_docs").select("doc_id", "title").distinct()
    return rank.display_titles(docs)


# ---- codec and storage -------------------------------------------------------------------------------


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    steps = [0, 1, 127, 128, 16383, 16384, 2097151, 2097152, 1 << 40]
    fixed = spark.createDataFrame([(n,) for n in steps], "value long")
    return fixed.union(table(spark, d, "postings").select(F.col("doc_id") * F.col("tf"))).filter("value is not null").distinct()


@query
def varint_encode(spark: SparkSession, d: str) -> DataFrame:
    v = _numbers(spark, d)
    return v.select("value", F.hex(codec.varint(F.col("value"))).alias("code"), codec.varint_length(F.col("value")).cast("long").alias("nbytes"))


@query
def varint_decode(spark: SparkSession, d: str) -> DataFrame:
    """Decoded by Spark's own functions: seven bits of each byte, shifted by its place."""
    coded = _numbers(spark, d).select("value", F.hex(codec.varint(F.col("value"))).alias("code"))
    byte = lambda i: F.conv(F.substr("code", i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    places = F.sequence(F.lit(0), (F.length("code") / 2).cast("int") - 1)
    total = F.aggregate(places, F.lit(0).cast("long"), lambda a, i: a + F.call_function("shiftleft", byte(i).bitwiseAND(F.lit(127)), i * 7))
    return coded.select("value", total.alias("decoded"))


@query
def vbyte_postings(spark: SparkSession, d: str) -> DataFrame:
    lists = storage.encode_lists(index.postings(index.counted(corpus(spark, d))))
    return lists.select("term", "block", F.col("df").cast("long").alias("df"), F.hex("data").alias("code"))


@query
def vbyte_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    own = index.postings(index.counted(corpus(spark, d)))
    return storage.decode_lists(storage.encode_lists(own)).select("term", "doc_id", F.col("tf").cast("long").alias("tf"))


@query
def vbyte_stats(spark: SparkSession, d: str) -> DataFrame:
    sizes = storage.list_sizes(index.postings(index.counted(corpus(spark, d))))
    return sizes.agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"), F.sum("nbytes").alias("nbytes"), F.round(F.sum("nbytes") / F.sum("df"), 6).alias("bytes_per_posting"))


@query
def term_directory(spark: SparkSession, d: str) -> DataFrame:
    return storage.term_directory(write_stage(index.postings(index.counted(corpus(spark, d))), "directory"))


def _stored(spark: SparkSession, d: str) -> tuple[index.Index, index.Index]:
    own, path = _index(spark, d), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    storage.write_index(own, path)
    return own, storage.open_index(spark, path)


@query
def index_write_stats(spark: SparkSession, d: str) -> DataFrame:
    _, kept = _stored(spark, d)
    size = storage.list_sizes(kept.postings).agg(F.count(F.lit(1)).alias("terms"), F.sum("nbytes").alias("postings_bytes"))
    return size.crossJoin(kept.docs.agg(F.count(F.lit(1)).alias("documents")))


@query
def ondisk_equals_memory(spark: SparkSession, d: str) -> DataFrame:
    """How many postings, documents and query hits the stored index has, and how many differ from the built one."""
    own, kept = _stored(spark, d)
    hits = [rank.top_k(rank.scores(i, _one_query(spark))).select("rank", "doc_id", F.round("score", 6).alias("score")) for i in (own, kept)]
    out = None
    for name, a, b in (("postings", own.postings, kept.postings), ("documents", own.docs, kept.docs), ("hits", *hits)):
        both = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(-1)))
        per = both.groupBy(*a.columns).agg(F.sum("side").alias("diff"), F.count_if(F.col("side") == -1).alias("stored"))
        one = per.agg(F.lit(name).alias("part"), F.sum("stored").alias("stored"), F.count_if(F.col("diff") != 0).alias("different"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def open_or_build(spark: SparkSession, d: str) -> DataFrame:
    """Asked twice for an index at one place: the first time it is built and stored, the second time it is only opened."""
    path, out, built = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", None, []

    def build() -> index.Index:
        built.append(1)
        return _index(spark, d)

    for turn in (1, 2):
        i = storage.open_or_build(spark, path, build)
        one = i.stats.crossJoin(i.df.agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("df").alias("postings")))
        one = one.select(F.lit(turn).cast("long").alias("turn"), F.lit(len(built)).cast("long").alias("built"), "n", "vocabulary", "postings")
        out = one if out is None else out.unionByName(one)
    return out


@query
def engine_search(spark: SparkSession, d: str) -> DataFrame:
    """The engine asked twice for the same: the second answer comes from its cache."""
    engine = Engine(spark, _index(spark, d))
    engine.search(QUERY)
    got, stats = engine.search(QUERY), engine.stats()
    rows = [(n, r["doc_id"], r["title"], r["url"], r["score"], got["total_hits"], stats["cache"]["hits"], stats["vocabulary_size"]) for n, r in enumerate(got["results"], 1)]
    return spark.createDataFrame(rows, "rank long, doc_id long, title string, url string, score double, total_hits long, cache_hits long, vocabulary long")


# ---- wiki source -------------------------------------------------------------------------------------


@query
def wiki_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stream_articles").filter("text is not null").select("page_id", wiki.clean(F.col("text")).alias("text")).distinct()


@query
def wiki_articles(spark: SparkSession, d: str) -> DataFrame:
    """Written as a compressed dump and read back from it."""
    path = f"{shared_dir(spark)}/dump-{uuid.uuid4().hex}"
    wiki.write_dump(_web(spark, d), path)
    return wiki.articles(wiki.read_dump(spark, path))


@query
def article_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The articles as an index takes them: numbered from 1 in the order of the dump."""
    got = wiki.numbered(wiki.articles(_web(spark, d).withColumn("ns", F.col("ns").cast("string"))))
    return got.select("doc_id", "title", urls.article_url(F.col("title")).alias("url"), F.length("text").cast("long").alias("length"))


@query
def article_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stream_articles").filter("title is not null").select("page_id", urls.article_url(F.col("title")).alias("url")).distinct()


# ---- crawl -------------------------------------------------------------------------------------------


@query
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "indexed_docs").filter("url is not null").select("doc_id", urls.canonical_url("url").alias("url")).distinct()


@query
def frontier_dedup(spark: SparkSession, d: str) -> DataFrame:
    offered = table(spark, d, "indexed_docs").filter("url is not null").groupBy("url").agg(F.min("doc_id").alias("seq"))
    return crawl.frontier(offered.select("url", (F.col("seq") % 5).cast("int").alias("depth"), "seq")).select("url", F.col("depth").cast("long").alias("depth"), "seq")


@query
def thin_page_filter(spark: SparkSession, d: str) -> DataFrame:
    return _web(spark, d).filter(F.length("text") >= pages.THIN).select("id")


def _crawl(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, int]]:
    web = write_stage(_web(spark, d).select("id", "text"), "web")
    seeds = spark.createDataFrame([(1, 0), (5, 1), (2, 2)], "id long, seq long")
    return crawl.crawl(web, _links(web), seeds)


@query
def crawl_bfs(spark: SparkSession, d: str) -> DataFrame:
    return _crawl(spark, d)[0].select("id", F.col("depth").cast("long").alias("depth"), "outcome")


@query
def crawl_stats(spark: SparkSession, d: str) -> DataFrame:
    counters = _crawl(spark, d)[1]
    return spark.createDataFrame([tuple(counters.values())], ", ".join(f"{k} long" for k in counters))


@query
def frontier_counts(spark: SparkSession, d: str) -> DataFrame:
    """After a hundred addresses were handed out."""
    offered = table(spark, d, "indexed_docs").filter("url is not null").groupBy("url").agg(F.min("doc_id").alias("seq"))
    accepted = crawl.frontier(offered.select("url", (F.col("seq") % 5).cast("int").alias("depth"), "seq"))
    return crawl.frontier_counts(accepted, 100)


def _html(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(i, base, text) for i, base, text, *_ in PAGES], "id long, url string, html string")
    return rows.select("id", pages.parsed("html", "url").alias("p")).select("id", "p.*")


@query
def html_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with known parts: nested skipped elements, references, several titles, unclosed tags, void elements."""
    return _html(spark).select("id", "title", "text")


@query
def html_links(spark: SparkSession, d: str) -> DataFrame:
    return _html(spark).select("id", F.posexplode("links").alias("pos", "link")).select("id", F.col("pos").cast("long").alias("pos"), "link")


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    web = _web(spark, d).withColumn("url", urls.article_url(F.coalesce("title", F.lit("untitled"))))
    return web.select("id", "url", pages.parsed("text", "url").alias("p")).select("id", "url", "p.*")


@query
def parse_pages(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("id", "title", "text", F.size("links").cast("long").alias("n_links"))


@query
def outbound_links(spark: SparkSession, d: str) -> DataFrame:
    found = _parsed(spark, d).select("id", F.posexplode("links").alias("pos", "link"))
    return found.select("id", F.col("pos").cast("long").alias("pos"), urls.canonical_url("link").alias("link"))


@query
def fetch_gate(spark: SparkSession, d: str) -> DataFrame:
    r = spark.createDataFrame(list(RESPONSES), "id long, status int, content_type string, nbytes long")
    return r.select("id", pages.gate(F.col("status"), F.col("content_type"), F.col("nbytes")).alias("verdict"))


@query
def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    robots = spark.createDataFrame(list(ROBOTS), "host string, robots_txt string")
    return pages.allowed(table(spark, d, "indexed_docs").filter("url is not null").select("url").distinct(), robots).select("url", "allowed")


@query
def politeness_schedule(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "documents").filter("source is not null").select(F.col("source").alias("host"), F.col("doc_id").alias("seq"))
    return crawl.politeness(asked)


# ---- shards ------------------------------------------------------------------------------------------


@query
def ring_points(spark: SparkSession, d: str) -> DataFrame:
    return shard.ring(spark, SHARDS)


@query
def ring_assign(spark: SparkSession, d: str) -> DataFrame:
    return _sharded(spark, table(spark, d, "documents").select("doc_id"))


def _moves(spark: SparkSession, d: str, before: tuple[str, ...], after: tuple[str, ...]) -> DataFrame:
    return shard.moves(table(spark, d, "documents").select("doc_id"), shard.ring(spark, before), shard.ring(spark, after), shard.doc_key())


@query
def ring_add_moves(spark: SparkSession, d: str) -> DataFrame:
    return _moves(spark, d, SHARDS, (*SHARDS, "shard-3"))


@query
def ring_remove_moves(spark: SparkSession, d: str) -> DataFrame:
    return _moves(spark, d, SHARDS, SHARDS[:2])


@query
def ring_balance(spark: SparkSession, d: str) -> DataFrame:
    got = shard.balance(table(spark, d, "documents").select("doc_id"), SHARDS, (1, 10, 50, 150, 500, 1000), shard.doc_key())
    return got.select(F.col("replicas").cast("long").alias("replicas"), F.round("max_deviation", 9).alias("max_deviation"))


def _shards(spark: SparkSession, d: str) -> tuple[index.Index, DataFrame, DataFrame]:
    """The index, its documents with their shard, and its postings with theirs."""
    i = _index(spark, d)
    points = shard.ring(spark, SHARDS)
    return i, shard.assign(i.docs, points, shard.doc_key()), shard.assign(i.postings, points, shard.doc_key())


def _sharded_index(spark: SparkSession, d: str) -> index.Index:
    i, docs, post = _shards(spark, d)
    return index.Index(docs, post, i.df, i.stats)


@query
def sharded_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    best = shard.scatter_gather(_sharded_index(spark, d), _batch(spark, d), 5)
    return best.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"), "shard")


@query
def shard_summary(spark: SparkSession, d: str) -> DataFrame:
    return shard.summary(*_shards(spark, d)[1:])


@query
def shard_store(spark: SparkSession, d: str) -> DataFrame:
    """The best hits of each written shard, read back and scored with global statistics."""
    path, out = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", None
    shard.write_shards(_index(spark, d), path, SHARDS)
    for name in SHARDS:
        own = shard.open_shard(spark, path, name)
        best = rank.top_k(rank.scores(own, _one_query(spark), counts=own.df), 5)
        one = best.select(F.lit(name).alias("shard"), F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def shard_globals(spark: SparkSession, d: str) -> DataFrame:
    return shard.shard_globals(_shards(spark, d)[2])


@query
def cluster_manifest(spark: SparkSession, d: str) -> DataFrame:
    i, docs, _ = _shards(spark, d)
    return shard.manifest(docs, i.stats).select(F.array_join("shards", ",").alias("shards"), "global_document_count", F.round("global_avgdl", 9).alias("global_avgdl"))


@query
def idf_divergence(spark: SparkSession, d: str) -> DataFrame:
    _, docs, post = _shards(spark, d)
    got = shard.divergence(docs, post, _probes(spark))
    return got.select("shard", "term", F.round("local_share", 9).alias("local_share"), F.round("global_share", 9).alias("global_share"))


@query
def idf_divergence_all(spark: SparkSession, d: str) -> DataFrame:
    """The same over all terms of the sharded postings."""
    _, docs, post = _shards(spark, d)
    got = shard.divergence(docs, post)
    return got.select("shard", "term", F.round("local_share", 9).alias("local_share"), F.round("global_share", 9).alias("global_share"))


@query
def sharded_topk(spark: SparkSession, d: str) -> DataFrame:
    return shard.scatter_gather(_sharded_index(spark, d), _one_query(spark)).select(F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"), "shard")


@query
def degraded_search(spark: SparkSession, d: str) -> DataFrame:
    hits = shard.scatter_gather(_sharded_index(spark, d), _one_query(spark), down=["shard-1"])
    best = F.transform("results", lambda r: r["doc_id"].cast("string"))
    return shard.answer(hits, _one_query(spark), SHARDS, ["shard-1"]).select(
        "query_id", F.col("n_results").cast("long").alias("n_results"), F.array_join(best, ",").alias("doc_ids"), "shards_failed", "degraded"
    )


@query
def scatter_timeouts(spark: SparkSession, d: str) -> DataFrame:
    """A shard that takes longer than connecting, reading and one second more has failed."""
    calls = spark.createDataFrame(list(CALLS), "request long, shard string, seconds double")
    failed = F.coalesce(F.col("seconds") > round(EngineConf().budget, 9), F.lit(True))
    return calls.groupBy("request").agg(F.count_if(~failed).alias("answered"), F.array_join(F.sort_array(F.collect_list(F.when(failed, F.col("shard")))), ",").alias("shards_failed"))


# ---- stateful operators ------------------------------------------------------------------------------


@query
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(KEYS)], "n long, query string")
    rows = rows.unionByName(table(spark, d, "search_results").select(F.lit(-1).cast("long").alias("n"), F.col("query_text").alias("query")).distinct())
    return rows.select("n", "query", analyze.cache_key(F.col("query"), F.lit(10)).alias("key"))


@query
def lru_replay(spark: SparkSession, d: str) -> DataFrame:
    return state.lru_replay(table(spark, d, "events").filter("user_id is not null"), ["ts", "event_id"], "user_id", 50)


@query
def cache_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    got = state.hit_rate(state.lru_replay(table(spark, d, "events").filter("user_id is not null"), ["ts", "event_id"], "user_id", 50))
    return got.withColumn("hit_rate", F.round("hit_rate", 9))


def _breaker_log(spark: SparkSession, d: str, call: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", F.lit(f"{call}failure")).otherwise(F.lit(f"{call}success"))
    return table(spark, d, "events").select(F.concat(F.lit("shard-"), (F.col("user_id") % 3).cast("string")).alias("shard"), F.col("event_id").alias("seq"), _seconds().alias("ts"), outcome.alias("op"))


@query
def breaker_replay(spark: SparkSession, d: str) -> DataFrame:
    """The outcomes as they come, whatever the breaker says: two failures open it."""
    got = state.breaker_replay(_breaker_log(spark, d, ""), 2, 600.0)
    return got.select("shard", "seq", "state", F.col("fails").cast("long").alias("fails"))


@query
def breaker_stats(spark: SparkSession, d: str) -> DataFrame:
    """The state of each shard's breaker in the end."""
    got = state.breaker_stats(state.breaker_replay(_breaker_log(spark, d, ""), 2, 600.0))
    return got.select("shard", "state", F.col("fails").cast("long").alias("fails"))


@query
def breaker_scatter(spark: SparkSession, d: str) -> DataFrame:
    """Guarded calls: what the breaker holds back has no outcome."""
    return state.breaker_replay(_breaker_log(spark, d, "call:"), 2, 600.0).select("shard", "seq", "allowed", "state", F.col("fails").cast("long").alias("fails"))


# ---- measures ----------------------------------------------------------------------------------------


@query
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.percentiles(table(spark, d, "events"), "value")


@query
def heaps_law(spark: SparkSession, d: str) -> DataFrame:
    i = _index(spark, d)
    got = metrics.heaps(metrics.vocabulary_growth(i.postings, i.docs))
    return got.select(F.round("k", 6).alias("k"), F.round("b", 6).alias("b"))


@query
def vocabulary_growth(spark: SparkSession, d: str) -> DataFrame:
    i = _index(spark, d)
    return metrics.vocabulary_growth(i.postings, i.docs)


@query
def zipf_workload(spark: SparkSession, d: str) -> DataFrame:
    return metrics.zipf_workload(corpus(spark, d).filter("title <> ''"), "title")
