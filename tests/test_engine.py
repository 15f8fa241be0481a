from __future__ import annotations

import heapq
import math
import random
from collections import Counter, OrderedDict

import pytest

from postloom.api import LRU, Engine
from postloom.conf import EngineConf
from postloom.functions.analyze import analyze_text
from postloom.operators import crawl, metrics, rank, shard, state, storage
from postloom.operators.index import DuplicateDocuments, Index
from postloom.sources import pages, wiki

DOCS = [
    (1, "u1", "One", "distributed systems are running"), (2, "u2", None, "distributed caches and running systems"),
    (3, "u3", "", "a completely unrelated document about gardening"), (4, "u4", "Four", None), (5, "u5", "Five", "the of and"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(DOCS, "doc_id long, url string, title string, text string")


@pytest.fixture(scope="module")
def engine(spark, corpus):
    return Engine(spark, Index.build(corpus))


def model(query, docs=DOCS, k=10, k1=1.2, b=0.75):
    terms = {d[0]: analyze_text(d[3]) for d in docs}
    n, avg = len(docs), sum(map(len, terms.values())) / len(docs)
    df = Counter(t for ts in terms.values() for t in set(ts))
    score, first = {}, {}
    for pos, t in enumerate(analyze_text(query)):
        for i, ts in terms.items():
            tf = ts.count(t)
            if tf:
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                score[i] = score.get(i, 0) + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(ts) / avg))
                first.setdefault(i, pos)
    best = sorted(score, key=lambda i: (-round(score[i], 10), first[i], i))[:k]
    return [(i, round(score[i], 4)) for i in best], len(score)


@pytest.mark.parametrize("query", ["distributed systems", "running running caches", "gardening", "nothing here", "the", "Systems DISTRIBUTED gardening"])
def test_search_equals_a_plain_model(engine, query):
    got, (want, total) = engine.search(query), model(query)
    assert got["total_hits"] == total
    assert [(r["doc_id"], pytest.approx(r["score"], abs=1e-4)) for r in got["results"]] == want


def test_cache_and_arguments(engine):
    before = engine.cache.hits
    assert engine.search("no such word") == engine.search("  NO such   word ") | {"query": "no such word"}
    assert engine.cache.hits == before + 1
    assert len(engine.search("distributed systems", 1)["results"]) == 1
    for bad in (("", 3), ("x", 0), ("x", 101)):
        with pytest.raises(ValueError):
            engine.search(*bad)
    s = engine.stats()
    assert s["document_count"] == 5 and s["vocabulary_size"] == len({t for d in DOCS for t in analyze_text(d[3])})


def test_shards_give_the_answer_of_one_index(engine):
    whole, parts = engine.search("distributed running systems"), engine.sharded_search("distributed running systems")
    assert [r["doc_id"] for r in parts["results"]] == [r["doc_id"] for r in whole["results"]] and not parts["degraded"]
    where = {r.doc_id: r.shard for r in engine.sharded().collect()}
    down = engine.sharded_search("distributed running systems", down=[where[1]])
    assert down["degraded"] and down["shards_failed"] == [where[1]]
    assert {r["doc_id"] for r in down["results"]} == {i for i in (1, 2) if where[i] != where[1]}
    assert {r["doc_id"] for r in engine.shard_search(where[2], "distributed")} == {i for i in (1, 2) if where[i] == where[2]}


def test_build_guards_and_empty_corpus(spark, corpus):
    with pytest.raises(DuplicateDocuments):
        Index.build(corpus.union(corpus.limit(1)))
    empty = Engine(spark, Index.build(corpus.limit(0)))
    assert empty.search("anything")["results"] == [] and empty.stats()["avgdl"] == 0.0


def test_stored_index_is_the_same(spark, corpus, tmp_path):
    path = f"file://{tmp_path}/index"
    assert not storage.is_stored(spark, path)
    conf = EngineConf(index_dir=path)
    storage.write_index(Index.build(corpus), path)
    assert storage.is_stored(spark, path)
    assert [r["doc_id"] for r in Engine.open(spark, conf).search("running systems")["results"]] == [i for i, _ in model("running systems")[0]]


def test_wiki_dump_round_trip(spark, tmp_path):
    long = "word " * 101
    rows = [(1, "A b", 0, "'''" + long + "''' [[x|y]] {{t}}"), (2, "B", 1, long), (3, "C", 0, ""), (4, None, 0, "x" * 500), (5, "E", 0, "x" * 501)]
    wiki.write_dump(spark.createDataFrame(rows, "id long, title string, ns int, text string"), f"file://{tmp_path}/d")
    got = {r.id: (r.title, r.text) for r in wiki.articles(wiki.read_dump(spark, f"file://{tmp_path}/d")).collect()}
    assert got == {1: ("A b", long + "y"), 5: ("E", "x" * 501)}
    assert wiki.articles(wiki.read_dump(spark, f"file://{tmp_path}/d"), 1).count() == 1
    e = Engine.open(spark, EngineConf(dump_path=f"file://{tmp_path}/d"))
    assert e.search("words")["results"][0]["url"] == "https://simple.wikipedia.org/wiki/A_b"


def test_wiki_clean(spark):
    cases = [
        ("[[a|b]] [[c]] [[Category:X]]", "b c Category:X"), ("x{{t}}y<ref>r\ns</ref>z<ref/>q</ref>w", "x y z w"), ("'''b''' ==h== https://e.org/p?q r", "b h r"), ("a　 b\n\nc", "a b c"),
    ]
    df = spark.createDataFrame(cases, "m string, want string")
    assert all(r.got == r.want for r in df.select("want", wiki.clean(df.m).alias("got")).collect())


def test_command_line_and_shards(spark, corpus, tmp_path):
    from postloom.api import main
    from postloom.operators import rank

    pages_ = [(i, f"T{i}", 0, f"{w} " * 200) for i, w in enumerate(("river", "mill", "river mill", "lagoon"), 1)]
    wiki.write_dump(spark.createDataFrame(pages_, "id long, title string, ns int, text string"), f"file://{tmp_path}/d")
    main([f"file://{tmp_path}/d", f"file://{tmp_path}/out", "--shards", "a, b"])
    assert storage.is_stored(spark, f"file://{tmp_path}/out")
    query = spark.createDataFrame([(0, "river")], "query_id int, query string")
    whole = {r.doc_id: r.score for r in rank.scores(storage.open_index(spark, f"file://{tmp_path}/out"), query).collect()}
    parts = {}
    for name in "ab":
        own = shard.open_shard(spark, f"file://{tmp_path}/out/shards", name)
        parts |= {r.doc_id: r.score for r in rank.scores(own, query, counts=own.df).collect()}
    assert len(whole) == 2 and parts == pytest.approx(whole)


def test_body_text(spark):
    df = spark.createDataFrame([(bytearray(b"ok \xff\xfe caf\xc3\xa9"),), (None,)], "b binary")
    assert [r.t for r in df.select(pages.body_text(df.b).alias("t")).collect()] == ["ok \ufffd\ufffd café", None]


def test_ring(spark):
    keys = spark.range(30_000).withColumnRenamed("id", "doc_id")
    three = ("shard-0", "shard-1", "shard-2")
    ring = shard.ring(spark, three)
    sizes = {r.shard: r["count"] for r in shard.assign(keys, ring, shard.doc_key()).groupBy("shard").count().collect()}
    assert sum(sizes.values()) == 30_000 and max(abs(n - 10_000) for n in sizes.values()) < 300
    gone = {(r.source, r.target): r.moved for r in shard.moves(keys, ring, shard.ring(spark, three[:2]), shard.doc_key()).collect()}
    assert all(s == t or s == "shard-2" for s, t in gone) and 0.28 < sum(n for (s, t), n in gone.items() if s != t) / 30_000 < 0.39
    new = {(r.source, r.target): r.moved for r in shard.moves(keys, ring, shard.ring(spark, (*three, "shard-3")), shard.doc_key()).collect()}
    assert all(s == t or t == "shard-3" for s, t in new) and 0.20 < sum(n for (s, t), n in new.items() if s != t) / 30_000 < 0.31
    with pytest.raises(ValueError):
        shard.ring(spark, ())


def test_lru():
    c = LRU(2)
    c.put("a", 1), c.put("b", 2), c.get("a"), c.put("c", 3)
    assert c.get("b") is None and c.get("a") == 1 and c.get("c") == 3 and len(c) == 2
    assert c.hit_rate == 3 / 4
    c.clear()
    assert len(c) == 0 and c.hits == 3
    with pytest.raises(ValueError):
        LRU(0)


@pytest.mark.parametrize("chunk,capacity", [(1, 3), (17, 5), (10_000, 40), (50, 1)])
def test_lru_replay_equals_a_cache(spark, chunk, capacity):
    import random

    r = random.Random(4)
    log = [(i, r.choice("abcdefghij") if r.random() < 0.6 else f"k{r.randrange(60)}") for i in range(700)]
    cache, want = OrderedDict(), []
    for _, k in log:
        want.append(k in cache)
        cache[k] = None
        cache.move_to_end(k)
        if len(cache) > capacity:
            cache.popitem(last=False)
    df = spark.createDataFrame(log, "t int, k string")
    got = state.lru_replay(df, ["t"], "k", capacity, chunk).orderBy("row_no").collect()
    assert [x.hit for x in got] == want


def test_breaker_transitions():
    b = state.Breaker(2, 10)
    assert b.allow(0) and (b.failure(1), b.state)[1] == "closed" and (b.failure(2), b.state)[1] == "open"
    assert not b.allow(11.9) and b.allow(12) and b.state == "half_open" and not b.allow(13)
    b.failure(14)
    assert (b.state, b.fails, b.opened) == ("open", 2, 14)
    b.failure(20)  # a late failure lengthens the pause
    assert b.opened == 20 and not b.allow(29) and b.allow(30)
    b.success()
    assert (b.state, b.fails) == ("closed", 0)
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            state.Breaker(*bad)


def test_breaker_stream_equals_replay(spark, tmp_path):
    import random

    from postloom.streaming.breaker import breaker_stream

    r = random.Random(2)
    rows = [(f"s{r.randrange(3)}", i, float(i), r.choice(["call:success", "call:failure", "call:failure", "allow"])) for i in range(300)]
    schema = "shard string, seq long, ts double, op string"
    for n in range(3):
        spark.createDataFrame(rows[n * 100 : (n + 1) * 100], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = breaker_stream(stream, 2, 5.0).writeStream.format("memory").queryName("breaker").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append")
    q.trigger(availableNow=True).start().awaitTermination(120)
    got = {(x.shard, x.seq): (x.allowed, x.state, x.fails) for x in spark.table("breaker").collect()}
    want = {(x.shard, x.seq): (x.allowed, x.state, x.fails) for x in state.breaker_replay(spark.createDataFrame(rows, schema), 2, 5.0).collect()}
    assert got == want


def test_growing_index_and_traffic(spark, corpus, tmp_path, sf_dir):
    from postloom.streaming import incremental

    rows = corpus.collect()
    for n, part in enumerate((rows[:2], rows[2:], [(2, "u2", "new", "gardening systems")])):
        spark.createDataFrame(part, corpus.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(corpus.schema).parquet(f"{tmp_path}/in/*")
        incremental.index_stream(stream, f"{tmp_path}/idx", f"{tmp_path}/cp").awaitTermination(120)
    docs = [(2, "u2", "new", "gardening systems"), *(d for d in DOCS if d[0] != 2)]
    e = Engine(spark, incremental.open_growing(spark, f"{tmp_path}/idx"))
    assert [(x["doc_id"], pytest.approx(x["score"], abs=1e-4)) for x in e.search("gardening systems")["results"]] == model("gardening systems", docs)[0]
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    schema = events.schema
    events.coalesce(1).write.parquet(f"{tmp_path}/ev")
    q = incremental.query_traffic(spark.readStream.schema(schema).parquet(f"{tmp_path}/ev")).writeStream.format("memory").queryName("traffic").outputMode("complete")
    q.option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("traffic").agg({"events": "sum"}).first()[0] == events.filter("ts is not null").count()


def test_crawl_budget_depth_and_thin_pages(spark):
    web = spark.createDataFrame([(i, "x" * (300 if i not in (2, 7) else 5)) for i in range(12)] + [(99, None)], "id long, text string")
    links = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 1), (1, 0, 3), (2, 0, 9), (3, 0, 4), (3, 1, 0), (4, 0, 5), (5, 0, 6), (1, 1, 50)], "src long, pos int, dst long")
    seeds = spark.createDataFrame([(0, 0)], "id long, seq long")
    seen, counts = crawl.crawl(web, links, seeds, 100, 3)
    assert {(r.id, r.depth, r.outcome) for r in seen.collect()} == {(0, 0, "indexed"), (1, 1, "indexed"), (2, 1, "thin"), (3, 2, "indexed"), (50, 2, "failed"), (4, 3, "indexed")}
    assert counts == {"fetched": 5, "indexed": 4, "skipped": 2, "discovered": 5}
    seen, counts = crawl.crawl(web, links, seeds, 2, 3)
    assert {r.id for r in seen.collect()} == {0, 1} and counts == {"fetched": 2, "indexed": 2, "skipped": 0, "discovered": 4}


def test_gate_robots_politeness(spark):
    urls = spark.createDataFrame([("https://a/x",), ("https://a/private/y",), ("https://b/private/z",)], "url string")
    robots = spark.createDataFrame([("a", "User-agent: *\nDisallow: /private/\n")], "host string, robots_txt string")
    assert {r.url: r.allowed for r in pages.allowed(urls, robots).collect()} == {"https://a/x": True, "https://a/private/y": False, "https://b/private/z": True}
    asked = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("a", 9)], "host string, seq long")
    assert {(r.host, r.seq): r.start for r in crawl.politeness(asked).collect()} == {("a", 1): 0.0, ("a", 3): 1.0, ("a", 9): 2.0, ("b", 2): 0.0}


def test_percentiles_and_conf(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(None,)], "v double")
    r = metrics.percentiles(df, "v").first()
    assert (r.n, r["median"], r.p95, r.p99, r["max"]) == (100, 49.5, 95.0, 99.0, 99.0)
    c = EngineConf.from_env({"SEARCH_CACHE_SIZE": "7", "SHARD_URLS": " a , b,", "BREAKER_COOLDOWN_SECONDS": "2.5"})
    assert (c.cache_size, c.shards, c.breaker_cooldown) == (7, ("a", "b"), 2.5) and EngineConf().budget == pytest.approx(3.2)


def _stored(spark, tmp_path, n=400):
    r = random.Random(4)
    words = [f"w{i}x" for i in range(300)]
    corpus = spark.createDataFrame([(i, "u", f"t{i}", " ".join(r.choices(words, k=40))) for i in range(n)], "doc_id long, url string, title string, text string")
    path = f"file://{tmp_path}/stored"
    storage.write_index(Index.build(corpus), path)
    return corpus, path, storage.open_index(spark, path)


def test_a_query_reads_its_terms_and_shuffles_no_posting(spark, tmp_path):
    corpus, path, kept = _stored(spark, tmp_path)
    query = spark.createDataFrame([(1, "w1x w2x w2x absent")], "query_id int, query string")
    scored = rank.scores(kept, query)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(term, [absent,w1x,w2x])" in plan
    whole = {r.doc_id: r.score for r in rank.scores(Index.build(corpus), query).collect()}
    got = {r.doc_id: r.score for r in scored.collect()}
    assert got.keys() == whole.keys() and all(got[k] == pytest.approx(whole[k]) for k in got)
    final = scored._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # neither the postings nor their sums are exchanged: the buckets hold whole documents
    assert "Exchange hashpartitioning" not in final and "Bucketed: true" in final
    many = {r.doc_id: r.score for r in rank.scores(kept, query, most=1).collect()}  # beyond the bound: by shuffle
    assert many.keys() == whole.keys() and all(many[k] == pytest.approx(whole[k]) for k in many)
    assert rank.scores(kept, query.limit(0)).count() == 0


def test_the_term_table_is_stored(spark, tmp_path):
    corpus, path, kept = _stored(spark, tmp_path, 60)
    stored = {r.term: tuple(r)[1:] for r in storage.read_directory(spark, path).collect()}
    want = {r.term: (r.df, r.byte_offset, r.nbytes) for r in storage.term_directory(kept.postings).collect()}
    assert stored == want and {t: x[0] for t, x in stored.items()} == {r.term: r.df for r in Index.build(corpus).df.collect()}
    ends = sorted((o, n) for _, o, n in stored.values())
    assert ends[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))
    rows = rank.lookup(kept, spark.createDataFrame([("w1x",), ("nowhere",)], "term string")).collect()
    assert {(r.term, r.df) for r in rows} == {("w1x", stored["w1x"][0]), ("nowhere", 0)} and sum(r.doc_id is not None for r in rows) == stored["w1x"][0]


def test_postings_without_document_do_not_score(spark, tmp_path):
    _, _, kept = _stored(spark, tmp_path, 60)
    query = spark.createDataFrame([(1, "w1x w2x w3x")], "query_id int, query string")
    gone = Index(kept.docs.filter("doc_id >= 30"), kept.postings, kept.df, kept.stats).without_orphans()
    whole, left = ({r.doc_id: r.score for r in rank.scores(i, query).collect()} for i in (kept, gone))
    assert left == {d: pytest.approx(s) for d, s in whole.items() if d >= 30} and len(left) < len(whole)


def test_merging_lists_equals_a_heap(spark):
    """Among equal scores the heads of the shards' lists decide, the greater id first."""
    r = random.Random(8)
    lists = {s: sorted(((r.choice([1.0, 2.0, 3.0]), d) for d in range(j, 60, 3)), key=lambda x: -x[0]) for j, s in enumerate("abc")}
    tf = {d: int(sc) for rows in lists.values() for sc, d in rows}
    post = spark.createDataFrame([("w", d, tf[d], 5, s) for s, rows in lists.items() for _, d in rows], "term string, doc_id long, tf int, length int, shard string")
    docs = post.select("doc_id", "length")
    stats = spark.createDataFrame([(60, 300, 5.0)], "n long, total_length long, avgdl double")
    got = shard.scatter_gather(Index(docs, post, spark.createDataFrame([("w", 60)], "term string, df long"), stats), spark.createDataFrame([(1, "w")], "query_id int, query string"), 8)
    want = list(heapq.merge(*([(sc, d, s) for sc, d in rows[:8]] for s, rows in lists.items()), reverse=True))[:8]
    assert [(x.doc_id, x.shard) for x in got.orderBy("rank").collect()] == [(d, s) for _, d, s in want]


@pytest.mark.parametrize("capacity,chunk", [(1, 3), (4, 1), (7, 10), (50, 13), (300, 8)])
def test_lru_carry_in_two_levels(spark, capacity, chunk):
    r = random.Random(capacity)
    log = [(i, f"k{min(r.randrange(120), r.randrange(120))}") for i in range(900)]
    cache, want = OrderedDict(), []
    for _, k in log:
        want.append(k in cache)
        cache[k] = None
        cache.move_to_end(k)
        if len(cache) > capacity:
            cache.popitem(last=False)
    got = state.lru_replay(spark.createDataFrame(log, "t long, key string"), ["t"], "key", capacity, chunk).orderBy("row_no").collect()
    assert [x.hit for x in got] == want


def test_robots_by_port_and_article_numbers(spark):
    urls = spark.createDataFrame([("https://a:8080/p/x",), ("https://a/p/x",)], "url string")
    robots = spark.createDataFrame([("a:8080", "User-agent: *\nDisallow: /p/\n")], "host string, robots_txt string")
    assert {r.url: r.allowed for r in pages.allowed(urls, robots).collect()} == {"https://a:8080/p/x": False, "https://a/p/x": True}
    found = spark.createDataFrame([(7, "b", "y"), (3, "a", "x"), (90, "c", "z")], "id long, title string, text string")
    assert {(r.doc_id, r.title) for r in wiki.numbered(found).collect()} == {(1, "a"), (2, "b"), (3, "c")}


def test_coordinator_stats(spark, engine):
    log = [("shard-0", i, float(i), "call:failure") for i in range(4)] + [("shard-1", 1, 0.0, "call:failure"), ("shard-1", 2, 1.0, "call:success")]
    got = engine.coordinator_stats(spark.createDataFrame(log, "shard string, seq long, ts double, op string"))
    assert got["shards"] == ["shard-0", "shard-1", "shard-2"] and got["breakers"]["shard-0"] == {"state": "open", "consecutive_failures": 3}
    assert got["breakers"]["shard-1"] == got["breakers"]["shard-2"] == {"state": "closed", "consecutive_failures": 0}


def test_null_and_large_query_ids(spark, engine):
    rows = [(None, "distributed"), ((1 << 62) + 1, "running systems"), (7, None), (8, "")]
    got = rank.scores(engine.index, spark.createDataFrame(rows, "query_id long, query string"))
    assert {r.query_id for r in got.collect()} == {None, (1 << 62) + 1}
