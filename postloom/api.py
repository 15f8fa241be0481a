"""The engine as an object: search, statistics, sharded search, with a result cache on the driver."""

from __future__ import annotations

import argparse
from collections import OrderedDict
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from postloom.conf import EngineConf
from postloom.operators import rank, shard, state, storage
from postloom.operators.index import Index
from postloom.sources import wiki
from postloom.functions.urls import article_url


class LRU:
    """A cache of bounded size that drops what was used longest ago; ``clear`` keeps the counters."""

    def __init__(self, capacity: int):
        if capacity <= 0:
            raise ValueError("the capacity must be positive")
        self.capacity, self.hits, self.misses, self._kept = capacity, 0, 0, OrderedDict()

    def get(self, key):
        if key in self._kept:
            self.hits += 1
            self._kept.move_to_end(key)
            return self._kept[key]
        self.misses += 1
        return None

    def put(self, key, value) -> None:
        self._kept[key] = value
        self._kept.move_to_end(key)
        if len(self._kept) > self.capacity:
            self._kept.popitem(last=False)

    def clear(self) -> None:
        self._kept.clear()

    def __len__(self) -> int:
        return len(self._kept)

    @property
    def hit_rate(self) -> float:
        asked = self.hits + self.misses
        return self.hits / asked if asked else 0.0


class Engine:
    """Answers queries from an index whose tables are cached in the cluster."""

    def __init__(self, spark: SparkSession, index: Index, conf: EngineConf = EngineConf()):
        self.spark, self.conf = spark, conf
        self.index = Index(index.docs.cache(), index.postings.cache(), index.df, index.stats.cache())
        self.cache = LRU(conf.cache_size)
        self._sharded: Index | None = None

    @classmethod
    def open(cls, spark: SparkSession, conf: EngineConf) -> Engine:
        """The stored index, or one built from the dump, stored if the settings name a folder."""

        def build() -> Index:
            if not conf.dump_path:
                raise ValueError("neither a stored index nor a dump is given")
            got = wiki.numbered(wiki.articles(wiki.read_dump(spark, conf.dump_path), conf.corpus_size))
            return Index.build(got.select("doc_id", article_url(got["title"]).alias("url"), "title", "text"))

        return cls(spark, storage.open_or_build(spark, conf.index_dir, build), conf)

    @staticmethod
    def _checked(q: str, k: int) -> None:
        if not q:
            raise ValueError("the query is empty")
        if not 1 <= k <= 100:
            raise ValueError("k must lie between 1 and 100")

    def _query(self, q: str) -> DataFrame:
        return self.spark.createDataFrame([(0, q)], "query_id int, query string")

    def search(self, q: str, k: int = rank.TOP_K) -> dict:
        """query, total_hits and results (doc_id, title, url, score); an empty answer is remembered as well."""
        self._checked(q, k)
        key = " ".join(q.lower().split()) + f"|{k}"
        got = self.cache.get(key)
        if got is None:
            scored = rank.scores(self.index, self._query(q), self.conf.k1, self.conf.b).cache()
            try:
                total = scored.count()
                best = rank.with_titles(rank.top_k(scored, k), self.index.docs).orderBy("rank").collect()
            finally:
                scored.unpersist()
            got = {"total_hits": total, "results": [{"doc_id": r.doc_id, "title": r.title, "url": r.url, "score": r.score} for r in best]}
            self.cache.put(key, got)
        return {"query": q, **got}

    def stats(self) -> dict:
        one = self.index.stats.first()
        c = self.cache
        return {
            "document_count": one.n, "avgdl": one.avgdl, "vocabulary_size": self.index.vocabulary_size,
            "cache": {"hits": c.hits, "misses": c.misses, "hit_rate": round(c.hit_rate, 4), "size": len(c), "capacity": c.capacity},
        }

    def coordinator_stats(self, log: DataFrame) -> dict:
        """The shards, and the state of each one's breaker after a log of calls (shard, seq, ts, op)."""
        last = {r.shard: r for r in state.breaker_stats(state.breaker_replay(log, self.conf.breaker_threshold, self.conf.breaker_cooldown)).collect()}
        fresh = {"state": state.CLOSED, "consecutive_failures": 0}
        known = {s: {"state": r.state, "consecutive_failures": r.fails} for s, r in last.items()}
        return {"shards": list(self.conf.shards), "breakers": {s: known.get(s, fresh) for s in self.conf.shards}}

    def sharded(self) -> DataFrame:
        """The documents with their shard."""
        return self.sharded_index().docs

    def sharded_index(self) -> Index:
        """The index with the shard of every document and posting."""
        if self._sharded is None:
            points = shard.ring(self.spark, self.conf.shards, self.conf.replicas)
            docs, post = (shard.assign(x, points, shard.doc_key()) for x in (self.index.docs, self.index.postings))
            self._sharded = Index(docs, post.cache(), self.index.df, self.index.stats)
        return self._sharded

    def shard_search(self, name: str, q: str, k: int = rank.TOP_K) -> list[dict]:
        """What one shard answers."""
        self._checked(q, k)
        others = [s for s in self.conf.shards if s != name]
        hits = shard.scatter_gather(self.sharded_index(), self._query(q), k, others)
        best = rank.with_titles(hits, self.index.docs).orderBy("rank").collect()
        return [{"doc_id": r.doc_id, "score": r.score, "title": r.title} for r in best]

    def sharded_search(self, q: str, k: int = rank.TOP_K, down: Sequence[str] = ()) -> dict:
        """The merged answer of the shards that are up."""
        self._checked(q, k)
        hits = shard.scatter_gather(self.sharded_index(), self._query(q), k, down)
        best = rank.display_titles(rank.with_titles(hits, self.index.docs)).orderBy("rank").collect()
        failed = sorted(set(self.conf.shards) & set(down))
        return {
            "query": q, "shards_queried": len(self.conf.shards), "shards_failed": failed, "degraded": bool(failed),
            "results": [{"doc_id": r.doc_id, "title": r.title, "score": r.score, "shard": r.shard} for r in best],
        }


def main(argv: Sequence[str] | None = None) -> None:
    """Build an index from a dump and store it, also as shards: ``python -m postloom.api DUMP OUT [--limit N] [--shards A,B,C]``."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("dump")
    p.add_argument("out")
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--shards", default="", help="names of shards, set apart by commas, written to OUT/shards")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("postloom").getOrCreate()
    engine = Engine.open(spark, EngineConf(index_dir=a.out, dump_path=a.dump, corpus_size=a.limit))
    if a.shards:
        shard.write_shards(engine.index, f"{a.out}/shards", [s.strip() for s in a.shards.split(",") if s.strip()])


if __name__ == "__main__":
    main()
