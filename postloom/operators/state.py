"""Stateful operators replayed over logs: an LRU cache, a circuit breaker."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.operators.skew import CHUNK_ROWS, number_rows
from postloom.session import write_stage

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"


def lru_replay(log: DataFrame, order: list[str], key: str, capacity: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(row_no, key, hit) of a log of reads through an LRU cache that is filled on a miss.

    The log is cut into chunks of equal size. What the cache holds after a chunk depends only on the last
    ``capacity`` distinct keys, so each chunk lists its own, the lists are merged in order, which gives the
    cache at the start of every chunk, and the chunks are then replayed side by side. Lists are merged in two
    levels: those of runs of chunks in one task, those within each run side by side, so no task merges more
    than about the square root of all lists.
    """
    if capacity < 1:
        raise ValueError("a cache holds at least one entry")
    rows = number_rows(log, order[:1], order[1:] or order[:1], [key]).select("row_no", F.col(key).cast("string").alias("key"))
    rows = write_stage(rows.withColumn("chunk", F.floor(F.col("row_no") / chunk_rows)), "lru")
    run = max(1, math.isqrt(-(-rows.count() // chunk_rows)))  # chunks of a run

    def latest(of: DataFrame, part: str) -> DataFrame:
        """Of each part, the last ``capacity`` distinct keys."""
        last = of.groupBy(part, "key").agg(F.max("at").alias("at"))
        recent = Window.partitionBy(part).orderBy(F.col("at").desc())
        return last.withColumn("r", F.row_number().over(recent)).filter(F.col("r") <= capacity).select(part, "key", "at")

    lists = write_stage(latest(rows.select("chunk", "key", F.col("row_no").alias("at")), "chunk"), "lists")
    lists = lists.withColumn("run", F.floor(F.col("chunk") / run))
    runs = latest(lists, "run")

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: OrderedDict = OrderedDict()
        now, group = None, None

        def state() -> pd.DataFrame:
            return pd.DataFrame({"part": now, "key": list(held), "age": range(len(held))})

        for b in batches:
            for g, part, k in zip(b["g"], b["part"], b["key"], strict=True):
                if g != group:
                    held.clear()
                    now, group = None, g
                if part != now:
                    now = part
                    if held and part >= 0:
                        yield state()
                held.pop(k, None)
                held[k] = None
                if len(held) > capacity:
                    held.popitem(last=False)

    # one list of at most ``capacity`` keys per run passes through one task, in order
    merged = runs.select(F.lit(0).alias("g"), F.col("run").alias("part"), "key", "at").coalesce(1).sortWithinPartitions("part", "at")
    begin = merged.mapInPandas(carry, "part long, key string, age int")
    # within a run, the lists follow what the cache held before it
    inside = lists.select(F.col("run").alias("g"), F.col("chunk").alias("part"), "key", "at").unionByName(
        begin.select(F.col("part").alias("g"), F.lit(-1).cast("long").alias("part"), "key", F.col("age").cast("long").alias("at"))
    )
    inside = inside.repartition("g").sortWithinPartitions("g", "part", "at").mapInPandas(carry, "part long, key string, age int")
    at_start = inside.withColumnRenamed("part", "chunk")

    def replay(chunk: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        cache = OrderedDict.fromkeys(start.sort_values("age")["key"])
        chunk = chunk.sort_values("row_no")
        hits = []
        for k in chunk["key"]:
            hits.append(k in cache)
            cache[k] = None
            cache.move_to_end(k)
            if len(cache) > capacity:
                cache.popitem(last=False)
        return pd.DataFrame({"row_no": chunk["row_no"], "key": chunk["key"], "hit": hits})

    return rows.groupBy("chunk").cogroup(at_start.groupBy("chunk")).applyInPandas(replay, "row_no long, key string, hit boolean")


def hit_rate(replayed: DataFrame) -> DataFrame:
    """One row: accesses, hits and their share, 0 without traffic."""
    n, h = F.count(F.lit(1)), F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0))
    return replayed.agg(n.alias("accesses"), h.alias("hits"), F.when(n > 0, h / n).otherwise(0.0).alias("hit_rate"))


class Breaker:
    """A circuit breaker over event time in seconds: closed, open after failures, half open after a pause."""

    def __init__(self, threshold: int = 3, cooldown: float = 10.0, state: str = CLOSED, fails: int = 0, opened: float = 0.0):
        if threshold < 1 or cooldown <= 0:
            raise ValueError("the threshold is at least 1 and the cooldown positive")
        self.threshold, self.cooldown, self.state, self.fails, self.opened = threshold, cooldown, state, fails, opened

    def allow(self, now: float) -> bool:
        """Whether a request may go out; an open breaker lets one probe through when its pause is over."""
        if self.state == OPEN and now - self.opened >= self.cooldown:
            self.state = HALF_OPEN
            return True
        return self.state == CLOSED

    def success(self) -> None:
        self.state, self.fails = CLOSED, 0

    def failure(self, now: float) -> None:
        if self.state != HALF_OPEN:
            self.fails += 1
        if self.state == HALF_OPEN or self.fails >= self.threshold:
            self.state, self.opened = OPEN, now

    def step(self, op: str, now: float) -> bool | None:
        """One event of a log: ``allow``, ``success``, ``failure``, or ``call:success`` / ``call:failure``, a
        guarded call whose outcome counts only if it is let through."""
        if op == "allow":
            return self.allow(now)
        if op.startswith("call:"):
            if not self.allow(now):
                return False
            self.success() if op == "call:success" else self.failure(now)
            return True
        self.success() if op == "success" else self.failure(now)
        return None


def breaker_replay(log: DataFrame, threshold: int = 3, cooldown: float = 10.0) -> DataFrame:
    """(shard, seq, op, allowed, state, fails) after each event of (shard, seq, ts, op), in order of seq.

    Shards are independent. The events of one stream through one task in order, with constant memory: the
    state before an event depends on all events before it.
    """
    Breaker(threshold, cooldown)
    ordered = log.select("shard", "seq", F.col("ts").cast("double").alias("ts"), "op").repartition("shard").sortWithinPartitions("shard", "seq")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, b = None, Breaker(threshold, cooldown)
        for batch in batches:
            out = []
            for shard, ts, op in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                if shard != now:
                    now, b = shard, Breaker(threshold, cooldown)
                out.append((b.step(op, ts), b.state, b.fails))
            if out:
                a, s, f = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(3), pa.array(a, pa.bool_()), pa.array(s), pa.array(f, pa.int32())],
                    ["shard", "seq", "op", "allowed", "state", "fails"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema}
    return ordered.mapInArrow(fold, f"shard {kinds['shard']}, seq {kinds['seq']}, op string, allowed boolean, state string, fails int")


def breaker_stats(replayed: DataFrame) -> DataFrame:
    """(shard, state, fails) after the last event of each shard of a replayed log."""
    last = replayed.groupBy("shard").agg(F.max_by(F.struct("state", "fails"), "seq").alias("x"))
    return last.select("shard", "x.state", "x.fails")
