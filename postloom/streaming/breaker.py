"""The circuit breaker over a stream of events, one state per shard."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postloom.operators.state import Breaker

_OUT = "shard string, seq long, op string, allowed boolean, state string, fails int"
_STATE = "state string, fails int, opened double"


def breaker_stream(events: DataFrame, threshold: int = 3, cooldown: float = 10.0) -> DataFrame:
    """(shard, seq, op, allowed, state, fails) per event of a stream (shard, seq, ts, op).

    Events of a shard are taken in order of seq within a micro-batch and must not come earlier than those
    of earlier batches. Time is that of the events, never the clock.
    """
    Breaker(threshold, cooldown)

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b = Breaker(threshold, cooldown, *(state.get if state.exists else ("closed", 0, 0.0)))
        rows = pd.concat(list(batches)).sort_values("seq")  # what one micro-batch holds of one shard
        done = [(b.step(op, ts), b.state, b.fails) for op, ts in zip(rows["op"], rows["ts"], strict=True)]
        state.update((b.state, b.fails, float(b.opened)))
        allowed, states, fails = zip(*done, strict=True)
        yield pd.DataFrame({"shard": key[0], "seq": rows["seq"], "op": rows["op"], "allowed": pd.array(allowed, dtype="boolean"), "state": states, "fails": fails})

    slim = events.select("shard", F.col("seq").cast("long").alias("seq"), F.col("ts").cast("double").alias("ts"), "op")
    return slim.groupBy("shard").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
