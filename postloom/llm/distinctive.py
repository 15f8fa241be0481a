"""How characteristic a term is of its document: a parsimonious language model, and the plain weight.

The model explains each document as a mixture of its own term distribution and the background of the
build. Expectation-maximisation moves the mass of terms that the background explains well out of the
document's own distribution; what remains ranks the terms.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators.skew import lookup_join, small_join
from postloom.session import drop_stage, write_stage

OWN = 0.1  # share of the document's own model in the mixture
TOLERANCE = 1e-7
ITERATIONS = sys.maxsize  # none but the tolerance ends the steps
_TINY = 1e-200
LARGE = 1_000_000  # postings of a document beyond which it is not gathered into one task


def distinct_postings(postings: DataFrame) -> DataFrame:
    """(build_id, term, doc_id, tf), one row per posting; rows with a null key are left out, a null tf is 0."""
    kept = postings.dropna(subset=["build_id", "term", "doc_id"])
    return kept.groupBy("build_id", "term", "doc_id").agg(F.coalesce(F.max("tf"), F.lit(0)).cast("long").alias("tf"))


def best_terms(postings: DataFrame, indexed_docs: DataFrame) -> DataFrame:
    """(build_id, doc_id, term, weight): each document's term of highest tf * ln(1 + (N - df + 0.5) / (df + 0.5)).

    Among equal weights the smaller term in code point order. df counts distinct documents of the build
    in ``postings``, N those in ``indexed_docs``: 0 for a build that is not there, whose weights are then
    negative. Postings delivered twice count once, a null tf is 0. Documents that only have null terms do not come out; an empty table gives an
    empty result.
    """
    once = write_stage(distinct_postings(postings), "postings")
    df = once.groupBy("build_id", "term").agg(F.count(F.lit(1)).alias("df"))
    docs = indexed_docs.dropna(subset=["build_id", "doc_id"]).select("build_id", "doc_id").distinct().groupBy("build_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    idf = F.log(F.lit(1.0) + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    stats = write_stage(small_join(df, docs, ["build_id"]).select("build_id", "term", "df", idf.alias("idf")), "idf")
    scored = lookup_join(once, stats, ["build_id", "term"], "df").select("build_id", "doc_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    best = scored.groupBy("build_id", "doc_id").agg(F.min(F.struct((-F.col("w")).alias("neg"), "term")).alias("b"))
    return best.select("build_id", "doc_id", "b.term", (-F.col("b.neg")).alias("weight"))


def em(starts: np.ndarray, tf: np.ndarray, background: np.ndarray, own: float = OWN, tolerance: float = TOLERANCE, iterations: int = ITERATIONS) -> np.ndarray:
    """Own-model probabilities of many documents at once; document k holds the terms from starts[k] on.

    A document stops at the first step in which none of its probabilities moves by more than the
    tolerance, whatever else is in the batch.
    """
    total = np.add.reduceat(tf, starts)
    lens = np.diff(np.append(starts, len(tf)))
    p = tf / np.repeat(np.where(total > 0, total, 1), lens)
    live, steps = np.flatnonzero(total > 0), 0
    while len(live) and steps < iterations:
        # the documents still moving, side by side, until a quarter of them has come to rest
        ln = lens[live]
        s = np.cumsum(ln) - ln
        own_no = np.repeat(np.arange(len(live)), ln)
        at = starts[live][own_no] + np.arange(ln.sum()) - s[own_no]
        x, t, rest = p[at], tf[at], (1 - own) * background[at]
        done = np.zeros(len(live), bool)
        while steps < iterations and 4 * np.count_nonzero(done) <= len(done) and not done.all():
            mixed = own * x
            e = t * mixed / (mixed + rest)
            new = e / np.add.reduceat(e, s)[own_no]
            ended = (np.maximum.reduceat(np.abs(new - x), s) <= tolerance) & ~done
            x, steps = new, steps + 1
            if ended.any():
                kept = ended[own_no]
                p[at[kept]] = x[kept]
                done |= ended
            if steps % 64 == 0:
                x[x < _TINY] = 0.0  # denormal numbers are slow
        moving = ~done[own_no]
        p[at[moving]] = x[moving]
        live = live[~done]
    return p


def _em_batches(own: float, tolerance: float, iterations: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(t: pa.Table) -> pa.RecordBatch:
            b, d = t.column("build_id").to_numpy(), t.column("doc_id").to_numpy()
            starts = np.append(0, np.flatnonzero((b[1:] != b[:-1]) | (d[1:] != d[:-1])) + 1)
            p = em(starts, t.column("tf").to_numpy().astype(float), t.column("bg").to_numpy(), own, tolerance, iterations)
            out = t.select(["build_id", "doc_id", "term"]).append_column("p", pa.array(p)).combine_chunks()
            return out.to_batches()[0]

        for b in batches:
            if not b.num_rows:
                continue
            # all but the last document of the batch are complete
            last_b, last_d = b.column("build_id")[-1].as_py(), b.column("doc_id")[-1].as_py()
            bn, dn = (b.column(c).to_numpy(zero_copy_only=False) for c in ("build_id", "doc_id"))
            ended = np.flatnonzero((bn != last_b) | (dn != last_d))
            if held and ((held[-1].column("build_id")[-1].as_py(), held[-1].column("doc_id")[-1].as_py()) != (last_b, last_d) or len(ended)):
                cut = int(ended[-1]) + 1 if len(ended) else 0
                yield solve(pa.Table.from_batches([*held, b.slice(0, cut)] if cut else held))
                held = [b.slice(cut)]
            elif len(ended):
                cut = int(ended[-1]) + 1
                yield solve(pa.Table.from_batches([b.slice(0, cut)]))
                held = [b.slice(cut)]
            else:
                held.append(b)
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _em_tables(rows: DataFrame, own: float, tolerance: float, iterations: int) -> DataFrame:
    """The same for documents too large for one task: each step is an aggregation with map-side combine."""
    key = ["build_id", "doc_id"]
    total = rows.groupBy(*key).agg(F.sum("tf").alias("total"))
    now = write_stage(lookup_join(rows, total, key, None, 1).withColumn("p", F.col("tf") / F.greatest("total", F.lit(1))).withColumn("moved", F.lit(1.0)), "em")
    for _ in range(iterations):
        mixed = own * F.col("p")
        e = now.withColumn("e", F.col("tf") * mixed / (mixed + (1 - own) * F.col("bg")))
        per = e.groupBy(*key).agg(F.sum("e").alias("sum_e"), F.max("moved").alias("most"))
        step = F.when((F.col("most") > tolerance) & (F.col("sum_e") > 0), F.col("e") / F.col("sum_e")).otherwise(F.col("p"))
        new = lookup_join(e, per, key, None, 1).withColumn("next", step)
        new = new.withColumn("moved", F.abs(F.col("next") - F.col("p"))).withColumn("p", F.col("next"))
        before, now = now, write_stage(new.select(*key, "term", "tf", "bg", "total", "p", "moved"), "em")
        drop_stage(before)
        if now.filter(F.col("moved") > tolerance).isEmpty():
            break
    return now.select(*key, "term", "p")


def parsimonious(
    postings: DataFrame, own: float = OWN, tolerance: float = TOLERANCE, iterations: int = ITERATIONS, large: int = LARGE
) -> DataFrame:
    """(build_id, doc_id, term, p): the converged probability of each term in its document's own model.

    Each document takes as many steps as it needs to meet the tolerance, unless ``iterations`` bounds them.

    The probabilities of a document sum to 1; terms that the background of the build explains fall
    towards 0. Postings delivered twice count once; rows with a null key are left out; a document whose
    counts are all 0 gets probabilities of 0. An empty table gives an empty result. Documents of more
    than ``large`` postings are never gathered: they take the same steps as table operations.
    """
    once = write_stage(distinct_postings(postings), "postings")
    terms = write_stage(once.groupBy("build_id", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tot")), "terms")
    totals = terms.groupBy("build_id").agg(F.sum("tot").alias("all"))
    back = small_join(terms, totals, ["build_id"]).select("build_id", "term", "df", (F.col("tot") / F.greatest("all", F.lit(1))).alias("bg"))
    back = write_stage(back, "background")
    rows = lookup_join(once, back, ["build_id", "term"], "df").select("build_id", "doc_id", "term", "tf", "bg")
    big = once.groupBy("build_id", "doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > large).select("build_id", "doc_id")
    if big.isEmpty():
        return _gathered(rows, own, tolerance, iterations)
    rows = lookup_join(rows, big.withColumn("big", F.lit(True)), ["build_id", "doc_id"], None, 1)
    huge = _em_tables(rows.filter(F.col("big")).drop("big"), own, tolerance, iterations)
    return _gathered(rows.filter(F.col("big").isNull()).drop("big"), own, tolerance, iterations).unionByName(huge)


def _gathered(rows: DataFrame, own: float, tolerance: float, iterations: int) -> DataFrame:
    ordered = rows.repartition("build_id", "doc_id").sortWithinPartitions("build_id", "doc_id")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select("build_id", "doc_id", "term").schema)
    return ordered.mapInArrow(_em_batches(own, tolerance, iterations), schema + ", p double")
