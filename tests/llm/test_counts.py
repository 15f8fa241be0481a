"""Frequencies, top N and distinctive terms against plain models, with heavy keys, ties, nulls, repeats."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from postloom.llm import distinctive, frequency, topn

POST = "build_id int, term string, doc_id long, tf int, shard string"


def _postings(n=2500, seed=3):
    r = random.Random(seed)
    tf, rows = {}, []
    for _ in range(n):
        b = r.choice([1, 1, 2, None]) if r.random() < 0.02 else r.choice([1, 2])
        t = "heavy" if r.random() < 0.35 else r.choice([None, "b", "c", *(f"t{i}" for i in range(150))])
        d = r.randrange(200) + 1000 * (b or 0)
        rows.append((b, t, d, tf.setdefault((b, t, d), r.choice([1, 2, 7])), r.choice(["x", "y"])))
    return rows + rows[:200]


def _once(rows):
    return {(b, t, d): f for b, t, d, f, _ in rows if None not in (b, t, d)}


@pytest.mark.parametrize("ranges", [16_384, 0])
def test_frequencies(spark, ranges, monkeypatch):
    monkeypatch.setattr(frequency, "LIVE_RANGES", ranges)
    rows = _postings()
    want = defaultdict(lambda: [0, 0])
    for (b, t, _), f in _once(rows).items():
        want[b, t][0] += f
        want[b, t][1] += 1
    got = frequency.value_frequencies(spark.createDataFrame(rows, POST), ["build_id"], "term", "doc_id", "tf").collect()
    assert {(r.build_id, r.term): [r.occurrences, r.records] for r in got} == dict(want)
    assert frequency.value_frequencies(spark.createDataFrame([], POST), ["build_id"], "term", "doc_id", "tf").count() == 0


def test_marks(spark):
    docs = [(1, i, 5 if i < 3 else i) for i in range(40)] + [(1, 0, 5), (1, 90, None)]
    post = [(1, "rare", 1, 3, "s"), (1, "both", 1, 1, "s"), (2, "lost", 7, 9, "s"), *((1, "common", i, 1, "s") for i in range(5)), *((1, "mid", i, 2, "s") for i in range(4))]
    freq = frequency.build_frequencies(spark.createDataFrame(post, POST), spark.createDataFrame(docs, "build_id int, doc_id long, length int"))
    got = {(r.build_id, r.field, r.entry, r.mark) for r in frequency.marked(freq).collect()}
    terms = {g for g in got if g[1] == "term"}
    assert terms == {(1, "term", "rare", "rare"), (1, "term", "both", "rare"), (1, "term", "common", "common"), (2, "term", "lost", "rare"), (2, "term", "lost", "common")}
    assert (1, "length", "5", "common") in got and (1, "length", "7", "rare") in got and (1, "length", "5", "rare") not in got


@pytest.mark.parametrize("size,most", [(200_000, 10_000), (5, 10_000), (5, 3), (1, 1)])
def test_top_n(spark, size, most):
    r = random.Random(5)
    rows = [(1 if r.random() < 0.4 else r.randrange(40), r.randrange(60), r.choice([0.5, 1.0, 1.5, -0.0, 0.0, None, float("nan"), float("-inf"), 9.25])) for _ in range(1500)]
    rows += [(None, 1, 2.0), (7, None, 99.0), (77, 1, None)]
    best = defaultdict(dict)
    for g, i, s in rows:
        if None not in (g, i, s) and s == s:
            best[g][i] = max(s, best[g].get(i, s))
    want = {(g, i, k + 1) for g, m in best.items() for k, i in enumerate(sorted(m, key=lambda i: (-m[i], i))[:10])}
    df = spark.createDataFrame([(*x, "extra", 0) for x in rows], "g int, i int, s double, n string, salt int")
    got = [(x.g, x.i, x["rank"]) for x in topn.top_n(df, "g", "i", "s", 10, size, most).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert topn.top_n(df.limit(0), "g", "i", "s").count() == 0


def _plain_em(tf, bg, own=distinctive.OWN, tol=distinctive.TOLERANCE, most=distinctive.ITERATIONS):
    p = [x / max(1, sum(tf)) for x in tf]
    for _ in range(most):
        e = [f * own * q / (own * q + (1 - own) * b) if q or b else 0.0 for f, q, b in zip(tf, p, bg, strict=True)]
        if not sum(e):
            return p
        new = [x / sum(e) for x in e]
        moved, p = max(abs(a - b) for a, b in zip(new, p, strict=True)), new
        if moved <= tol:
            break
    return p


@pytest.mark.parametrize("large", [1_000_000, 40])
def test_parsimonious_model(spark, large):
    rows = _postings(600)
    once = _once(rows)
    tot, whole, docs = defaultdict(int), defaultdict(int), defaultdict(list)
    for (b, t, d), f in once.items():
        tot[b, t] += f
        whole[b] += f
        docs[b, d].append((t, f))
    want = {}
    for (b, d), terms in docs.items():
        p = _plain_em([f for _, f in terms], [tot[b, t] / whole[b] for t, _ in terms])
        want |= {(b, d, t): x for (t, _), x in zip(terms, p, strict=True)}
    if large < 1000:  # one document that is too large to gather, solved in few steps
        rows = [(1, f"t{i}", 5, i % 4 + 1, "s") for i in range(60)] + [(1, f"t{i}", 6, 1, "s") for i in range(30)]
        got = distinctive.parsimonious(spark.createDataFrame(rows, POST), iterations=4, large=large).collect()
        same = distinctive.parsimonious(spark.createDataFrame(rows, POST), iterations=4).collect()
        a, b = ({(r.doc_id, r.term): r.p for r in x} for x in (got, same))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)
        return
    got = {(r.build_id, r.doc_id, r.term): r.p for r in distinctive.parsimonious(spark.createDataFrame(rows, POST)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert distinctive.parsimonious(spark.createDataFrame([], POST)).count() == 0


def test_em_explains_common_terms_away():
    p = distinctive.em(np.array([0]), np.array([10.0, 3.0]), np.array([0.5, 0.0001]))
    assert p[1] > 0.99 and p.sum() == pytest.approx(1)
    assert distinctive.em(np.array([0]), np.zeros(2), np.array([0.1, 0.2])).tolist() == [0, 0]


def test_best_terms(spark):
    rows = [(1, "a", 1, 2, "s"), (1, "b", 1, 2, "s"), (1, "b", 2, 1, "s"), (1, "c", 2, 1, "s"), (1, "c", 3, 1, "s"), (1, "d", 4, None, "s"), (1, None, 5, 3, "s"), (1, "a", 1, 2, "t")]
    docs = spark.createDataFrame([(1, i) for i in range(1, 7)], "build_id int, doc_id long")
    got = {r.doc_id: r.term for r in distinctive.best_terms(spark.createDataFrame(rows, POST), docs).collect()}
    assert got == {1: "a", 2: "b", 3: "c", 4: "d"}


def test_em_goes_on_until_it_converges():
    starts, tf, bg = np.array([0]), np.array([1.0, 1.0]), np.array([0.1, 0.2111])
    p = distinctive.em(starts, tf, bg)
    assert np.abs(distinctive.em(starts, tf, bg, iterations=200) - p).max() > 1e-3
    once = distinctive.OWN * p
    e = tf * once / (once + (1 - distinctive.OWN) * bg)
    assert np.abs(e / e.sum() - p).max() <= distinctive.TOLERANCE


def test_an_item_delivered_very_often(spark):
    """Most rows are one item of one group: they are combined before the shuffle, and the result is as ever."""
    df = spark.range(0, 30_000, 1, 8).selectExpr("if(id % 10 < 9, 1, id % 7) as g", "if(id % 10 < 9, 5, id % 40) as i", "cast(id % 11 as double) as s")
    got = {(r.g, r.i, r["rank"], r.score) for r in topn.top_n(df, "g", "i", "s", 3, 1000).withColumnRenamed("s", "score").collect()}
    best = defaultdict(dict)
    for r in df.collect():
        best[r.g][r.i] = max(r.s, best[r.g].get(r.i, r.s))
    assert got == {(g, i, k + 1, m[i]) for g, m in best.items() for k, i in enumerate(sorted(m, key=lambda i: (-m[i], i))[:3])}
    plan = topn.top_n(df, "g", "i", "s", 3, 1000)._jdf.queryExecution().executedPlan().toString()
    assert "SPARK_PARTITION_ID()" in plan
