from __future__ import annotations

import random
import time

import numpy as np
import pytest

from postloom.llm import leakage


def _case(seed=7):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["the", "Of", "é", "42", "東京"]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([1, 2, 3, 5, 8, 11, 12, 13, 20, 40])))) for i in range(60)]
    items += [(100, items[5][1] + " more words here"), (101, None), (102, "?!"), (103, "")]
    docs = []
    for i in range(300):
        own = r.choices(vocab, k=r.randrange(80))
        if i % 3 == 0:
            w = (r.choice(items)[1] or "x").split()
            a = r.randrange(len(w)) if len(w) > 13 and r.random() < 0.5 else 0
            cut = w[a : a + r.choice([5, 11, 12, 13, 60])]
            if i % 9 == 0 and len(cut) > 6:
                cut[6] = "replaced"
            at = r.randrange(len(own) + 1)
            own[at:at] = cut
        docs.append((i, r.choice([" ", "  ", ", ", "\n"]).join(own).upper() if i % 2 else "-".join(own)))
    return items, [*docs, (900, None), (901, ""), (5, docs[5][1])]


def _brute(items, docs, least=12):
    out = set()
    for d, t in docs:
        w = leakage.words(t)
        for i, x in items:
            v = leakage.words(x)
            n = min(least, len(v))
            runs = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            if any(tuple(w[k : k + n]) in runs for k in range(len(w) - n + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("bits", [leakage.FILTER_BITS, 10])
def test_equals_brute_force(spark, bits, monkeypatch):
    monkeypatch.setattr(leakage, "FILTER_BITS", bits)  # a small filter lets much pass to the join
    items, docs = _case()
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    found = leakage.leaked(d, i)
    got = [tuple(r) for r in leakage.exact_leaks(found).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(items, docs)
    assert leakage.leaked(d.limit(0), i).count() == 0 and leakage.leaked(d, i.limit(0)).count() == 0


def test_replaced_words_are_tolerated():
    item = " ".join(f"a{i}" for i in range(20))
    w = item.split()
    w[7], w[15] = "x", "y"
    ((_, _, run, stretch, replaced),) = leakage.search(["so " + " ".join(w) + " end"], [(1, item)])
    assert (run, stretch, replaced) == (7, 20, 2)


def test_masks_keep_their_ends():
    for span in range(1, 13):
        for m in leakage.masks(span):
            assert m[0] == 0 and m[-1] == span - 1 and (span < 4 or len(m) < span)
    assert len(leakage.seeds(np.arange(5, dtype=np.uint64), np.arange(12), 12, 0)) == 0


def _found(item, at):
    w = item.split()
    for k in at:
        w[k] = f"x{k}"
    return len(leakage.search(["unrelated text", "so " + " ".join(w) + " end", " ".join(w)], [(1, item)])) == 2


def test_no_replaced_position_is_blind():
    for n in range(4, 12):
        assert all(_found(" ".join(f"a{i}" for i in range(n)), [k]) for k in range(n))
    item = " ".join(f"a{i}" for i in range(12))
    assert all(_found(item, [j, k]) for j in range(12) for k in range(j + 1))


def test_a_passage_over_two_texts_is_none():
    item = [f"a{i}" for i in range(13)]
    assert leakage.search([" ".join(item[:5]), " ".join(item[6:])], [(1, " ".join(item))]) == []


def test_documents_are_read_once_however_many_items(spark):
    r = random.Random(3)
    items = [(i, " ".join(r.choices([f"v{j}" for j in range(5000)], k=30))) for i in range(400)]
    docs = [(i, " ".join(r.choices([f"v{j}" for j in range(5000)], k=20)) + " " + items[i % 400][1]) for i in range(500)]
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    d = spark.createDataFrame(docs, "doc_id long, text string").mapInArrow(seen, "doc_id long, text string")
    got = {tuple(x) for x in leakage.exact_leaks(leakage.leaked(d, spark.createDataFrame(items, "item_id long, text string"))).collect()}
    assert {(i, i % 400) for i in range(500)} <= got and reads.value == len(docs)


def test_repeated_words_take_little_time():
    began = time.time()
    ((_, _, run, size, missed),) = leakage.search(["la " * 4000], [(1, "la " * 400)])
    assert (run, size, missed) == (400, 400, 0)
    ((_, _, run, _, _),) = leakage.search(["la " * 200_000 + "end"], [(1, "la " * 3000 + "other")])
    assert run == 3000 and time.time() - began < 20


def test_diagonals_and_filter():
    a, b = np.array([3, 9], np.int32), np.array([1, 7], np.int32)
    assert leakage.diagonals([(a, b), (b, b)]).tolist() == [-6, -4, 0, 2, 6, 8]
    r = np.random.default_rng(1)
    s = r.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    bits = leakage.Bloom.size(len(s))
    words = np.zeros(1 << (bits - 6), np.uint64)
    for at in (s >> np.uint64(64 - bits), s & np.uint64((1 << bits) - 1)):
        np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
    seen = leakage.Bloom(bits, words, len(s))
    assert len(seen.passing(s)) == len(s) and len(seen.passing(r.integers(0, 1 << 63, 100_000, dtype=np.uint64))) < 20


def _plain_overlap(a, b, diagonal):
    lo, hi = max(0, -diagonal), min(len(b), len(a) - diagonal)
    same = [a[i + diagonal] == b[i] for i in range(lo, hi)]
    run = now = 0
    for x in same:
        now = now + 1 if x else 0
        run = max(run, now)
    best = (0, 0, 0)
    for i in range(len(same)):
        for j in range(i + 1, len(same) + 1):
            gaps = same[i:j].count(False)
            best = max(best, (j - i - 3 * gaps, -gaps, j - i))
    return run, best[2], -best[1]


def test_overlap_equals_all_stretches():
    r = random.Random(6)
    for _ in range(300):
        a, b = (np.array([r.randrange(3) for _ in range(r.randrange(1, 14))], np.uint64) for _ in range(2))
        d = r.randrange(-len(b) + 1, len(a))
        run, size, missed = leakage.overlap(a, b, d)
        want = _plain_overlap(a.tolist(), b.tolist(), d)
        assert run == want[0] and size - 3 * missed == want[1] - 3 * want[2]


def test_seeds_see_the_words_that_count():
    h = np.arange(1, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mask = np.array([0, 2, 3, 5])
    one = leakage.seeds(h, mask, 6, 3)
    assert len(set(one.tolist())) == len(h) - 5
    other = h.copy()
    other[[11, 14]] = 7  # places 1 and 4 of the window at 10
    two = leakage.seeds(other, mask, 6, 3)
    assert two[10] == one[10] and two[9] != one[9] and leakage.seeds(h, mask, 6, 4)[10] != one[10]


@pytest.mark.parametrize("piece", [1 << 20, 16])
def test_words_are_hashed_as_they_are_read(piece, monkeypatch):
    monkeypatch.setattr(leakage, "PIECE", piece)
    texts = ["One two_three, ONE!", None, "", "  ", "Straße x2 東京 東京", "ΟΔΟΣ οδος ὈΔΌΣ ὀδός", "a" * 100 + " b " + "a" * 100, "a\nb\n\nc", "é É e\u0301"]
    got = leakage.hashed(texts)
    assert len(got) == len(texts)
    flat = [w for t in texts for w in leakage.words(t)]
    codes = [x for h in got for x in h.tolist()]
    assert [len(h) for h in got] == [len(leakage.words(t)) for t in texts]
    same = lambda w: w.replace("ς", "σ")
    assert all((same(a) == same(b)) == (x == y) for a, x in zip(flat, codes) for b, y in zip(flat, codes)) and leakage.hashed([]) == []
