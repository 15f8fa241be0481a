from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest

from postloom.llm import quality, segments

PROSE = ["The keeper of the river has a map of the old mill, and it is kept in the library.", "Das ist nicht die alte Brücke, sondern eine neue.", "Es la casa de la montaña y no la del río.", "この橋は村の北にある。"]


def _docs(n=240, seed=1):
    r = random.Random(seed)
    words = "mill river tower lagoon bread canal council garden harbour quarry".split()
    out, truth = [], {}
    for i in range(n):
        kind = i % 4
        if kind < 2:
            t = " ".join(r.choice(PROSE) for _ in range(r.randrange(1, 9)))
            t = "Heading\n" + t if i % 8 == 0 else t
        elif kind == 2:
            t = "\n".join(f"{k} {r.choice(words).title()}" for k in range(r.randrange(6, 20)))
        else:
            t = "\n".join(" | ".join([r.choice(words), *(str(r.randrange(999)) for _ in range(3))]) for _ in range(r.randrange(5, 15)))
        out.append((i, t))
        truth[i] = kind < 2
    return out, truth


def test_mixture_tells_prose_from_the_rest(spark):
    docs, truth = _docs()
    labels = [(i, int(truth[i])) for i in range(0, 240, 3)] + [(0, int(truth[0])), (1, None)]
    d = spark.createDataFrame([*docs, (900, None), (901, " \n "), (None, "x y z")], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    shares = quality.class_shares(d, lab, components=8).collect()
    assert {r.doc_id for r in shares} == set(truth)
    assert all(abs(r.prose + r["list"] + r["table"] + r["junk"] - 1) < 1e-6 for r in shares)
    held_out = [r for r in shares if r.doc_id % 3]
    assert np.mean([(r.prose > 0.5) == truth[r.doc_id] for r in held_out]) > 0.98
    without = quality.class_shares(d, lab.limit(0), components=8).collect()
    assert np.mean([(r.prose > 0.5) == truth[r.doc_id] for r in without]) > 0.9
    assert quality.class_shares(d.limit(0), lab).count() == 0


def test_held_out_labels_of_the_test_data(spark):
    import os

    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test data here")
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    judged = {r.doc_id: r.quality for r in labels.dropna().distinct().collect()}
    kept = [i for i in sorted(judged) if i % 2]
    train = labels.filter(~labels.doc_id.isin(kept))
    got = {r.doc_id: r.prose > 0.5 for r in quality.class_shares(docs, train).collect()}
    assert np.mean([got[i] == (judged[i] == 1) for i in kept]) >= 0.95


def test_density_and_sufficient_statistics_equal_plain_formulas():
    r = np.random.default_rng(0)
    f = r.normal(size=(200, quality.N))
    resp = r.random((200, 3))
    resp /= resp.sum(1, keepdims=True)
    mix = quality.maximise(quality.sufficient(f, resp), 3, np.zeros(quality.N), np.ones(quality.N), 0.05)
    for k in range(3):
        mean = resp[:, k] @ f / resp[:, k].sum()
        cov = np.cov(f.T, aweights=resp[:, k], bias=True) + 0.05 * np.eye(quality.N)
        assert np.allclose(mix.mean[k], mean) and np.allclose(mix.cov[k], cov)
        dev = f - mean
        plain = np.log(mix.weight[k]) - 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ni,ij,nj->n", dev, np.linalg.inv(cov), dev))
        assert np.allclose(mix.joint(f)[:, k], plain)
    post, _ = mix.posterior(f)
    assert np.allclose(post.sum(1), 1) and mix.posterior(f[:0])[0].shape == (0, 3)


# the same statistics, segment by segment and word by word
_TOKEN = re.compile(r"[^\W_]+")
_SPLIT = re.compile(r"(?<=[.!?…])(?<!^\d\.)(?<!^\d\d\.)(?<!^\d\d\d\.)[\"'”’»)]*\s+|(?<=[。！？])(?![」』])")
_BROKEN = re.compile("[\ufffd\x7f-\x84\x86-\x9f]|[ÃÂÐÑ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œ]|â€")
_KOREAN = re.compile("[가-힣]+(?:은|는|이|가|을|를|에|에서|에는|의|다|로|으로|들은|과|와)$")


def _plain_segments(text):
    return [s.strip() for line in text.split("\n") if line.strip() for s in _SPLIT.split(line) if s and s.strip()]


def _plain_measures(core):
    every = _TOKEN.findall(core)
    found = [w for w in every if w.isalpha()]
    n = max(1, len(every))
    letters, digits = sum(map(str.isalpha, core)), sum(map(str.isdigit, core))
    shown = max(1, len(core) - sum(map(str.isspace, core)))
    low = [w.lower() for w in found]
    unspaced = len(re.findall("[\u3040-\u30ff\u4e00-\u9fff]", core))
    words, length = float(n), sum(map(len, found)) / max(1, len(found))
    common = sum(w in segments.COMMON_WORDS for w in low) + sum(1 for w in found if _KOREAN.match(w))
    if 2 * unspaced > letters > 0:
        common, words, length = len(re.findall("[のはにをがでともへ]", core)), unspaced / 2.2, 4.5
    again = sum(w in low[max(0, i - 8) : i] for i, w in enumerate(low))
    bare = core.rstrip("\"'”’»)」』")
    share = min(1.0, common / max(1.0, words))
    return [
        share, min(length, 20.0), (max(0, shown - letters - digits) / shown) ** 0.5, (digits / shown) ** 0.5, float(bare.endswith(tuple(".!?…。！？؟।"))),
        min(4.0, np.log1p(words)), again / n if found else 0.0, min(10.0 * len(_BROKEN.findall(core)) / shown, 2.0), sum(w[:1].isupper() for w in found) / n,
    ]


TEXTS = [
    *PROSE, "", " ", "\n", "One. Two!\n\n1. Item one\n  \nx", "12. a\n1234. b\n٣. c", "He said \"no.\" Then 'go!' ended", "end.\"\nnext.\"  \n\n", "川がある。山がある。」と言う。\n人は。",
    "약 42명이 도서관 근처에 산다. 도서관에서 본다!", "Ã©tÃ© â€œx \x80\x81 \ufffd", "a\tb\t\tc  d - e – f-g\u3000h\x85i\u2028j.", "x" * 3000 + ". " + "y z " * 500, "ÀÉ ǅ ß İx", "the The THE the cat", "_a_b_ c1 2d 33",
    "... !? .", ")) .\" a", "\ud800 lone", "1. 2. 3. x", "a.b. c",
]


@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_statistics_equal_plain_ones(piece, monkeypatch):
    monkeypatch.setattr(segments, "PIECE", piece)
    r = random.Random(3)
    alphabet = ["the", "und", "Mill", "x1", "산다", "川", "。", "」", ".", "!", "\"", " ", " ", "\n", "\t", "-", "12", "…", "Ã©", "é", "\u00a0"]
    texts = TEXTS + ["".join(r.choices(alphabet, k=r.randrange(60))) for _ in range(400)]
    owner, chars, f = segments.text_statistics(texts, segments.Tables())
    want = [(i, s) for i, t in enumerate(texts) for s in _plain_segments(t)]
    assert owner.tolist() == [i for i, _ in want] and chars.tolist() == [len(s) for _, s in want]
    own = [segments.FEATURES.index(x) for x in ("common", "word_length", "symbols", "digits", "ended", "log_words", "repeated", "broken", "capitals")]
    assert np.allclose(f[:, own], [_plain_measures(s) for _, s in want])
    words = np.maximum(1.0, np.expm1([np.log1p(max(1.0, len(_TOKEN.findall(s)))) for _, s in want]))
    assert (f[:, 10] <= 1).all() and (f[:, 6] <= 2).all() and len(words) == len(f)
    assert segments.text_statistics([], segments.Tables())[2].shape == (0, segments.N)


def test_separators_and_neighbours():
    at = segments.FEATURES.index("separators")
    for text, n in (("a, b; c", 2), ("a - b", 1), ("a\tb", 1), ("a   b", 1), ("- a b -", 0), ("a-b c", 0)):
        assert segments.text_statistics([text], segments.Tables())[2][0, at] == pytest.approx(n / max(1, len(_TOKEN.findall(text))))
    f = segments.text_statistics(["Title\nIt is the mill of it.", "Title"], segments.Tables())[2]
    assert f[0, -1] == f[1, -1] == pytest.approx(5 / 7) and f[2, -1] == 0


def test_features_of_odd_segments():
    for s in ["", "x", "....", "\x00", "a" * 100_000, "1" * 50]:
        assert len(quality.features(s)) == quality.N and np.isfinite(quality.features(s)).all()


def test_a_long_text_takes_little_time():
    text = "The mill, it is old. " * 60_000
    began = time.time()
    assert len(segments.text_statistics([text, "\n" * 500_000, "." * 500_000], segments.Tables())[0]) == 60_001
    assert time.time() - began < 5


def test_the_grid_stands_for_the_rows(spark):
    docs, _ = _docs(160)
    stats = quality.segment_statistics(spark.createDataFrame(docs, "doc_id long, text string")).cache()
    n, rows, cells = stats.count(), quality._total(stats, lambda b: np.concatenate([quality._matrix(b).sum(0), (quality._matrix(b) ** 2).sum(0)]), 22), quality.grid(stats)
    got = quality._total(cells, lambda b: (lambda n, f, v: np.concatenate([[n.sum()], n @ f, n @ (f**2 + v)]))(*quality._cells(b)), 23)
    assert got[0] == n and np.allclose(got[1:], rows, atol=1e-3) and cells.count() < n
    one, many = quality.fit_mixture(stats, 8), quality.fit_mixture(stats, 8, one_task=0)
    assert one.rounds == many.rounds and np.allclose(one.mean, many.mean, atol=1e-6)
    stats.unpersist()


def test_steps_climb_until_they_converge():
    r = np.random.default_rng(4)
    f = np.concatenate([r.normal(m, 0.2, (300, quality.N)) for m in (0.2, 0.8)]) + 0.2
    seen = []

    def total(step, size):
        got = step(np.ones(len(f)), f, np.zeros_like(f))
        if size == 2 * (1 + 2 * quality.N + quality.N**2) + 1 or len(got) % 2:
            seen.append(got[-1])
        return got

    mix = quality.em(total, 4, 1e-6, 0.05)
    steps = seen[-mix.rounds :]
    assert mix.rounds > 2 and all(b - a > -1e-6 for a, b in zip(steps, steps[1:])) and steps[-1] - steps[-2] < 1e-6 * len(f)


def test_document_statistics_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "the cat.\nno")], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in quality.document_statistics(df).collect()}
    assert got[1] == got[2] == got[3] == (0, None, None, None, None)
    assert got[4] == pytest.approx((3, 8 / 3, 1 / 9, 0.5, 2 / 3))
