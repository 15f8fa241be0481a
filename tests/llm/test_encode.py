from __future__ import annotations

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postloom.llm import encode

needs = pytest.mark.skipif(not os.path.exists(encode.VOCABULARY), reason="no vocabulary here")
TEXTS = [None, "", " ", "Hello world, it's 42!", "\n\n\n a  b\t\tc", "<|endoftext|> x", "日本語テスト", "🙂👩\u200d👩\u200d👧", "x" * 5000, " " * 3000 + "y", "\x1c a\x1d", "a\x00b", "ſß İ", "ab" * 3000]


@pytest.fixture(scope="module")
def codec():
    return encode.Codec(encode.serialise_model(encode.read_ranks(encode.VOCABULARY)))


@pytest.fixture(scope="module")
def public():
    import public_tokenizers as p
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


@needs
def test_equals_the_public_tokenizer(codec, public):
    assert [list(x) for x in codec.encode(TEXTS)] == [public(t) for t in TEXTS]


@needs
@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(codec, public, text):
    text = text.encode("utf-8", "replace").decode()
    ids = codec.encode([text])[0]
    assert list(ids) == public(text) and codec.decode(ids) == text


@needs
def test_forgetting_changes_nothing(public):
    small = encode.Codec(encode.serialise_model(encode.read_ranks(encode.VOCABULARY)), kept=3)
    for t in TEXTS[3:8]:
        assert list(small.encode([t, t])[1]) == public(t)


@needs
def test_table(spark, public):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, "again", "x"), (None, "n", "y")], "doc_id long, text string, ids string")
    got = encode.encode_texts(df).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids) for r in got) == sorted((-1 if i is None else i, public(t)) for i, t, _ in df.collect())
    back = {r.doc_id: r.text for r in encode.decode_ids(encode.encode_texts(df.filter("doc_id > 0"))).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS) if i}
    assert encode.encode_texts(df.limit(0)).count() == 0


def test_bad_ranks(tmp_path):
    f = tmp_path / "r"
    f.write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        encode.read_ranks(str(f))
