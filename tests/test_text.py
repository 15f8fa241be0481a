from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from postloom.functions.analyze import analyze_text, with_terms
from postloom.functions.urls import canonical
from postloom.sources.pages import read_page

SAMPLES = [
    None, "", "Café cafe", "ﬁne ½ foo™ ℂ", "İstanbul ΟΔΟΣ ΟΔΟΣ.", "도서관을 있다", "東京タワー", "2000 1999", "ties sing bed is as", "x" * 30 + " " + "y" * 31,
    "a_b c__d", "running runs run distributed distribute distributing indexing index shards caches cache", "the was has ands", "ⅷ ǆ Ǆ ß Straße", "naïve—co-op it's",
]


@pytest.mark.parametrize("group", [["run", "running"], ["cache", "caches"], ["distribute", "distributed", "distributing"], ["index", "indexing", "indexed"], ["shard", "shards", "sharding"]])
def test_forms_of_a_word_agree(group):
    assert len({tuple(analyze_text(w)) for w in group}) == 1


def test_stems_keep_three_letters():
    assert all(len(t) >= 2 for t in analyze_text("sing ties bed is as"))
    assert analyze_text("ties") == ["tie"] and analyze_text("organization") == ["organ"]


def test_engines_agree(spark):
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "id int, text string")
    got = {e: {r.id: list(r.terms) for r in with_terms(df, engine=e).collect()} for e in ("arrow", "native")}
    assert got["arrow"] == got["native"] == {i: analyze_text(t) for i, t in enumerate(SAMPLES)}


def test_engines_agree_on_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    a, b = ({r.doc_id: r.terms for r in with_terms(df, engine=e).collect()} for e in ("arrow", "native"))
    assert a == b


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTP://Example.COM:80/a/?utm_source=x&b=1#top", "http://example.com/a?b=1"), ("https://h:8443/", "https://h:8443/"), ("https://u:p@h//", "https://h"),
        ("https://h", "https://h/"), ("https://h/p?b=&a=1&FBCLID=2", "https://h/p?b=&a=1"), ("https://h:x/", None), (None, None),
    ],
)
def test_canonical(url, want):
    assert canonical(url) == want


@settings(max_examples=100, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.sampled_from("ab/?#&=.:"), max_size=12).map("".join))
def test_canonical_is_idempotent(tail):
    once = canonical("https://h.example/" + tail)
    again = canonical(once)
    # only a path of nothing but slashes has two forms
    assert again == once or once.partition("?")[0] == "https://h.example"


def test_pages():
    p = read_page("<title>T &amp; U</title><p>a<b>b</b></p><script>x</script><svg><a href='/no'>s</a></svg><a href='/x'>L</a><a href='mailto:q'>m</a><a href='#f'>f</a>", "https://h/d/")
    assert p == {"title": "T & U", "text": "T & U a b L m f", "links": ["https://h/x"]}
    assert read_page(None, None) == {"title": "", "text": "", "links": []}


@given(st.text(alphabet=st.characters(max_codepoint=0x1FFFF), max_size=40))
def test_marks_are_taken_out(text):
    import unicodedata

    from postloom.functions.analyze import without_marks

    assert without_marks(text) == "".join(c for c in text if not unicodedata.combining(c))
