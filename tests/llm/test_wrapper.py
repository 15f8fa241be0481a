"""Wrapper induction: trees of pages, their matching, and what the pages of a host share."""

from __future__ import annotations

import random
import time

import pytest

from postloom.llm import dom, wrapper


def _match(a, b, **kw):
    return wrapper.simple_tree_matching(wrapper.Tree(a), wrapper.Tree(b), **kw)


def test_tree_matching():
    a = [(0, "h1", "x"), (0, "p", "1"), (0, "ul", ""), (1, "li", "a"), (1, "li", "b")]
    b = [(0, "p", "0"), (0, "h1", "x"), (0, "p", "2"), (0, "ul", ""), (1, "li", "a")]
    n, pairs = _match(a, b)
    assert n == 4 and pairs == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert _match([], b) == (0, [])


def _forest(r, depth=0):
    out = []
    for _ in range(r.randrange(4 - depth)):
        out.append((depth, r.choice("abc"), r.choice(["", "s", "t"])))
        if depth < 3:
            out += _forest(r, depth + 1)
    return out


def _brute(x, y, t, u):
    """Size of the largest match of two rows of subtrees, by trying all."""
    if not x or not y:
        return 0
    best = max(_brute(x[1:], y, t, u), _brute(x, y[1:], t, u))
    if t.tags[x[0]] == u.tags[y[0]]:
        best = max(best, 1 + _brute(t.kids[x[0]], u.kids[y[0]], t, u) + _brute(x[1:], y[1:], t, u))
    return best


def test_matching_is_the_largest():
    r = random.Random(2)
    for _ in range(150):
        a, b = _forest(r), _forest(r)
        t, u = wrapper.Tree(a), wrapper.Tree(b)
        n, pairs = wrapper.simple_tree_matching(t, u)
        assert n == len(pairs) == _brute(t.roots, u.roots, t, u)
        assert all(a[i][:2] == b[j][:2] for i, j in pairs) and len({j for _, j in pairs}) == n
        m, parts = wrapper.simple_tree_matching(t, u, exact=0, part=2)  # part by part: a match, if not the largest
        assert m == len(parts) <= n and all(a[i][:2] == b[j][:2] for i, j in parts) and [j for _, j in parts] == sorted(j for _, j in parts)


def test_large_forests_get_the_largest_match():
    """Rows of siblings on both sides of 250,000 pairs: the match is a longest common subsequence of the tags."""
    r = random.Random(3)
    for size in (480, 520, 700):
        a, b = ([(0, r.choice(("p", "h2", "li")), str(r.randrange(40))) for _ in range(size)] for _ in range(2))
        row = [0] * (size + 1)
        for _, tag, _ in a:
            above, row = row, [0]
            for j, (_, other, _) in enumerate(b):
                row.append(above[j] + 1 if tag == other else max(above[j + 1], row[j]))
        n, pairs = _match(a, b)
        assert n == len(pairs) == row[-1] and all(a[i][1] == b[j][1] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))


def test_the_match_does_not_depend_on_how_it_is_computed():
    r = random.Random(4)
    for k in range(150):
        a, b = _forest(r), _forest(r)
        if k % 5 == 0:  # long rows, whose steps are held block by block
            a, b = (z + [(0, r.choice("abc"), r.choice("st")) for _ in range(r.randrange(100, 300))] for z in (a, b))
        want = _match(a, b, exact=10**9)
        for kw in ({}, {"exact": 0}, {"exact": 0, "part": 0}, {"exact": r.randrange(200), "part": r.randrange(500)}):
            assert _match(a, b, **kw) == want


def test_deep_pages_are_aligned_once():
    a, b = ([(d, "div", str(k * d) if k else "") for d in range(dom.MOST_DEPTH) for k in (s, 0)] + [(dom.MOST_DEPTH, "p", str(i * s)) for i in range(4000)] for s in (1, 2))
    began = time.time()
    assert _match(a, b)[0] == len(a) and time.time() - began < 10


@pytest.mark.parametrize("shape", ["rows", "nested", "deep"])
def test_large_pages_are_aligned_in_bounded_time(shape):
    r = random.Random(1)
    if shape == "rows":
        a = [(0, "p", str(r.randrange(9000))) for _ in range(6000)]
    elif shape == "nested":
        a = [x for i in range(80) for x in [(0, "ul", ""), *((1, "li", str(r.randrange(500))) for _ in range(80))]]
    else:
        a = [(min(i, dom.MOST_DEPTH), "div", str(i % 7)) for i in range(4000)]
    b = [x for x in a if r.random() < 0.9 or x[0] == 0]
    began = time.time()
    n, pairs = _match(a, b)
    assert n > 0.7 * len(b) and time.time() - began < 10


def test_nodes_that_the_model_lacks_add_slots():
    model = [(0, "h1", "x"), (0, "p", "y")]
    page = [(0, "h1", "x"), (0, "h2", "new"), (0, "p", "z"), (0, "ul", ""), (1, "li", "a"), (1, "li", "b")]
    slots = wrapper.place(page, model)
    assert slots[0] == 0 and slots[2] == 1 and len(set(slots)) == 6 and slots == wrapper.place([*page[:5], (1, "li", "c")], model)


def test_signatures_name_the_layout():
    page = [(0, "table", ""), (1, "tr", ""), (2, "td", "1"), (2, "td", "2"), (0, "p", "x"), (1, "~ b", "")]
    other = [(0, "p", "y"), (0, "table", ""), (1, "tr", ""), (2, "td", "1"), (1, "tr", ""), (2, "td", "3")]
    assert wrapper.signatures(page) == wrapper.signatures(other)
    fewer = [(0, "p", "y"), (0, "table", ""), (1, "tr", "")]
    a, b = wrapper.signatures(page), wrapper.signatures(fewer)
    assert a[0] != b[0] and a[1:] == b[1:] and a[2] != wrapper.signatures([(0, "p", "")])[2]


TREES = [
    (None, []), (" \n", []), ("plain\nlines", [(0, "p", "plain"), (0, "p", "lines")]),
    ('<div class="b a"><p id=x>one <b>two</b></p></div>', [(0, "div.a.b", ""), (1, "p", "one two"), (2, "@id", "x"), (2, "~ b", "")]),
    ("<ul><li>x<li>y</ul>z", [(0, "ul", ""), (1, "li", "x"), (1, "li", "y"), (0, "p", "z")]),
    ("{{Box\n| name = A\n| size = {{c|5}}\n}}\ntext", [(0, "tpl:box", "Box"), (1, "arg:name", "A"), (1, "arg:size", ""), (2, "tpl:c", "c"), (3, "arg", "5"), (0, "p", "text")]),
    ("x<ref name=a>note</ref> y", [(0, "p", "x y"), (1, "~ ref", "note")]),
    ("x [[a b|c]] y\n[[Category:Z]]", [(0, "p", "x c y"), (1, "@link", "a b"), (0, "link:category", "Z")]),
    ("{| class=q\n! h\n|-\n| 1 || 2\n|}", [(0, "table", ""), (1, "@attributes", "class=q"), (1, "tr", ""), (2, "th", "h"), (1, "tr", ""), (2, "td", "1"), (2, "td", "2")]),
    ("# T\n\n- a\n- b **c**\n\nend", [(0, "h1", "T"), (0, "ul", ""), (1, "li", "a"), (1, "li", "b c"), (0, "p", "end")]),
    ("\\section{S}\n\\begin{itemize}\n\\item a\n\\end{itemize}\n$$x^2$$", [(0, "h2", "S"), (0, "env.itemize", ""), (1, "li", "a"), (0, "formula", "x^2")]),
]


@pytest.mark.parametrize("text,want", TREES)
def test_trees(text, want):
    assert dom.parse(text) == want


@pytest.mark.parametrize("text", ["<div>" * 50_000, "{{a|" * 50_000 + "}}" * 50_000, "<p>" * 50_000, "[[" * 60_000, "<li>x" * 30_000, "{|\n| a\n" * 20_000 + "x", "<b>" * 50_000, "- a\n" * 40_000], ids=lambda t: t[:6])
def test_trees_of_hostile_pages(text):
    began = time.time()
    nodes = dom.parse(text)
    assert time.time() - began < 8 and all(0 <= d <= dom.MOST_DEPTH for d, _, _ in nodes)
    assert all(b - a <= 1 for (a, _, _), (b, _, _) in zip(nodes, nodes[1:]))


def test_wrapper_induction(spark):
    rows = [(i, "h" if i < 6 else None, f"<h1>Site</h1><p>story {i} is new</p><p>own {i}</p><ul><li>Home</li><li>About</li></ul>") for i in range(9)]
    rows += [(20, "h", None), (21, "h", ""), (None, "h", "<p>x</p>"), (0, "h", rows[0][2]), (22, "h", "plain text of its own")]
    got = {r.k: r for r in wrapper.induce_wrappers(spark.createDataFrame(rows, "k int, host string, t string"), "k", "host", "t").collect()}
    assert set(got) == {*range(9), 20, 21, 22}
    assert all(got[i].content == f"story {i} is new\n\nown {i}" and got[i].n_template == 3 for i in range(9))
    assert got[7].host is None and got[20].content == "" and got[22].content == "plain text of its own"
    empty = spark.createDataFrame([], "k int, host string, t string")
    assert wrapper.induce_wrappers(empty, "k", "host", "t").count() == 0


def test_wrapper_induction_of_mixed_layouts(spark):
    texts = [f"a short page, number {i}" for i in range(12)]
    texts += [f"<h1>Site</h1><p>story {i}</p><p>All rights reserved</p>" for i in range(6)]
    texts += [f"<p>Menu</p><h2>part {i}</h2><table><tr><td>3</td><td>4</td></tr><tr><td>{i}</td></tr></table>" for i in range(4)]
    # trees of their own: parts that another layout has, and additions that only such pages share
    texts += [f"<h1>Site</h1><p>tale {i}</p>{'<p>more</p>' if i else ''}<h3>Ads</h3><p>All rights reserved</p>" + "<h4>end</h4>" * i for i in range(3)]
    df = spark.createDataFrame([(i, "h", t) for i, t in enumerate(texts)], "k int, host string, t string")
    got = {r.k: r for r in wrapper.induce_wrappers(df, "k", "host", "t").collect()}
    assert all((got[i].n_template, got[i].content) == (0, texts[i]) for i in range(12))
    assert all((got[i].n_template, got[i].content) == (2, f"story {i - 12}") for i in range(12, 18))
    assert all((got[i].n_template, got[i].content) == (3, f"## part {i - 18}\n\n| {i - 18} |") for i in range(18, 22))
    for i in range(22, 25):
        assert "Site" not in got[i].content and "All rights" not in got[i].content and f"tale {i - 22}" in got[i].content


def test_shared_blocks_of_wiki_pages_are_found_and_taken_out(spark):
    """Blocks planted in pages of three hosts, in varying layouts: each is template, all else is content."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=7))
    rows, truth = [], {}
    for i in range(240):
        host = i % 3
        body = [f"{word()} {word()} {word()}." for _ in range(r.randrange(1, 5))]
        box = [f"{{{{Infobox town\n| name = {word()}\n| country = Land {host}\n}}}}"] if r.random() < 0.5 else []
        foot = [f"[[Category:Towns of {host}]]"] if r.random() < 0.7 else []
        note = [f"This page is a note of host {host}."] if r.random() < 0.8 else []
        rows.append((i, host, "\n".join([*box, *note, *body, *foot])))
        truth[i] = (2 * len(box) + len(note) + len(foot), "\n\n".join([*([f"name: {box[0].split('= ')[1].split(chr(10))[0]}"] if box else []), *body]))
    df = spark.createDataFrame(rows, "k int, h int, t string")
    got = {x.k: (x.n_template, x.content) for x in wrapper.induce_wrappers(df, "k", "h", "t").collect()}
    assert sum(got[i] == truth[i] for i in truth) >= 0.97 * len(truth)


def test_template_of_large_pages_is_found(spark):
    """600 lines that three pages share, after more and more lines of their own."""
    shared = "".join(f"<p>Part {i % 7}</p>" for i in range(600))
    rows = [(k, "h", "".join(f"<p>own {k} {i}</p>" for i in range(60 * k + 1)) + shared + f"<p>end {k}</p>") for k in range(3)]
    got = {x.k: x for x in wrapper.induce_wrappers(spark.createDataFrame(rows, "k int, host string, t string"), "k", "host", "t").collect()}
    assert all(got[k].n_template == 600 and "Part" not in got[k].content for k in range(3))
    assert all(got[k].content.count("own") == 60 * k + 1 for k in range(3))
