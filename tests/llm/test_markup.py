from __future__ import annotations

import time

import pytest

from postloom.llm import markup

KINDS = [
    ("<p>x</p>", ["html"]), ("a &amp; b", ["html"]), ("x <!-- c --> y", ["html"]), ("line<br>line", ["html"]), ("it is &eacute; so", ["html"]),
    ("# Title\n\ntext", ["markdown"]), ("Title\n-----\n\ntext", ["markdown"]), ("a **b** c", ["markdown"]), ("`x` y", ["markdown"]), ("```\ncode\n```", ["markdown"]),
    ("- one\n- two", ["markdown"]), ("1. one\n2. two", ["markdown"]), ("[a](http://x)", ["markdown"]), ("see [a][1]", ["markdown"]), ("~~gone~~", ["markdown"]),
    ("a <https://x.example/> b", ["markdown"]), ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]), ("> quoted text", ["markdown"]),
    ("[[link]] x", ["wiki"]), ("'''bold''' x", ["wiki"]), ("''it'' x", ["wiki"]), ("== Head ==\nx", ["wiki"]), ("{{stub|{{PAGENAME}}}}", ["wiki"]), ("a {{left b", ["wiki"]),
    ("{| class=x\n|-\n| a || b\n|}", ["wiki"]), ("[https://x.example/ here] y", ["wiki"]), ("__TOC__", ["wiki"]),
    ("\\section{A} x", ["latex"]), ("so $\\alpha_{1}$ is", ["latex"]), ("$$x^2 = y$$", ["latex"]), ("\\begin{verbatim}\n# no\n\\end{verbatim}", ["latex"]), ("caf\\'e", ["latex"]),
    ("5\\,\\% of it", ["latex"]), ("``is''\\footnote{see}", ["latex"]), (":<math>\\frac{a}{b}</math>", ["html", "latex"]), ("'''x'''<ref name=\"b\" />", ["html", "wiki"]),
    ("<SPAN style=\"x > 1\">y</SPAN> **z**", ["html", "markdown"]),
]
PLAIN = [
    None, "", "   ", "a < b and c > d", "I <3 you; R&D; AT&T", "It costs $5 in spring and $7 in autumn.", "Prices (in $): 4, 7 and 9 per [unit].", "4 * 3 * 2 is 24", "C:\\data\\new\\file",
    "The set {x, y} has two.", "Both C# and F# are.", "doc_id_old is kept [sic]", "a == b; a|b", "rose ^ as noted", "~7 rows, i.e.", "#1 & happy <3.", "/usr/a_b/c_d.txt", "Dial *99# or #9",
    "It's the dogs' 'own' bed", "9~5 o'clock", "He wrote \"yes\", then 'no'; 5 > 3 > 1.", "Set n := n + 1 until n >= 10 && done.",
]


@pytest.mark.parametrize("text,want", KINDS)
def test_kinds(text, want):
    assert markup.kinds(text) == want


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_has_no_markup_and_stays(text):
    assert markup.kinds(text) == [] and markup.clean(text) == text


def test_clean_keeps_structure():
    page = "<h2 id=s1>A &amp; B</h2><p>one<br>two <a href='x'>three</a></p><ul><li>x<li>y</li></ul><pre><code>if a &lt; b:\n    pass</code></pre><script>no()</script><table><tr><td>1</td><td>2</td></tr></table>"
    assert markup.clean(page) == "## A & B\n\none\n\ntwo three\n\n- x\n- y\n\n```\nif a < b:\n    pass\n```\n\n| 1 | 2 |"
    md = "# T\n\nsome **bold** and `code` [l](u)\n\n- a\n- [x] b\n\n```python\nx = '**no**'\n```\n\n$$a^2$$"
    assert markup.clean(md) == "# T\n\nsome bold and code l\n\n- a\n- b\n\n```\nx = '**no**'\n```\n\n$$a^2$$"
    wiki = "{{Infobox\n| a = {{b}}\n}}\n== H ==\n'''x''' of [[y (z)|y]] and [[w]]<ref>r</ref>.\n* i\n* j\n{| class=\"q\"\n! c !! d\n|-\n| 3 || 4\n|}\n[[Category:Q]]"
    assert markup.clean(wiki) == "## H\n\nx of y and w.\n\n- i\n- j\n\n| c | d |\n| 3 | 4 |"
    tex = "\\documentclass{article}\n\\begin{document}\n\\section{S}\nan \\emph{e} with ``q''\\footnote{f} 5\\,\\%~\\cite{k}.\n\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}\n\\[x^2\\]\nC:\\data\\new"
    assert markup.clean(tex) == "## S\n\nan e with “q” 5 %.\n\n- a\n- b\n\n$$x^2$$\n\nC:\\data\\new"


def test_long_text_and_odd_input():
    assert markup.kinds("word " * 100_000 + "**b**") == ["markdown"]
    assert markup.kinds("<" * 5000) == [] and markup.kinds("[" * 3000) == [] and markup.kinds("'" * 3000) == []
    assert markup.kinds("$" * 3000 + "{" * 3000) is not None and markup.clean("<p>" * 2000) == ""


def test_empty_table(spark):
    assert markup.markup_kinds(spark.createDataFrame([], "k int, host string, t string"), "k", "t").count() == 0


def test_long_formulas_and_deep_nesting():
    formula = "\\alpha_{1} + " * 40 + "x"
    assert markup.clean(f"so ${formula}$ is") == f"so ${formula}$ is" and markup.kinds(f"so ${'a + ' * 80}b = c$ is") == ["latex"]
    assert markup.clean("x " + "{{a|" * 12 + "b" + "}}" * 12 + " y") == "x y"
    assert markup.clean("x " + "[[File:a|" * 7 + "b" + "]]" * 7 + " y") == "x y"
    assert markup.clean("x " + "\\emph{" * 9 + "b" + "}" * 9 + " y") == "x b y"


SHARED = [
    ("* one\n* two", ["markdown"]), ("text\n* one\n* two", ["markdown"]), ("a\n\n----\n\nb", ["markdown"]), ("a\n\n***\n\nb", ["markdown"]), ("* * *", ["markdown"]),
    ("1) one\n2) two", ["markdown"]), ("[[x]]\n* one\n* two", ["wiki"]), ("[[x]]\n\n----\n\ny", ["wiki"]),
    # signs that only resemble them
    ("* see the note below", []), ("4 * 3\n5 * 2", []), ("a\n\n--\n\nb", []), ("He came - she\n--- left", []), ("(1) one (2) two", []), ("at 1) or 2) stop", []), ("*starred\n*again", []), ("1) only one", []),
]


@pytest.mark.parametrize("text,want", SHARED)
def test_lists_and_rules_that_two_notations_share(text, want):
    assert markup.kinds(text) == want


def test_shared_lists_come_out_clean():
    assert markup.clean("text\n* one\n* two") == "text\n\n- one\n- two" and markup.clean("1) one\n2) two") == "- one\n- two"
    assert markup.clean("Title\n=====\n\nx\n\n----\n\ny") == "# Title\n\nx\n\ny"


HOSTILE = [
    "x" * 1_000_000, "word " * 200_000, "*a " * 160_000, "''a " * 120_000, "'' a" * 120_000, "[[" * 200_000, "{{a " * 120_000, "<a " * 160_000, "$a " * 160_000, "\\[ x" * 120_000,
    "\\begin{align} " * 40_000, "`a " * 160_000, "<pre>" * 100_000, "_a " * 160_000, "==a " * 120_000, "- a\n" * 120_000, "{|\n" * 160_000, "x ~~~~ " * 70_000, "x~~~~ " * 80_000,
    '<a "' * 120_000, "<![CDATA[" * 50_000, "---\n" * 120_000, "[[a [[b]] " * 50_000, "[a](" * 120_000, ";a\n" * 160_000, "``a " * 120_000, "&a" * 240_000, "<!--" * 120_000, "a\n===" * 100_000,
]


@pytest.mark.parametrize("text", HOSTILE, ids=lambda t: t[:12])
def test_time_grows_with_the_length_only(text):
    began = time.time()
    markup.kinds(text)
    markup.clean(text)
    assert time.time() - began < 4


def test_emphasis_by_line():
    assert markup.kinds("''a\nb''") == [] and markup.kinds("''a'' b") == ["wiki"] and markup.kinds("the ''a and b'' c") == ["wiki"] and markup.kinds("so '' a ''") == []
    assert markup.clean("'''a''' and ''b c'' d") == "a and b c d"


def test_pieces_within_pieces_and_long_quotes():
    text = "<pre>a $$x$$ <math>y</math></pre> and \\(z_1\\)"
    assert "" not in markup.clean(text) and "y" in markup.clean(text)
    long = "word " * 100 + "end"
    assert markup.clean(f"``{long}''\\footnote{{x}}") == f"“{long}”"
