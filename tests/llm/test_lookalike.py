from __future__ import annotations

import pytest

from postloom.llm import lookalike

SAME = [
    ("Ｆｕｌｌ　ｗｉｄｔｈ", "Full width"), ("cafe\u0301", "café"), ("zero\u200bwidth\ufeff", "zerowidth"), ("a\u00a0b\u2007c", "a b c"), ("non\u2011break", "non-break"), ("ﬁne", "fine"),
    ("ﾃﾞｰﾀ", "データ"), ("한국", "한국"), ("\u212a", "K"), ("so\u00adft", "soft"),
]


@pytest.mark.parametrize("a,b", SAME)
def test_fold(a, b):
    assert lookalike.fold(a) == lookalike.fold(b)


@pytest.mark.parametrize("a,b", [("A", "a"), ("e", "é"), ("x²", "x2"), ("a  b", "a b"), ("a\nb", "a b"), ("™", "TM"), ("ß", "ss"), ("…", "..."), ("½", "1/2")])
def test_fold_keeps_what_is_visible(a, b):
    assert lookalike.fold(a) != lookalike.fold(b)


def test_repair_follows_the_letters_of_one_script_only():
    assert lookalike.repaired("mοre", "LATIN") == "more"  # a Greek letter in a Latin word
    assert lookalike.repaired("Москвa", "LATIN") == "Москва"  # a Latin letter in a Cyrillic word
    assert lookalike.repaired("сор", "LATIN") == "cop" and lookalike.repaired("сор", "CYRILLIC") == "сор"
    assert lookalike.repaired("Γέφυρα", "LATIN") == "Γέφυρα"


TEXTS = [
    (1, "More of the cup"), (2, "Mоre оf the cup"), (3, "Mοre of the cup"), (4, "More of the cup"), (5, "More of the Cup"), (6, "Lonely wοrd"), (7, "Сор"), (8, "Cop"), (9, "соp а"),
    (10, "сoр a"), (11, None), (12, ""), (13, "\u200b"), (14, "ｄеad"), (15, "dеad"), (15, "dеad"), (16, "Москва река"), (17, "Мocква река"), (18, "Lοnely two"), (19, "Lоnely two"),
]


def test_pairs_are_complete_and_exact(spark):
    df = spark.createDataFrame([("f", i, t, 0) for i, t in TEXTS] + [("g", 1, "Mоre of the cup", 0)], "field string, id long, text string, raw int")
    got = {(r.field, r.id_a, r.id_b) for r in lookalike.same_looking_pairs(lookalike.normal_forms(df)).collect()}
    looks = [{1, 2, 3, 4}, {7, 8}, {9, 10}, {14, 15}, {16, 17}, {18, 19}]
    raw = dict(TEXTS)
    assert got == {("f", a, b) for s in looks for a in s for b in s if a < b and raw[a] != raw[b]}
    forms = {(r.field, r.id): r.form for r in lookalike.normal_forms(df).collect()}
    assert forms["f", 2] == "More of the cup" and forms["f", 17] == "Москва река" and forms["f", 6] == "Lonely wοrd"


def test_copies_of_one_spelling_do_not_meet(spark):
    rows = [("f", i, "copy of a title") for i in range(300)] + [("f", 1000 + i, "cоpy of a title") for i in range(2)]
    got = lookalike.same_looking_pairs(lookalike.normal_forms(spark.createDataFrame(rows, "field string, id long, text string")))
    assert got.count() == 600
    assert lookalike.same_looking_pairs(lookalike.normal_forms(spark.createDataFrame([], "field string, id long, text string"))).count() == 0


PAIRS = [(latin, c) for latin, row in lookalike._FORMS.items() for s, c in row.items() if s != "LATIN"] + [("g", "ɡ"), ("I", "Ӏ")]


@pytest.mark.parametrize("latin,other", PAIRS)
def test_every_shape_is_repaired_in_a_latin_word(latin, other):
    assert lookalike.repaired(f"z{other}mt", "LATIN") == f"z{latin}mt" and other != latin


@pytest.mark.parametrize("a,b", [("Ⅹ", "X"), ("ⅷ", "viii"), ("Ⅻ", "XII"), ("ⅼ", "l")])
def test_roman_numerals_are_their_letters(a, b):
    assert lookalike.fold(f"No {a}") == f"No {b}"


def test_the_strict_rule_repairs_mixed_tokens_to_standing_words_only(spark):
    df = spark.createDataFrame([("f", i, t) for i, t in TEXTS], "field string, id long, text string")
    got = {(r.id_a, r.id_b) for r in lookalike.pairs_of(df, strict=True).collect()}
    whole = {(r.id_a, r.id_b) for r in lookalike.pairs_of(df).collect()}
    assert got < whole and {(1, 3), (3, 4)} <= got and (7, 8) not in got and (9, 10) not in got


def test_large_groups_of_two_spellings(spark):
    """Both spellings are heavy: the pairs are all there, and rows delivered again add none."""
    rows = [("f", i, "cоpy" if i % 2 else "copy") for i in range(240)] * 2
    df = spark.createDataFrame(rows, "field string, id long, text string")
    assert lookalike.pairs_of(df).count() == 120 * 120
