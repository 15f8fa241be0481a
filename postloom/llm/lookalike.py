"""Texts that look the same but differ in their characters: one consistent form, and the pairs it reveals.

``fold`` settles what needs no context: width and presentation forms, composed and separate accents,
invisible characters, the kinds of blanks and hyphens. Letters that several scripts share in shape are then
repaired token by token: the letters that only one script has tell the token's script (where a token has
none, those of the whole text do), and look-alikes from other scripts are replaced if the result is a word
of the corpus, that is, if it stands somewhere as it is or is what another spelling comes to as well.
Two texts that look alike agree in the letters that only one script has, so both take the same decisions.
The strict rule repairs less: only tokens that mix scripts, and only to words that stand in the corpus as they are.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators.skew import lookup_join
from postloom.session import spread, write_stage

# Letters of the same shape, Latin first, then Cyrillic, Greek, Armenian (a dot where there is none).
_SHAPES = """
a а . .
c с ϲ .
d ԁ . .
e е . .
g . . ց
h һ . հ
i і . .
j ј ϳ .
l ӏ . .
n . . ո
o о ο օ
p р . .
q ԛ . .
s ѕ . .
u . . ս
v ѵ . .
w ԝ . .
x х . .
y у . .
A А Α .
B В Β .
C С Ϲ .
E Е Ε .
G Ԍ . .
H Н Η .
I І Ι .
J Ј . .
K К Κ .
L . . Լ
M М Μ .
N . Ν .
O О Ο Օ
P Р Ρ .
Q Ԛ . .
S Ѕ . Տ
T Т Τ .
U . . Ս
V Ѵ . .
W Ԝ . .
X Х Χ .
Y Ү Υ .
Z . Ζ .
"""
_SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN")
_FORMS = {row[0]: {s: c for s, c in zip(_SCRIPTS, row.split(), strict=True) if c != "."} for row in _SHAPES.strip().splitlines()}
# further letters of those shapes
_SHAPE_OF = {c: latin for latin, row in _FORMS.items() for c in row.values()} | {"ɡ": "g", "Ӏ": "I"}

_INVISIBLE = re.compile(
    "[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff]"
)
_HYPHENS = re.compile("[\u2010\u2011\ufe63\uff0d]")
_BLANKS = re.compile("[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
_PLAIN = re.compile(r"[\x00-\x7f]*\Z")


@lru_cache(maxsize=1 << 16)
def _presented(c: str) -> str:
    """What a width or presentation form stands for; other compatibility characters look different and stay."""
    n = ord(c)
    kind = unicodedata.decomposition(c)
    shown = kind.startswith(("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>"))
    joined = 0xFB00 <= n <= 0xFB17 or 0x1C4 <= n <= 0x1CC or 0x1F1 <= n <= 0x1F3 or 0x2160 <= n <= 0x217F or 0x2E80 <= n <= 0x2FD5 or n in (0xB5, 0x132, 0x133)
    if kind.startswith("<") and (shown or joined):
        return "".join(_presented(chr(int(x, 16))) for x in kind.split()[1:])
    return c


def fold(text: str) -> str:
    """The text without the differences that need no context. Lines, tabs and the number of blanks stay."""
    if _PLAIN.match(text):
        return text
    text = _BLANKS.sub(" ", _HYPHENS.sub("-", _INVISIBLE.sub("", text)))
    return unicodedata.normalize("NFC", "".join(map(_presented, unicodedata.normalize("NFC", text))))


def _letter(c: str) -> bool:
    return unicodedata.category(c)[0] in "LM"


@lru_cache(maxsize=1 << 16)
def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0]


def tokens(folded: str) -> list[str]:
    """Maximal runs of letters and marks."""
    return re.findall(r"(?:[^\W\d_]|[\u0300-\u036f])+", folded)


def _own_letters(decomposed: str) -> Counter:
    """How many letters that no other script shares in shape each script has."""
    return Counter(s for c in decomposed if c not in _SHAPE_OF and (s := _script(c)) in _SCRIPTS)


def _dominant(own: Counter, otherwise: str) -> str:
    return max(_SCRIPTS, key=lambda s: own[s]) if any(own.values()) else otherwise


@lru_cache(maxsize=1 << 17)
def repaired(token: str, otherwise: str) -> str:
    """The token in the script of its own letters, or in ``otherwise`` if it has none of its own."""
    d = unicodedata.normalize("NFD", token)
    script = _dominant(_own_letters(d), otherwise)
    out = []
    for c in d:
        shape = _SHAPE_OF.get(c)
        out.append(c if shape is None else _FORMS[shape].get(script, shape))
    return unicodedata.normalize("NFC", "".join(out))


def mixed(token: str) -> bool:
    """Whether a token has letters of several scripts."""
    return len({s for c in unicodedata.normalize("NFD", token) if (s := _script(c)) in _SCRIPTS}) > 1


def suspects(folded: str, strict: bool = False) -> tuple[str, list[tuple[str, str]]]:
    """The script of a text, and its distinct tokens that repair would change, with the result."""
    if _PLAIN.match(folded):
        return "LATIN", []
    script = _dominant(_own_letters(unicodedata.normalize("NFD", folded)), "LATIN")
    pairs = ((t, repaired(t, script)) for t in dict.fromkeys(tokens(folded)))
    return script, [(t, r) for t, r in pairs if t != r and (not strict or mixed(t))]


def rewrite(folded: str, changes: dict[str, str]) -> str:
    """The text with the given tokens replaced."""
    return re.sub(r"(?:[^\W\d_]|[\u0300-\u036f])+", lambda m: changes.get(m.group(0), m.group(0)), folded) if changes else folded


def _sha(s: str) -> bytes:
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).digest()


_SLICE = 512  # texts that are lists in Python at once


def _first_pass(strict: bool):
    pair = pa.struct([("token", pa.string()), ("result", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                b = whole.slice(at, _SLICE)
                raw = b.column(2).to_pylist()
                forms = [fold(t) for t in raw]
                found = [[{"token": t, "result": r} for t, r in suspects(f, strict)[1]] for f in forms]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(map(_sha, raw), pa.binary()), pa.array(forms, pa.string()), pa.array(found, pa.list_(pair))],
                    ["field", "id", "raw", "form", "dirty"],
                )

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        seen: set[str] = set()
        for at in range(0, whole.num_rows, _SLICE):
            seen.update(t for f in whole.slice(at, _SLICE).column(0).to_pylist() for t in tokens(f))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], ["token"])


def _forms(entries: DataFrame, strict: bool) -> DataFrame:
    """(field, id, raw, form); a row delivered again comes out again."""
    kind = entries.schema["id"].dataType.simpleString()
    given = entries.select("field", "id", "text").filter("id is not null and text is not null and text <> ''")
    dirty_type = "array<struct<token:string,result:string>>"
    staged = write_stage(spread(given).mapInArrow(_first_pass(strict), f"field string, id {kind}, raw binary, form string, dirty {dirty_type}"), "folded")
    # a text counts once, however often it is repeated
    spots = write_stage(staged.filter(F.size("dirty") > 0).select("raw", F.explode("dirty").alias("x")).select("raw", "x.token", "x.result").distinct(), "spots")
    changes = write_stage(spots.groupBy("token", "result").agg(F.count(F.lit(1)).alias("uses")), "changes")
    # a result is a word if it stands in the corpus as it is, or if several spellings come to it
    results = changes.groupBy("result").agg(F.count(F.lit(1)).alias("spellings"))
    vocabulary = staged.select("form").mapInArrow(_words, "token string").distinct()
    words = results.join(vocabulary.select(F.col("token").alias("result"), F.lit(True).alias("stands")), "result", "left")
    words = words.filter(F.col("stands") if strict else F.col("stands") | (F.col("spellings") > 1)).select("result")
    accepted = write_stage(changes.join(words, "result").withColumn("word", F.lit(True)), "accepted")
    use = lookup_join(spots, accepted, ["token", "result"], "uses", 200_000).filter("word")
    use = write_stage(use.groupBy("raw").agg(F.collect_list(F.struct("token", "result")).alias("use")), "use")

    @F.pandas_udf("string")
    def rewritten(forms: pd.Series, used: pd.Series) -> pd.Series:
        return pd.Series([f if u is None else rewrite(f, {x["token"]: x["result"] for x in u}) for f, u in zip(forms, used, strict=True)])

    clean = staged.filter(F.size("dirty") == 0).select("field", "id", "raw", "form")
    dirty = lookup_join(staged.filter(F.size("dirty") > 0).select("field", "id", "raw", "form"), use, ["raw"], None, 10_000, rows=staged.count())
    return clean.unionByName(dirty.select("field", "id", "raw", rewritten("form", "use").alias("form")))


def normal_forms(entries: DataFrame, strict: bool = False) -> DataFrame:
    """(field, id, raw, form) from (field, id, text): the consistent form of each text, and a hash of the raw one.

    Rows whose id or text is null or whose text is empty give no row. A row delivered again comes out once;
    differing texts under one id come out each. The corpus vocabulary is that of all given entries. Whole
    texts are handled. An empty table gives an empty result; other columns are ignored.
    """
    return _forms(entries, strict).dropDuplicates(["field", "id", "raw"])


def same_looking_pairs(forms: DataFrame) -> DataFrame:
    """(field, id_a, id_b), id_a < id_b: entries of one field of equal form whose raw texts differ.

    The pairs are what is asked for; an empty table gives none. Only pairs of different spellings are formed, so copies
    of one spelling never meet each other. The rows of the more frequent spelling are joined with those of the
    less frequent one, spread over many tasks where there are many; no list of ids is made.
    """
    keyed = write_stage(forms.select("field", "id", "raw", F.unhex(F.sha2("form", 256)).alias("look")).distinct(), "looks")
    spell = write_stage(keyed.groupBy("field", "look", "raw").agg(F.count(F.lit(1)).alias("n")), "spellings")
    several = spell.groupBy("field", "look").agg(F.count(F.lit(1)).alias("spellings")).filter("spellings > 1").select("field", "look")
    spell = write_stage(spell.join(several, ["field", "look"]), "several")
    a, b = (spell.select("field", "look", F.col("raw").alias(f"raw_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    # of two spellings, a is the more frequent one
    order = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("raw_a") < F.col("raw_b")))
    couples = write_stage(a.join(b, ["field", "look"]).filter(order).select("field", "look", "raw_a", "n_a", "raw_b"), "couples")
    more = couples.withColumnRenamed("raw_a", "raw")
    many = lookup_join(keyed, more, ["field", "look", "raw"], "n_a", 100_000).filter("raw_b is not null").select("field", "look", "raw_b", F.col("id").alias("x"))
    few = keyed.join(couples.select("field", "look", F.col("raw_b").alias("raw")).distinct(), ["field", "look", "raw"])
    few = few.select("field", "look", F.col("raw").alias("raw_b"), F.col("id").alias("y"))
    got = lookup_join(write_stage(many, "many"), few, ["field", "look", "raw_b"], None, 20_000).select("field", "x", "y")
    return got.filter("x <> y").select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def pairs_of(entries: DataFrame, strict: bool = False) -> DataFrame:
    """(field, id_a, id_b) of entries that look alike, from (field, id, text)."""
    return same_looking_pairs(_forms(entries, strict))


def titles_and_texts(indexed_docs: DataFrame, articles: DataFrame) -> DataFrame:
    """(field, id, text) of the document titles and the article texts."""
    titles = indexed_docs.select(F.lit("title").alias("field"), F.col("doc_id").alias("id"), F.col("title").alias("text"))
    return titles.unionByName(articles.select(F.lit("text").alias("field"), F.col("page_id").alias("id"), "text"))
