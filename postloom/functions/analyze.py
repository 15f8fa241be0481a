"""Text analysis: lower case, accent folding, word split, stopwords, length guard, suffix stripping.

The native engine runs the steps as built-in expressions over the whole text: stopwords and over-long runs are blanked out and
suffixes are cut inside the text, so one regular expression call serves all words of a document, and only
then is the text split. Folding is NFKD without combining marks. As marks are dropped anyway, it can be
done per code point; the code points that fold to at most one character go through ``translate``. Rows with
a code point that expands (Hangul syllables, ligatures, fractions) take an Arrow branch instead.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from postloom.session import ship

# Stopwords, suffixes (tried in this order), letters that stay doubled, longest word, shortest stem.
STOPWORDS = "a an and are as at be but by for from has have in is it its of on or that the to was were will with".split()
SUFFIXES = "ational ization iveness fulness ousness ation ement ingly edly ing ies ers ed es er ly s".split()
KEEP_DOUBLE = "lsfz"
MAX_LENGTH = 30
MIN_STEM = 3

@lru_cache(maxsize=1)
def fold_tables() -> tuple[str, str, str, dict[str, str]]:
    """Characters that fold to one other, what they fold to, those that vanish, and those that expand."""
    source, target, gone, many = [], [], [], {}
    for n in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= n <= 0xDFFF:
            continue
        c = chr(n)
        folded = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if folded == c:
            continue
        if not folded:
            gone.append(c)
        elif len(folded) == 1:
            source.append(c)
            target.append(folded)
        else:
            many[c] = folded
    return "".join(source), "".join(target), "".join(gone), many


def _class(chars: list[str]) -> str:
    """A character class of the given characters, as ranges."""
    codes, parts = sorted(map(ord, chars)), []
    start = last = codes[0]
    for n in [*codes[1:], None]:
        if n is not None and n == last + 1:
            last = n
            continue
        parts.append(f"\\x{{{start:x}}}" if start == last else f"\\x{{{start:x}}}-\\x{{{last:x}}}")
        start = last = n
    return "[" + "".join(parts) + "]"


@lru_cache(maxsize=1)
def expanding_class() -> str:
    return _class(list(fold_tables()[3]))


def folded(col: Column) -> Column:
    """Lower case without accents, for texts without expanding characters."""
    source, target, gone, _ = fold_tables()
    return F.when(_beyond_ascii(col), F.translate(F.lower(col), source + gone, target)).otherwise(F.lower(col))


def _beyond_ascii(col: Column) -> Column:
    # more bytes than characters
    return F.octet_length(col) > F.length(col)


def _expands(col: Column) -> Column:
    return _beyond_ascii(col) & F.regexp_like(F.lower(col), F.lit(expanding_class()))


def _terms(text: Column, w: str) -> Column:
    """The terms of a folded text; ``w`` is the class of word characters, as a class without its brackets."""
    before, after, w1 = f"(?<![{w}])", f"(?![{w}])", f"[{w}]"
    # looking back for the shortest stem, the leftmost suffix that ends a word is the longest possible one
    stem = f"(?<={w1}{{{MIN_STEM}}})(?:{'|'.join(SUFFIXES)}){after}"
    double = f"(?<={w1}{{{MIN_STEM - 1}}})([{w}&&[^{KEEP_DOUBLE}]])\\1{after}"
    silent = f"(?<={w1}{{{MIN_STEM}}})e{after}"
    t = F.regexp_replace(text, f"{w1}{{{MAX_LENGTH + 1},}}", " ")
    t = F.regexp_replace(t, f"{before}(?:{'|'.join(STOPWORDS)}){after}", " ")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, stem, ""), double, "$1"), silent, "")
    return F.regexp_extract_all(t, F.lit(f"{w1}+"), F.lit(0))


def native_terms(col: Column) -> Column:
    """The terms of a text that holds no expanding character, by built-in expressions alone."""
    text = F.coalesce(col, F.lit(""))
    return F.when(_beyond_ascii(text), _terms(folded(text), r"\p{L}\p{N}_")).otherwise(_terms(F.lower(text), "a-z0-9_"))


@lru_cache(maxsize=1 << 16)
def _term(word: str) -> str | None:
    """The term of a folded word; none for a stopword or an over-long one."""
    if len(word) > MAX_LENGTH or word in STOPWORDS:
        return None
    cut = next((n for n in map(len, (s for s in SUFFIXES if word.endswith(s))) if len(word) - n >= MIN_STEM), 0)
    word = word[: len(word) - cut]
    if len(word) > MIN_STEM and word[-1] == word[-2] and word[-1] not in KEEP_DOUBLE:
        word = word[:-1]
    return word[:-1] if len(word) > MIN_STEM and word[-1] == "e" else word


def without_marks(text: str) -> str:
    """A text without its combining marks; each of the few that it has is taken out in one go."""
    for c in set(text):
        if unicodedata.combining(c):
            text = text.replace(c, "")
    return text


def analyze_text(text: str | None) -> list[str]:
    """The analysis of one text in Python."""
    if not text:
        return []
    plain = text.lower()
    if not plain.isascii():
        plain = without_marks(unicodedata.normalize("NFKD", plain))
    return [t for t in map(_term, re.findall(r"\w+", plain)) if t is not None]


@F.pandas_udf(ArrayType(StringType()))
def _terms_in_python(texts: pd.Series) -> pd.Series:
    return texts.map(analyze_text)


# else a filter on the size of the result, which Spark infers below an explode, would run it twice
_terms_in_python = _terms_in_python.asNondeterministic()


def with_terms(df: DataFrame, text: str = "text", out: str = "terms", engine: str = "arrow") -> DataFrame:
    """``df`` with the array of its text's terms, in order and with repeats; empty for a null text.

    ``arrow`` analyses batches in Python, ``native`` uses built-in expressions and leaves only the texts
    with expanding characters to Python, in a second pass over the input. Both give the same terms, and warm
    take about the same time.
    """
    ship(df.sparkSession)
    if engine == "arrow":
        return df.withColumn(out, _terms_in_python(F.col(text)))
    if engine != "native":
        raise ValueError("engine is arrow or native")
    expands = _expands(F.coalesce(F.col(text), F.lit("")))
    native = df.filter(~expands).withColumn(out, native_terms(F.col(text)))
    return native.unionByName(df.filter(expands).withColumn(out, _terms_in_python(F.col(text))))


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text, with ``length`` (terms of the text) and ``counts`` (term and tf, one per term).

    A document is counted where it is read, so building postings shuffles nothing.
    """
    kept = [f for f in df.schema if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                counts = [Counter(analyze_text(t)) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                ends = pa.array(list(accumulate(map(len, counts), initial=0)), pa.int32())
                terms = pa.array([t for c in counts for t in c], pa.string())
                tfs = pa.array([n for c in counts for n in c.values()], pa.int32())
                pairs = pa.StructArray.from_arrays([terms, tfs], ["term", "tf"])
                length = pa.array([sum(c.values()) for c in counts], pa.int32())
                old = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*old, length, pa.ListArray.from_arrays(ends, pairs)], [*(f.name for f in kept), "length", "counts"])

    added = [StructField("length", IntegerType()), StructField("counts", ArrayType(StructType([StructField("term", StringType()), StructField("tf", IntegerType())])))]
    return df.mapInArrow(run, StructType([*kept, *added]))


def cache_key(query: Column, k: Column) -> Column:
    """The key under which results are remembered: lower case, single blanks, and the number of results."""
    blank = r"[\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    return F.concat_ws("|", F.trim(F.regexp_replace(F.lower(query), blank, " ")), k.cast("string"))
