"""Evaluation texts inside training text: spaced seeds find, overlaps around the hits are verified.

A seed is a window of words hashed under a fixed mask that ignores some positions, so a word replaced at
an ignored position does not hide a passage. The seeds of the test items are a table; those of the documents are
filtered by a Bloom filter of bounded size where the documents are read, in one pass whatever the number of items,
and what passes is joined with the table. Each hit names diagonals of document against item; along them the words
are compared, which gives the longest run of equal words and the best stretch that tolerates replaced words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.segments import PIECE, WORD_FLAG, Tables, codes_of
from postloom.operators.skew import lookup_join
from postloom.session import spread, write_stage

WORDS = 12  # consecutive words that make a leak
FILTER_BITS = 29  # log of the bits of the filter at most, 64 MB
_OUTER = 1 << 22  # pairs of positions from which diagonals are listed one by one
# Fixed masks for windows of 12 words: 1 counts, 0 is ignored. Every two of the inner positions are ignored by one of them.
MASKS_12 = ("110100110111", "111011001011", "101011010101", "101110100011", "110001101101", "100101011011", "111010011001")
_WORD = re.compile(r"[^\W_]+")
_MISS = -2  # what a replaced word costs a stretch; an equal one gives 1


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return [w.lower() for w in _WORD.findall(text)] if text else []


def masks(span: int) -> list[np.ndarray]:
    """The positions that count in windows of ``span`` words; the first and the last always do."""
    if span == 12:
        return [np.flatnonzero([c == "1" for c in m]) for m in MASKS_12]
    if span < 4:
        return [np.arange(span)]
    inner = np.arange(span)
    found = [inner[(inner % 3 != r) | (inner == 0) | (inner == span - 1)] for r in (1, 2, 0)]
    return [m for m in found if len(m) < span]


def windows(span: int) -> list[tuple[int, np.ndarray]]:
    """(width, mask) of the seeds that find ``span`` words with two of them replaced if span is 12, with one if it is at least 4.

    A replaced word at an end leaves a window shorter by one: for 12 words one that tolerates another
    replaced word, for fewer words an exact one. Below 4 words nothing is tolerated.
    """
    own = [(span, m) for m in masks(span)]
    if span < 4:
        return own
    return own + (windows(span - 1) if span == 12 else [(span - 1, np.arange(span - 1))])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


_ODD = 0xD6E8FEB86659FD93
_POWERS = [pow(_ODD, k, 1 << 64) for k in range(64)]
_INVERSE = pow(_ODD, -1, 1 << 64)


class Windows:
    """The seeds of all windows of some hashed words, from running sums.

    A seed is the sum of the words that count, each times a power of an odd number by its place, then mixed. A whole window is
    the difference of two running sums; what a mask ignores is taken off.
    """

    def __init__(self, h: np.ndarray):
        self.h = h
        n = len(h)
        with np.errstate(over="ignore"):
            self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE, np.uint64)]), dtype=np.uint64)
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), _ODD, np.uint64)]), dtype=np.uint64)[:n]
            self.total = np.concatenate([[np.uint64(0)], np.cumsum(h * up, dtype=np.uint64)])
        self.scaled: dict[int, np.ndarray] = {}
        self.whole: dict[int, np.ndarray] = {}

    def seeds(self, mask: np.ndarray, width: int, salt: int) -> np.ndarray:
        """The hash of every window of ``width`` words under a mask."""
        n = len(self.h) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        if width not in self.whole:
            self.whole[width] = (self.total[width:] - self.total[:-width]) * self.inverse[:n]
        out = self.whole[width] + np.uint64((salt + 1) * 0xA0761D6478BD642F % (1 << 64))
        for k in sorted(set(range(width)) - set(mask.tolist())):
            if k not in self.scaled:
                self.scaled[k] = self.h * np.uint64(_POWERS[k])
            out -= self.scaled[k][k : k + n]
        return _mix(out)


def seeds(h: np.ndarray, mask: np.ndarray, width: int, salt: int) -> np.ndarray:
    return Windows(h).seeds(mask, width, salt)


def hashed(texts: Sequence[str | None]) -> list[np.ndarray]:
    """The hashes of the words of each text, in order; both small sigmas are one letter."""
    tables = _shared_tables()
    codes, begin = codes_of([t or "" for t in texts])
    found, places, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(codes):  # pieces that end between words
        to = at + PIECE
        while to < len(codes):
            ends = np.flatnonzero((tables.read(codes[to : to + 4096]) & WORD_FLAG) == 0)
            to += int(ends[0]) if len(ends) else 4096
            if len(ends):
                break
        part = codes[at:to]
        word = (tables.read(part) & WORD_FLAG) != 0
        edge = np.diff(word.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        low = tables.lower[part]
        low[low == ord("ς")] = ord("σ")
        found.append(_mix(tables.word_hashes(low, starts, ends)))
        places.append(starts + at)
        at = to
    cuts = np.searchsorted(np.concatenate(places), begin[1:])
    return np.split(np.concatenate(found), cuts) if len(texts) else []


_tables: list[Tables] = []


def _shared_tables() -> Tables:
    if not _tables:
        _tables.append(Tables())
    return _tables[0]


def all_seeds(h: np.ndarray, span: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the window, seeds) of the hashed words of a text, for items of that span."""
    own = Windows(h)
    for m, (width, mask) in enumerate(windows(span)):
        yield m, own.seeds(mask, width, (span << 6) + m)


def grouped(s: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(seed, its positions) of the seeds of one text and window, each seed once."""
    order = np.argsort(s, kind="stable")
    cuts = np.flatnonzero(np.diff(s[order])) + 1
    for part in np.split(order, cuts) if len(s) else ():
        yield int(s[part[0]].astype(np.int64)), part.astype(np.int32)


class Bloom:
    """A filter of 2^bits bits with two probes per seed, behind a small one that stays in the processor's cache."""

    def __init__(self, bits: int, words: np.ndarray, seeds: int):
        self.bits, self.words = bits, words
        # the small filter is the large one folded: its bit is set if any of those that share its leading bits is
        self.few = max(0, min(bits - 6, int(seeds).bit_length() + 4))
        self.small = words.reshape(1 << self.few, -1).any(axis=1)

    @staticmethod
    def size(n: int) -> int:
        """1024 bits per seed, as far as ``FILTER_BITS`` allows; fewer only let more pass to the join."""
        return min(FILTER_BITS, max(10, int(n).bit_length() + 10))

    def _bit(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)

    def passing(self, s: np.ndarray) -> np.ndarray:
        """The positions of the seeds that may be in the filter."""
        got = np.flatnonzero(self.small[s >> np.uint64(64 - self.few)]) if self.few else np.arange(len(s))
        got = got[self._bit(s[got] >> np.uint64(64 - self.bits)) != 0]
        return got[self._bit(s[got] & np.uint64((1 << self.bits) - 1)) != 0]


def diagonals(pairs: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The distinct differences of the positions of equal seeds; all in between where there are very many pairs."""
    out = []
    for a, b in pairs:
        if len(a) * len(b) <= _OUTER:
            out.append(np.unique(a[:, None].astype(np.int64) - b[None, :]))
        else:
            out.append(np.arange(int(a.min()) - int(b.max()), int(a.max()) - int(b.min()) + 1))
    return np.unique(np.concatenate(out))


def search(texts: Sequence[str | None], items: Sequence[tuple[int, str]], least: int = WORDS) -> list[tuple[int, int, int, int, int]]:
    """(text number, item, longest equal run, words of the best stretch, replaced words in it), without tables."""
    docs, own = hashed(texts), dict(zip([i for i, _ in items], hashed([t for _, t in items]), strict=True))
    out = []
    for i, item in own.items():
        span = min(least, len(item))
        sown = {(m, s): p for m, x in all_seeds(item, span) for s, p in grouped(x)} if span else {}
        for d, doc in enumerate(docs):
            met = [(p, sown[m, s]) for m, x in (all_seeds(doc, span) if span else ()) for s, p in grouped(x) if (m, s) in sown]
            if met:
                out.append((d, i, *verified(doc, item, diagonals(met))))
    return out


def overlap(a: np.ndarray, b: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """Along ``a[i + diagonal] = b[i]``: longest run of equal words; words and replaced words of the best stretch."""
    lo, hi = max(0, -diagonal), min(len(b), len(a) - diagonal)
    same = a[lo + diagonal : hi + diagonal] == b[lo:hi]
    missed = np.flatnonzero(~same)
    if not len(missed):
        return hi - lo, hi - lo, 0
    # the runs of equal words between replaced ones; a stretch starts and ends with a run
    runs = np.diff(np.concatenate([[-1], missed, [hi - lo]])) - 1
    best, size, gaps, now, first = 0, 0, 0, 0, 0
    for k, r in enumerate(runs.tolist()):
        now += _MISS if k else 0
        if now <= 0 or not k:
            now, first = 0, k
        now += r
        if now > best:
            best, size, gaps = now, int(runs[first : k + 1].sum()) + k - first, k - first
    return int(runs.max()), size, gaps


def verified(doc: np.ndarray, item: np.ndarray, at: np.ndarray) -> tuple[int, int, int]:
    """Over some diagonals: the longest run of equal words, and words and replaced words of the best stretch."""
    run, best = 0, (0, 0, 0)
    for d in at.tolist():
        r, size, missed = overlap(doc, item, d)
        run, best = max(run, r), max(best, (size - missed, -missed, size))
        if r == len(item):  # nothing can be better
            break
    return run, best[2], -best[1]


def leaked(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = WORDS,
) -> DataFrame:
    """(doc_id, item_id, item_words, equal_run, stretch, replaced): documents that share a seed with an item.

    ``equal_run`` is the longest run of equal consecutive words, ``stretch`` the words of the best passage
    that tolerates replaced ones and ``replaced`` their number. What shares a seed for certain, by default: 12
    consecutive words of an item of which at most two are replaced, and the whole of an item of 4 to 11 words
    of which at most one is; items below 4 words are found unchanged only. With more words replaced a passage
    may or may not be found. Items below ``least`` words are searched as a whole. Ids that are null and texts that are null or without words give no row; rows repeated under
    one id are searched each, and the longest run comes out. Whole texts are searched. The documents are read
    once; only the filter is broadcast, whose size is bounded, and the combinations of window and mask.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    item_type = to_arrow_type(items.schema[item_id].dataType)

    def sow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                (h,) = hashed([b.column(1)[k].as_py()])
                if not len(h):
                    continue
                span, no = min(least, len(h)), b.column(2)[k].as_py()
                got = [(s, m, p) for m, x in all_seeds(h, span) for s, p in grouped(x)]
                n = len(got)
                first = [h.tobytes()] + [None] * (n - 1)  # the words go along once
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([no] * n, pa.int64()), pa.array([b.column(0)[k].as_py()] * n, item_type), pa.array([span] * n, pa.int32()),
                        pa.array([m for _, m, _ in got], pa.int32()), pa.array([s for s, _, _ in got], pa.int64()), pa.array([p for _, _, p in got], pa.list_(pa.int32())), pa.array(first, pa.binary()),
                    ],
                    ["no", "i", "span", "m", "s", "ipos", "words"],
                )

    own = items.select(items[item_id].alias("i"), items[item_text].alias("t")).filter("i is not null and t is not null").distinct()
    own = own.withColumn("no", F.xxhash64("i", "t"))
    sown = write_stage(spread(own).mapInArrow(sow, f"no long, i {kinds[1]}, span int, m int, s long, ipos array<int>, words binary"), "seeds")
    all_ = sown.agg(F.collect_set("span").alias("spans"), F.count(F.lit(1)).alias("n")).first()
    forms, n_seeds = sorted(all_["spans"]), all_["n"]  # at most ``least`` spans
    bits = Bloom.size(n_seeds)
    probes = F.array(F.call_function("shiftrightunsigned", F.col("s"), F.lit(64 - bits)), F.col("s").bitwiseAND(F.lit((1 << bits) - 1)))
    set_ = sown.select(F.explode(probes).alias("at")).select(F.shiftright("at", 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int")).alias("b"))
    filled = set_.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most 2^(FILTER_BITS - 6) rows
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[filled["w"].to_numpy(np.int64)] = filled["b"].to_numpy(np.int64).view(np.uint64)
    known = spark.sparkContext.broadcast(Bloom(bits, table, n_seeds))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = known.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = hashed(part.column(1).to_pylist())
                ends = np.cumsum([len(h) + 1 for h in texts])
                # the texts in one array, set apart by numbers that no word has at that place
                apart = _mix(np.arange(1, len(texts) + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
                flat = np.concatenate([x for h, a in zip(texts, apart, strict=True) for x in (h, np.full(1, a, np.uint64))])
                found: dict[int, list[tuple[int, np.ndarray]]] = {}
                every = Windows(flat)
                for span in forms:
                    for m, (width, mask) in enumerate(windows(span)):
                        s = every.seeds(mask, width, (span << 6) + m)
                        hit = seen.passing(s)
                        doc = np.searchsorted(ends, hit, "right")
                        inside = hit + width < ends[np.minimum(doc, len(ends) - 1)]  # a window that reaches into the next text is none
                        hit, doc = hit[inside], doc[inside]
                        for d in np.unique(doc).tolist():
                            where = hit[doc == d]
                            start = ends[d] - len(texts[d]) - 1
                            found.setdefault(d, []).extend((x, where[p] - start) for x, p in grouped(s[where]))
                if found:
                    rows = sorted(found)
                    ids = part.column(0).take(pa.array(rows))
                    uid = [int.from_bytes(hashlib.blake2b(repr(i.as_py()).encode() + texts[d].tobytes(), digest_size=8).digest(), signed=True) for i, d in zip(ids, rows, strict=True)]
                    hits = [[{"s": x, "pos": p} for x, p in found[d]] for d in rows]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(uid, pa.int64()), ids, pa.array([texts[d].tobytes() for d in rows], pa.binary()), pa.array(hits, pa.list_(pa.struct([("s", pa.int64()), ("pos", pa.list_(pa.int32()))])))],
                        ["uid", "d", "words", "hits"],
                    )

    rows = spread(docs.select(docs[doc_id].alias("d"), docs[text].alias("t")).filter("d is not null and t is not null"))
    met = write_stage(rows.mapInArrow(scan, f"uid long, d {kinds[0]}, words binary, hits array<struct<s:long,pos:array<int>>>"), "met")
    hits = met.select("uid", F.explode("hits").alias("x")).select("uid", "x.s", "x.pos").dropDuplicates(["uid", "s"])
    n_hits = met.agg(F.sum(F.size("hits"))).first()[0] or 0
    joined = lookup_join(hits, sown.select("s", "no", "ipos"), ["s"], None, 100_000, rows=n_hits).filter("no is not null")
    # the diagonals that equal seeds name; all in between where there are very many pairs of positions
    listed = F.array_distinct(F.flatten(F.transform("pos", lambda p: F.transform("ipos", lambda q: p - q))))
    spanned = F.sequence(F.array_min("pos") - F.array_max("ipos"), F.array_max("pos") - F.array_min("ipos"))
    few = F.size("pos").cast("long") * F.size("ipos") <= _OUTER
    pairs = joined.select("uid", "no", F.when(few, listed).otherwise(spanned).alias("at"))
    pairs = write_stage(pairs.groupBy("uid", "no").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at")), "pairs")
    known_items = sown.filter("words is not null").select("no", "i", F.col("words").alias("iw"))
    both = lookup_join(pairs, known_items, ["no"], None, 100_000)
    # last, so that the words of a document move once, whatever the number of its items
    both = both.join(met.select("uid", "d", F.col("words").alias("dw")).dropDuplicates(["uid"]), "uid")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for dw, iw, at in zip(*(b.column(c) for c in ("dw", "iw", "at")), strict=True):
                doc, item = (np.frombuffer(x.as_buffer(), np.uint64) for x in (dw, iw))
                got.append((len(item), *verified(doc, item, at.values.to_numpy())))
            if got:
                yield pa.RecordBatch.from_arrays([b.column("d"), b.column("i"), *(pa.array(x, pa.int64()) for x in zip(*got, strict=True))], ["d", "i", "n", "run", "size", "missed"])

    out = both.select("d", "i", "dw", "iw", "at").mapInArrow(verify, f"d {kinds[0]}, i {kinds[1]}, n long, run long, size long, missed long")
    best = out.groupBy("d", "i").agg(F.max(F.struct("run", "size", (-F.col("missed")).alias("missed"), "n")).alias("x"))
    return best.select(
        F.col("d").alias(doc_id), F.col("i").alias(item_id), F.col("x.n").alias("item_words"), F.col("x.run").alias("equal_run"),
        F.col("x.size").alias("stretch"), (-F.col("x.missed")).alias("replaced"),
    )


def exact_leaks(found: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", least: int = WORDS) -> DataFrame:
    """(doc_id, item_id) where the run of equal words reaches ``least``, or the whole of a shorter item."""
    return found.filter(F.col("equal_run") >= F.least(F.lit(least), "item_words")).select(doc_id, item_id)
