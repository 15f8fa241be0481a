"""Segments of texts and their statistics, taken over all characters of a batch at once.

A segment is a sentence of a line, or the whole line where no sentence ends in it. The texts of a batch are
one array of code points; what a character is comes from tables, words are runs of letters and digits known
by a hash of their lower case, and counts are differences of running sums. No step runs per segment.
"""

from __future__ import annotations

import numpy as np

# Common function words of some languages.
COMMON_WORDS = frozenset(
    """the of and to a in is that it for was on are as with be at by from this not but or an which had has have were they its it their
    so than then when if what who only each every can will would there here no
    der die das und ist nicht ein eine einen dem den des im zu von mit für auf sind wurde es sich hier wie als auch nach noch ihre hat
    le la les de du un une et est que qui dans pour sur par pas ne ce cette il elle on se sont avec au aux où sa ses son
    el los las y en del al una con para no más su sus lo como fue se cada
    и в во на не что с по это как из от к для был была где там эта этот она всей около здесь
    το της την τη των του η ο οι και είναι στη στην στο με για μια ένα δεν που έχει κάθε
    في من على إلى أن هذا هذه التي الذي عن مع كان لا ما قرب حوالي عام بين بعد قبل كل""".split()
)
FEATURES = ("common", "word_length", "symbols", "digits", "ended", "log_words", "separators", "repeated", "broken", "capitals", "around")
N = len(FEATURES)
REACH = 2  # neighbours on either side
PIECE = 1 << 20  # characters whose statistics are taken at once, but for a longer segment

_ALPHA, _DIGIT, _SPACE, _WORD, _UPPER, _END, _CLOSER, _SEP, _DASH, _KANA, _PARTICLE, _HANGUL, _BROKEN, _LEAD, _TAIL, _DECIMAL, _CJK_END, _CJK_CLOSER, _MARK, _KOREAN = (
    1 << i for i in range(20)
)
WORD_FLAG = _WORD
_UNKNOWN = np.uint32(1 << 31)
# Characters of each kind beside what Unicode says of them.
_SETS = {
    _END: ".!?…", _MARK: ".!?…。！？؟।", _CLOSER: "\"'”’»)", _CJK_END: "。！？", _CJK_CLOSER: "」』", _SEP: ",;:|/·•=\t{}<>", _DASH: "-–",
    _PARTICLE: "のはにをがでともへ", _KOREAN: "은는이가을를에의다로과와", _LEAD: "ÃÂÐÑ", _TAIL: "€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œ",
}
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_REPEAT = 8  # words back in which a word counts as said again


def _flags(n: int) -> tuple[int, int]:
    c = chr(n)
    f = sum(bit for bit, chars in _SETS.items() if c in chars)
    f |= _ALPHA * c.isalpha() | _DIGIT * c.isdigit() | _SPACE * c.isspace() | _WORD * c.isalnum() | _UPPER * c.isupper() | _DECIMAL * c.isdecimal()
    f |= _KANA * (0x3040 <= n <= 0x30FF or 0x4E00 <= n <= 0x9FFF) | _HANGUL * (0xAC00 <= n <= 0xD7A3) | _TAIL * (0x80 <= n <= 0xBF)
    f |= _BROKEN * (n == 0xFFFD or 0x7F <= n <= 0x84 or 0x86 <= n <= 0x9F)
    low = c.lower()
    return f, ord(low) if len(low) == 1 else n


class Tables:
    """What is known of code points; filled as they occur."""

    def __init__(self) -> None:
        self.flags = np.full(0x110000, _UNKNOWN, np.uint32)
        self.lower = np.zeros(0x110000, np.uint32)
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.common = np.zeros(0, np.uint64)
        self.common = np.sort(np.array([self._hash(w) for w in COMMON_WORDS], np.uint64))

    def _hash(self, word: str) -> int:
        return sum(ord(c) * pow(int(_BASE), i, 1 << 64) for i, c in enumerate(word)) % (1 << 64)

    def read(self, codes: np.ndarray) -> np.ndarray:
        f = self.flags[codes]
        if (f == _UNKNOWN).any():
            for n in np.unique(codes[f == _UNKNOWN]).tolist():
                self.flags[n], self.lower[n] = _flags(n)
            f = self.flags[codes]
        return f

    def up_to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers) < n:
            size = max(n, PIECE)
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
                self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE)]), dtype=np.uint64)
        return self.powers, self.inverses

    def word_hashes(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each word of some lower case code points."""
        powers, inverses = self.up_to(len(low) + 1)
        total = np.zeros(len(low) + 1, np.uint64)
        np.cumsum(low * powers[: len(low)], out=total[1:])
        return (total[ends] - total[starts]) * inverses[starts]


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of some texts, a line break after each, and where each text starts."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32) if texts else np.zeros(0, np.uint32)
    return flat, np.cumsum(lens + 1) - (lens + 1)


def cut(codes: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every segment, blanks around it left out; none is blank.

    A sentence ends at a mark, closing quotes aside, before white space, unless the mark ends a number that
    starts the line, or at an ideographic mark.
    """
    n = len(codes)
    space = (flags & _SPACE) != 0
    lines = np.flatnonzero(codes == 10)
    gaps = np.flatnonzero(space[1:] & ~space[:-1]) + 1 if n else lines
    gaps = gaps[codes[gaps] != 10]
    if ((flags & _CLOSER) != 0).any():
        before = np.maximum.accumulate(np.where((flags & _CLOSER) == 0, np.arange(n), 0))[gaps - 1]
    else:
        before = gaps - 1
    own = (flags[before] & _END) != 0
    gaps, before = gaps[own], before[own]
    number, first = codes[before] == ord("."), before
    numbered = np.zeros(len(before), bool)
    for _ in range(3):  # at most three digits
        first = first - 1
        number = number & (first >= 0) & ((flags[np.maximum(first, 0)] & _DECIMAL) != 0)
        numbered |= number & ((first == 0) | (codes[np.maximum(first - 1, 0)] == 10))
    gaps, before = gaps[~numbered], before[~numbered]
    wide = np.flatnonzero(((flags[:-1] & _CJK_END) != 0) & ((flags[1:] & _CJK_CLOSER) == 0)) + 1 if n else lines
    ends = np.concatenate([lines, before + 1, wide, [n]])
    starts = np.concatenate([lines + 1, gaps, wide, [0]])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.sort(ends)
    shown = np.flatnonzero(~space)
    a, b = np.searchsorted(shown, starts), np.searchsorted(shown, ends) - 1
    kept = a <= b
    return shown[a[kept]], shown[b[kept]] + 1


def _counts(mark: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mark) + 1, np.int64)
    np.cumsum(mark, out=total[1:])
    return total[ends] - total[starts]


def measures(codes: np.ndarray, flags: np.ndarray, starts: np.ndarray, ends: np.ndarray, tables: Tables) -> np.ndarray:
    """The statistics of segments by themselves; the number of words is not bounded yet."""
    n = len(starts)
    has = lambda bit: (flags & bit) != 0
    space, word, alpha = has(_SPACE), has(_WORD), has(_ALPHA)
    letters, digits = _counts(alpha, starts, ends), _counts(has(_DIGIT), starts, ends)
    shown = np.maximum(1, ends - starts - _counts(space, starts, ends))
    # words
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    ts, te = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inside = np.searchsorted(starts, ts, "right") - 1
    own = (inside >= 0) & (ts < ends[np.maximum(inside, 0)]) if n else np.zeros(len(ts), bool)
    ts, te, inside = ts[own], te[own], inside[own]
    every = np.bincount(inside, minlength=n)
    size = te - ts
    pure = _counts(alpha, ts, te) == size
    ts, te, inside, size = ts[pure], te[pure], inside[pure], size[pure]
    found = np.bincount(inside, minlength=n)
    hashed = tables.word_hashes(tables.lower[codes], ts, te)
    at = np.minimum(np.searchsorted(tables.common, hashed), len(tables.common) - 1)
    known = tables.common[at] == hashed
    if has(_HANGUL).any():
        last, prior = flags[te - 1], codes[np.maximum(te - 2, 0)]
        short = ((last & _KOREAN) != 0) & (size > 1)
        known = known.astype(np.int64) + ((_counts(has(_HANGUL), ts, te) == size) & (short | ((codes[te - 1] == ord("서")) & (prior == ord("에")) & (size > 2))))
    common = np.bincount(inside, weights=known, minlength=n)
    again = np.zeros(len(ts), bool)
    for d in range(1, _REPEAT + 1):
        again[d:] |= (hashed[d:] == hashed[:-d]) & (inside[d:] == inside[:-d])
    repeated = np.bincount(inside, weights=again, minlength=n)
    length = np.bincount(inside, weights=size, minlength=n) / np.maximum(1, found)
    capitals = np.bincount(inside, weights=(flags[ts] & _UPPER) != 0, minlength=n)
    words = np.maximum(1, every).astype(float)
    # scripts without blanks: about as many characters to a word as elsewhere
    kana = _counts(has(_KANA), starts, ends)
    unspaced = (2 * kana > letters) & (letters > 0)
    if unspaced.any():
        common = np.where(unspaced, _counts(has(_PARTICLE), starts, ends), common)
        length = np.where(unspaced, 4.5, length)
    amount = np.where(unspaced, kana / 2.2, words)
    # marks
    tab = codes == 9
    after, before = np.append(space[1:], False), np.append(False, space[:-1])
    gap = space & ~before & ~tab & after & ~np.append(tab[1:], False)
    dash = has(_DASH) & before & after
    dash[starts], dash[ends - 1] = False, False
    parts = has(_SEP) | gap | dash
    broken = np.zeros(n)
    lead = has(_LEAD) | (codes == ord("â"))
    odd = has(_BROKEN)
    if lead.any() or odd.any():
        pair = np.zeros(len(codes), bool)
        pair[:-1] = (has(_LEAD)[:-1] & has(_TAIL)[1:]) | ((codes[:-1] == ord("â")) & (codes[1:] == ord("€")))
        odd[1:] &= ~pair[:-1]
        broken = _counts(odd | pair, starts, ends)
    open_end = np.maximum.accumulate(np.where((flags & (_CLOSER | _CJK_CLOSER)) == 0, np.arange(len(codes)), 0))[ends - 1] if n else starts
    ended = (open_end >= starts) & ((flags[open_end] & _MARK) != 0)
    share = np.minimum(1.0, common / np.maximum(1.0, amount))
    return np.stack(
        [
            share, np.minimum(length, 20.0), np.sqrt(np.maximum(0, shown - letters - digits) / shown), np.sqrt(digits / shown), ended, np.log1p(amount),
            np.minimum(_counts(parts, starts, ends) / np.maximum(1.0, amount), 2.0), np.where(found > 0, repeated / words, 0.0),
            np.minimum(10.0 * broken / shown, 2.0), capitals / words, share,
        ],
        axis=1,
    ).astype(float)


def text_statistics(texts: list[str], tables: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, characters, statistics) of every segment of some texts, in order.

    The last statistic is taken over a segment and its neighbours in the text: their common words to their
    words. It sets a heading within prose apart from an item of a list.
    """
    codes, begin = codes_of(texts)
    flags = tables.read(codes)
    starts, ends = cut(codes, flags)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, N))
    rows, at = [], 0
    while at < len(starts):  # as many segments at a time as hold PIECE characters, at least one
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
        lo, hi = starts[at], ends[to - 1]
        rows.append(measures(codes[lo:hi], flags[lo:hi], starts[at:to] - lo, ends[at:to] - lo, tables))
        at = to
    f = np.concatenate(rows)
    owner = np.searchsorted(begin, starts, "right") - 1
    words = np.maximum(np.expm1(f[:, 5]), 1.0)
    first, last = np.searchsorted(owner, owner, "left"), np.searchsorted(owner, owner, "right")
    here = np.arange(len(f))
    lo, hi = np.maximum(here - REACH, first), np.minimum(here + REACH + 1, last)
    several = last - first > 1
    sums = [np.append(0.0, np.cumsum(x)) for x in (f[:, 0] * words, words)]
    f[:, -1] = np.where(several, np.maximum(0.0, sums[0][hi] - sums[0][lo]) / np.maximum(1.0, sums[1][hi] - sums[1][lo]), f[:, -1])
    f[:, 5] = np.minimum(f[:, 5], 4.0)
    return owner, ends - starts, f
