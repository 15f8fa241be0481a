"""Text quality: statistics of documents and of their segments, and a Gaussian mixture that tells them apart.

Eleven statistics describe each segment. They are fitted by a Gaussian mixture with expectation-maximisation
over all segments of the corpus: each segment counts in a cell of a fixed grid, and the cells, with the number
of their segments, their means and their variances, stand for the segments in every step, until the fit has
converged. Judged documents tell which components hold prose, inspected examples tell lists, tables and junk
apart. Each segment is then classed by its own statistics, and a document is described by the shares of its
characters in the four classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.segments import COMMON_WORDS, FEATURES, N, Tables, text_statistics
from postloom.session import drop_stage, spread, write_stage

CLASSES = ("prose", "list", "table", "junk")
# Inspected examples of the classes that the judged documents do not tell apart.
EXAMPLES = {
    "list": ["Home", "1. Slow Temple", "2 Quarry", "- round market", "* Log in", "apples, pears, plums, figs, nuts, dates", "reef; tower; lagoon; mill; bridge; road", "north / south / east / west", "Contact"],
    "table": ["name | 3 | 17", "north;14;7;3", "river,57,-,233", "tower   12   n/a   5", "mill\t4\t9\t16", "1.2 Orchard .............. 4"],
    "junk": [
        "#!#!#!#!#!#!#!#!#!#!#!#!", "._.._.._.._.._.._.._.", "00000010  4c 72 c2 56 43 f1 b2 19", "{\"ab\":null,\"cd\":[5,3],\"ef\":2}", "dance dance dance dance dance dance dance dance",
        "2024-01-10 00:10:07 WARN [gate-0] took 3760ms status=503", "function f(a,b){var c=a[5]||{};return b?c.x:!1;}", "id=12 flag=false key=null", "Ã©tÃ© fermÃ© Ã cÃ´tÃ©", "xtq;wv,lkr zzj;qp fghw,sdl mnbv",
    ],
}

_COMMON_SHARE = 0.3  # share of common words that speaks for prose by itself
_PRIOR = 0.003  # what that weighs, as a share of all judged characters
# Width of the grid's cells in each statistic, and how many there are.
STEPS = dict(zip(FEATURES, (0.1, 1.0, 0.1, 0.1, 1.0, 0.4, 0.25, 0.2, 0.5, 0.2, 0.1), strict=True))
LEVELS = dict(zip(FEATURES, (11, 21, 11, 11, 2, 11, 9, 6, 5, 6, 11), strict=True))
ONE_TASK = 200_000  # cells, 40 MB, that are fitted in one task; more are fitted by a job a step
_tables: list[Tables] = []


def tables() -> Tables:
    """The tables of this process."""
    if not _tables:
        _tables.append(Tables())
    return _tables[0]


def features(segment: str) -> list[float]:
    """The statistics of one segment, in the order of FEATURES."""
    f = text_statistics([segment], tables())[2]
    return f[0].tolist() if len(f) else [0.0] * N


def cells(f: np.ndarray) -> np.ndarray:
    """The number of the grid's cell that each row of statistics falls into."""
    code = np.zeros(len(f), np.int64)
    for i, name in enumerate(FEATURES):
        code = code * LEVELS[name] + np.clip(np.floor(f[:, i] / STEPS[name] + 1e-6), 0, LEVELS[name] - 1).astype(np.int64)
    return code


def start_bin(f: np.ndarray) -> np.ndarray:
    """A coarse bin of each row of statistics; the largest bins are the first components."""
    code = np.digitize(f[:, 0], [0.08, 0.25]) * 2 + (f[:, 4] > 0)
    for at, cut in ((3, 0.3), (2, 0.35), (8, 0.2), (5, 2.5), (7, 0.5)):
        code = code * 2 + (f[:, at] > cut)
    return code.astype(np.int64)


def _products(s: np.ndarray) -> np.ndarray:
    return (s[:, :, None] * s[:, None, :]).reshape(len(s), -1)


@dataclass(frozen=True)
class Mixture:
    center: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    floor: float = 0.0
    rounds: int = 0

    def joint(self, f: np.ndarray, v: np.ndarray | None = None) -> np.ndarray:
        """Log of weight times density of each component, for rows of raw statistics.

        A row stands for values spread around it, with variances ``v`` and the floor; what counts is the
        mean of the log density over them. This makes the steps climb, floor included.
        """
        s = (f - self.center) / self.scale
        inverse = np.linalg.inv(self.cov)
        half = np.einsum("kij,kj->ki", inverse, self.mean)
        diagonal = np.einsum("kii->ki", inverse)
        constant = np.log(self.weight) - 0.5 * self.floor * diagonal.sum(1) - 0.5 * np.linalg.slogdet(self.cov)[1] - 0.5 * np.einsum("ki,ki->k", half, self.mean)
        got = constant + s @ half.T - 0.5 * (_products(s) @ inverse.reshape(len(self.weight), -1).T)
        return got if v is None else got - 0.5 * (v / self.scale**2) @ diagonal.T

    def posterior(self, f: np.ndarray, v: np.ndarray | None = None, n: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        """The memberships of rows, and their log likelihood, rows weighed by ``n``."""
        if not len(f):
            return np.zeros((0, len(self.weight))), 0.0
        j = self.joint(f, v)
        top = j.max(1, keepdims=True)
        e = np.exp(j - top)
        total = e.sum(1, keepdims=True)
        each = (top + np.log(total))[:, 0]
        return e / total, float(each.sum() if n is None else each @ n)


def sufficient(s: np.ndarray, r: np.ndarray, within: np.ndarray | None = None) -> np.ndarray:
    """Per component: mass, sums, sums of products of standardised statistics and of variances within the rows."""
    inner = np.zeros((r.shape[1], N)) if within is None else r.T @ within
    return np.concatenate([r.sum(0)[:, None], r.T @ s, r.T @ _products(s), inner], axis=1).ravel()


def maximise(flat: np.ndarray, k: int, center: np.ndarray, scale: np.ndarray, floor: float) -> Mixture:
    m = flat.reshape(k, 1 + 2 * N + N * N)
    n = m[:, 0] + 1e-9
    mean = m[:, 1 : 1 + N] / n[:, None]
    cov = m[:, 1 + N : 1 + N + N * N].reshape(k, N, N) / n[:, None, None] - np.einsum("ki,kj->kij", mean, mean)
    cov[:, np.arange(N), np.arange(N)] += m[:, 1 + N + N * N :] / n[:, None] + floor
    return Mixture(center, scale, n / n.sum(), mean, cov)


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    if not b.num_rows:
        return np.zeros((0, N))
    return np.stack([b.column(b.schema.get_field_index(f)).to_numpy(zero_copy_only=False) for f in FEATURES], axis=1).astype(float)


def _total(df: DataFrame, step, size: int) -> np.ndarray:
    """The sum over all batches of what ``step`` makes of them, summed per task, and in 16 groups if there are many."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            # a few thousand rows at a time keep the products small
            for at in range(0, b.num_rows, 4096):
                total += step(b.slice(at, 4096))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for row in b.column(0):
                total += row.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["x"])

    parts = df.mapInArrow(partial, "x array<double>")
    if df.rdd.getNumPartitions() > 64:  # else one array per partition is little for the driver
        parts = parts.repartition(16).mapInArrow(add, "x array<double>")
    return sum((np.asarray(r.x) for r in parts.collect()), np.zeros(size))


def segment_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chars, cell, statistics...): one row per segment of the texts that are not null or blank."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                owner, chars, f = text_statistics(part.column(1).to_pylist(), tables())
                if len(f):
                    m = f.astype(np.float32)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(owner)), pa.array(chars), pa.array(cells(f)), *(pa.array(m[:, i]) for i in range(N))], ["doc_id", "chars", "cell", *FEATURES]
                    )

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).filter("doc_id is not null and text is not null")
    return spread(rows).mapInArrow(run, f"doc_id {kind}, chars long, cell long, " + ", ".join(f"{f} float" for f in FEATURES))


def grid(stats: DataFrame) -> DataFrame:
    """(n, mean and variance of each statistic) of the segments of each cell that holds any."""
    exact = [F.col(f).cast("double") for f in FEATURES]
    per = stats.groupBy("cell").agg(
        F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(c).alias(f"s_{f}") for f, c in zip(FEATURES, exact, strict=True)),
        *(F.sum(c * c).alias(f"q_{f}") for f, c in zip(FEATURES, exact, strict=True)),
    )
    mean = [(F.col(f"s_{f}") / F.col("n")) for f in FEATURES]
    return per.select("cell", "n", *(m.alias(f) for f, m in zip(FEATURES, mean, strict=True)), *(
        F.greatest(F.lit(0.0), F.col(f"q_{f}") / F.col("n") - m * m).alias(f"v_{f}") for f, m in zip(FEATURES, mean, strict=True)
    ))


def _cells(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = b.column(b.schema.get_field_index("n")).to_numpy(zero_copy_only=False)
    v = np.stack([b.column(b.schema.get_field_index(f"v_{f}")).to_numpy(zero_copy_only=False) for f in FEATURES], axis=1) if b.num_rows else np.zeros((0, N))
    return n, _matrix(b), v


def em(total: Callable, components: int, tolerance: float, floor: float) -> Mixture | None:
    """Expectation-maximisation until a step adds less than ``tolerance`` to the mean log likelihood.

    ``total(step, size)`` sums what ``step`` makes of (weights, means, variances) of some cells over all of
    them. No step lowers that likelihood, and it is bounded, so the steps come to an end.
    """
    m = total(lambda n, f, v: np.concatenate([[n.sum()], n @ f, n @ (f**2 + v)]), 1 + 2 * N)
    n = m[0]
    if not n:
        return None
    center = m[1 : 1 + N] / n
    scale = np.sqrt(np.maximum(m[1 + N :] / n - center**2, 1e-6))
    bins = 3 * 2 * 2**5
    counts = total(lambda n, f, v: np.bincount(start_bin(f), weights=n, minlength=bins), bins)
    order = np.argsort(-counts, kind="stable")
    first = order[: min(components, int((counts > 0).sum()))]
    k = len(first)
    place = np.full(bins, -1)
    place[first] = np.arange(k)
    width = k * (1 + 2 * N + N * N)

    def begin(n: np.ndarray, f: np.ndarray, v: np.ndarray) -> np.ndarray:
        at = place[start_bin(f)]
        r = np.where(at[:, None] == np.arange(k), 1.0, np.where(at[:, None] < 0, 1.0 / k, 0.0))
        return sufficient((f - center) / scale, r * n[:, None], v / scale**2)

    mix, before, rounds = replace(maximise(total(begin, width), k, center, scale, floor), floor=floor), -np.inf, 0
    while True:

        def step(n: np.ndarray, f: np.ndarray, v: np.ndarray, mix: Mixture = mix) -> np.ndarray:
            r, ll = mix.posterior(f, v, n)
            return np.append(sufficient((f - center) / scale, r * n[:, None], v / scale**2), ll)

        got = total(step, width + 1)
        mix, rounds = replace(maximise(got[:-1], k, center, scale, floor), floor=floor), rounds + 1
        if got[-1] / n - before < tolerance:
            return replace(mix, rounds=rounds)
        before = got[-1] / n


def _pack(mix: Mixture) -> np.ndarray:
    return np.concatenate([[len(mix.weight), mix.rounds, mix.floor], mix.center, mix.scale, mix.weight, mix.mean.ravel(), mix.cov.ravel()])


def _unpack(x: np.ndarray) -> Mixture:
    k, rounds = int(x[0]), int(x[1])
    center, scale, weight, mean, cov = np.split(x[3:], np.cumsum([N, N, k, k * N]))
    return Mixture(center, scale, weight, mean.reshape(k, N), cov.reshape(k, N, N), x[2], rounds)


def fit_mixture(stats: DataFrame, components: int = 64, tolerance: float = 1e-5, floor: float = 0.05, one_task: int = ONE_TASK) -> Mixture | None:
    """The mixture of all segments, each counted in its cell, from the largest coarse bins. None for an empty table.

    Up to ``one_task`` cells are fitted in one task, more by one job a step; the steps are the same.
    """
    kept = write_stage(grid(stats), "grid")
    if kept.count() > one_task:
        mix = em(lambda step, size: _total(kept, lambda b: step(*_cells(b)), size), components, tolerance, floor)
        drop_stage(kept)
        return mix

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_cells(b) for b in batches if b.num_rows]
        n, f, v = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0), np.zeros((0, N)), np.zeros((0, N)))

        def total(step: Callable, size: int) -> np.ndarray:
            return sum((step(n[at : at + 4096], f[at : at + 4096], v[at : at + 4096]) for at in range(0, len(n), 4096)), np.zeros(size))

        mix = em(total, components, tolerance, floor)
        yield pa.RecordBatch.from_arrays([pa.array([_pack(mix)] if mix else [], pa.list_(pa.float64()))], ["x"])

    found = kept.coalesce(1).sortWithinPartitions("cell").mapInArrow(fit, "x array<double>").collect()
    drop_stage(kept)
    return _unpack(np.asarray(found[0].x)) if found else None


def name_components(mix: Mixture, prose: np.ndarray, other: np.ndarray) -> list[str]:
    """The class of each component, from its characters in judged prose and in what is judged not to be.

    It is prose if it holds more of the judged prose than of the rest. Where the judged documents hardly touch
    it, its common words weigh in. What is not prose is named by the nearest inspected example.
    """
    k = len(mix.weight)
    hint = np.clip((mix.mean * mix.scale + mix.center)[:, -1] / _COMMON_SHARE, 0.05, 0.95)
    a = prose / max(prose.sum(), 1e-9) + _PRIOR * hint
    b = other / max(other.sum(), 1e-9) + _PRIOR * (1 - hint)
    kinds = [c for c in CLASSES if c != "prose"]
    f = {c: (np.asarray([features(s) for s in EXAMPLES[c]]) - mix.center) / mix.scale for c in kinds}
    nearest = [min(kinds, key=lambda c: np.min(((f[c] - mix.mean[j]) ** 2).sum(1))) for j in range(k)]
    return ["prose" if a[i] > b[i] else nearest[i] for i in range(k)]


def class_shares(docs: DataFrame, labels: DataFrame, components: int = 64, most_labels: int = 50_000) -> DataFrame:
    """(doc_id, chars, prose, list, table, junk): the shares of a document's characters in each class.

    Documents that are null or blank, or have a null id, do not come out. ``labels`` (doc_id, quality: 1
    prose, 0 not) are judged documents; null labels count for nothing, rows given twice once, and beyond
    ``most_labels`` of them those of the smallest hash are used, which bounds what is broadcast. Without
    labels, common words decide. Everything else covers all documents. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    stats = write_stage(segment_statistics(docs), "segments")
    kind = docs.schema["doc_id"].dataType.simpleString()
    mix = fit_mixture(stats, components)
    if mix is None:
        return spark.createDataFrame([], f"doc_id {kind}, chars long, prose double, list double, table double, junk double")
    k = len(mix.weight)
    judged = labels.dropna(subset=["doc_id", "quality"]).groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)

    def by_label(b: pa.RecordBatch) -> np.ndarray:
        f = _matrix(b)
        r = mix.posterior(f)[0] * b.column(b.schema.get_field_index("chars")).to_numpy()[:, None]
        q = b.column(b.schema.get_field_index("quality")).to_numpy(zero_copy_only=False)
        return np.concatenate([r[q == 1].sum(0), r[q != 1].sum(0)])

    mass = _total(stats.join(F.broadcast(judged), "doc_id"), by_label, 2 * k)
    names = name_components(mix, *np.split(mass, 2))
    member = np.asarray([[n == c for c in CLASSES] for n in names], float)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chars = b.column(1).to_numpy()
            f = _matrix(b)
            w = np.concatenate([mix.posterior(f[at : at + 4096])[0] @ member for at in range(0, len(f), 4096)] or [np.zeros((0, 4))]) * chars[:, None]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(w[:, i]) for i in range(4))], ["doc_id", "chars", *CLASSES])

    each = stats.mapInArrow(weigh, f"doc_id {kind}, chars long, " + ", ".join(f"{c} double" for c in CLASSES))
    total = each.groupBy("doc_id").agg(F.sum("chars").alias("chars"), *(F.sum(c).alias(c) for c in CLASSES))
    return total.select("doc_id", "chars", *((F.col(c) / F.col("chars")).alias(c) for c in CLASSES))


def no_prose(shares: DataFrame) -> DataFrame:
    """(doc_id) of the documents of which more than half is list, table or junk."""
    return shares.filter(F.col("prose") < 0.5).select("doc_id").distinct()


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, words, mean_word_length, symbol_ratio, ended_lines, common_words), one row per row.

    Words are runs of letters and digits. ``symbol_ratio`` is the share of characters other than white
    space that are no letters or digits, ``ended_lines`` the share of lines not blank that end in a mark
    of a sentence, quotes and brackets aside, ``common_words`` the share of function words. A null text is
    an empty one; a ratio of nothing is null.
    """
    t = F.coalesce(docs[text], F.lit(""))
    found = F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(r"\S")))
    base = docs.select(docs[doc_id].alias("doc_id"), found.alias("w"), lines.alias("l"), F.regexp_replace(t, r"\s+", "").alias("s"))
    n = F.size("w").cast("long")
    common = F.size(F.filter("w", lambda x: F.lower(x).isin(*sorted(COMMON_WORDS))))
    ended = F.size(F.filter("l", lambda x: F.regexp_like(x, F.lit("[.!?…。！？؟।][\"'”’»)」』]*\\s*$"))))
    letters = F.length(F.array_join("w", ""))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b)

    return base.select(
        F.col("doc_id").alias(doc_id), n.alias("words"), ratio(letters, n).alias("mean_word_length"),
        ratio(F.length("s") - letters, F.length("s")).alias("symbol_ratio"), ratio(ended, F.size("l")).alias("ended_lines"), ratio(common, n).alias("common_words"),
    )
