"""Wrapper induction: what the pages of a host share is template, what varies is content.

Each page becomes a tree (``dom.parse``). Pages of a host that have the same paths from the root form a cluster;
pages whose set of paths is rare are clustered by coarser ones, up to the whole host. The smallest page of a
cluster is its model, and each page is aligned to it by simple tree matching. Matched nodes share a slot, nodes that
the model lacks add slots. Slots of constant text are template, all others hold content.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.dom import Node, parse, written
from postloom.operators.skew import lookup_join
from postloom.session import spread, write_stage

FEW = 2_000  # pairs of nodes that are compared one by one; of more, a node is compared with a whole level at once
HELD = 1 << 28  # pairs of siblings whose steps are held at once
_NEVER = -(1 << 62)
_SLICE = 256  # pages that are lists in Python at once
_NODE = "array<struct<depth:int,tag:string,body:string>>"


class Tree:
    """A page's nodes, with the children, the size and a digest of the subtree of each."""

    def __init__(self, nodes: list[Node]):
        self.tags = [t for _, t, _ in nodes]
        self.bodies = [b for _, _, b in nodes]
        self.kids: list[list[int]] = [[] for _ in nodes]
        self.roots: list[int] = []
        path: list[int] = []
        for i, (depth, _, _) in enumerate(nodes):
            del path[depth:]
            (self.kids[path[-1]] if path else self.roots).append(i)
            path.append(i)
        self.sizes, self.same = [1] * len(nodes), [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            self.sizes[i] += sum(self.sizes[k] for k in self.kids[i])
            self.same[i] = hash((self.tags[i], self.bodies[i], tuple(self.same[k] for k in self.kids[i])))


class _Levels:
    """A tree level by level, to compare one node of another tree with all nodes of a level at once.

    A level holds the children of each node above it as a row of cells, after one cell that stands for none of them.
    The worth of a match is its size times ``unit``, plus its pairs of equal text. The rows of a level lie in one array, each
    raised above all that the rows before it can be worth, so a running maximum over the array never leaves a row.
    What subtrees of more than 1/64 of all nodes are worth is kept (at most 64 numbers a cell), or else each level of
    aligned nodes would take it again.
    """

    def __init__(self, a: Tree, b: Tree):
        self.a, self.unit = a, min(len(a.tags), len(b.tags)) + 1
        self.kept: dict[int, tuple[int, int, np.ndarray]] = {}
        tags, bodies = ({t: i for i, t in enumerate(dict.fromkeys(z))} for z in (b.tags, b.bodies))
        self.tag_of = [tags.get(t, -2) for t in a.tags]
        self.body_of = [bodies.get(s, -2) if s else -2 for s in a.bodies]
        self.level_of, self.cell_of = [0] * len(b.tags), [0] * len(b.tags)
        # of each level: the tag and the body of every cell (-1: no node), the nodes before it, its raise; the cell of every node;
        # the first cell, the last one and the raise of every row
        self.levels: list[tuple[np.ndarray, ...]] = []
        rows, sizes = [b.roots], [len(b.tags) + 1]
        while any(rows):
            counts = np.array([len(r) for r in rows])
            nodes = [q for r in rows for q in r]
            ends = np.cumsum(counts + 1)
            cells = np.arange(len(nodes)) + np.repeat(np.arange(len(rows)), counts) + 1
            tag, body = np.full(ends[-1], -1), np.full(ends[-1], -1)
            tag[cells], body[cells] = [tags[b.tags[q]] for q in nodes], [bodies[b.bodies[q]] for q in nodes]
            before = np.concatenate([[0], np.cumsum(tag >= 0)])
            raised = (np.cumsum(sizes) - sizes) * self.unit
            for q, cell in zip(nodes, cells.tolist(), strict=True):
                self.level_of[q], self.cell_of[q] = len(self.levels), cell
            self.levels.append((tag, body, before, np.repeat(raised, counts + 1), cells, np.concatenate([[0], ends]), ends - 1, raised))
            rows, sizes = [b.kids[q] for q in nodes], [b.sizes[q] for q in nodes]

    def worth(self, p: int, level: int, lo: int, hi: int) -> np.ndarray | None:
        """What matching the subtree of ``p`` with that of each cell is worth; nothing if no cell has its tag."""
        if p in self.kept and self.kept[p][0] <= lo and hi <= self.kept[p][1]:
            at, _, out = self.kept[p]
            return out[lo - at : hi - at]
        tag, body, before, _, cells, *_ = self.levels[level]
        hit = tag[lo:hi] == self.tag_of[p]
        if not hit.any():
            return None
        out = np.where(hit, self.unit, _NEVER)
        if self.body_of[p] >= 0:
            out += body[lo:hi] == self.body_of[p]
        if self.a.kids[p] and level + 1 < len(self.levels):
            _, _, _, raises, _, first, last, raised = self.levels[level + 1]
            i, j = before[lo], before[hi]
            start, stop = first[i], first[j]
            if stop - start > j - i:  # some of them have children
                w = raises[start:stop].copy()
                for k in self.a.kids[p]:
                    if (v := self.worth(k, level + 1, start, stop)) is not None:
                        np.maximum(w[1:], w[:-1] + v[1:], out=w[1:])
                        np.maximum.accumulate(w, out=w)
                out[cells[i:j] - lo] += w[last[i:j] - start] - raised[i:j]
        if 64 * self.a.sizes[p] > len(self.a.tags):
            self.kept[p] = lo, hi, out
        return out

    def align(self, x: list[int], y: list[int], held: int) -> list[tuple[int, int]]:
        """Pairs of siblings of the match of most worth. The steps of some rows are held at once, those of others taken again."""
        level, lo = self.level_of[y[0]], self.cell_of[y[0]]
        height = max(held // len(y), isqrt(32 * len(x))) + 1
        heads = [np.zeros(len(y) + 1, np.int64)]

        def below(w: np.ndarray, v: np.ndarray) -> np.ndarray:
            out = w.copy()
            np.maximum(w[1:], w[:-1] + v, out=out[1:])
            return np.maximum.accumulate(out, out=out)

        for at in range(0, len(x) - height, height):
            w = heads[-1]
            for p in x[at : at + height]:
                if (v := self.worth(p, level, lo, lo + len(y))) is not None:
                    w = below(w, v)
            heads.append(w)
        j, got = len(y), []
        while heads and j:
            w = heads.pop()[: j + 1]
            steps = []
            for p in x[len(heads) * height : (len(heads) + 1) * height]:
                if (v := self.worth(p, level, lo, lo + len(w) - 1)) is not None:
                    above, w = w, below(w, v)
                    steps.append((p, np.packbits(w[1:] == above[:-1] + v), np.packbits(w[1:] == above[1:])))
            for p, taken, kept in reversed(steps):
                while j:
                    byte, bit = (j - 1) >> 3, 128 >> ((j - 1) & 7)
                    if taken[byte] & bit:
                        j -= 1
                        got.append((p, y[j]))
                        break
                    if kept[byte] & bit:
                        break
                    j -= 1
        return got[::-1]


def simple_tree_matching(a: Tree, b: Tree, exact: int = FEW, part: int = HELD) -> tuple[int, list[tuple[int, int]]]:
    """Size of a largest top-down, order-keeping match of two forests, and the matched pairs of nodes.

    Nodes match if their tags are equal; among equal matches, nodes of equal text are preferred as far as that
    does not make the match smaller. Equal subtrees at both ends are matched first, which loses nothing. Forests of
    any size are compared whole: those of up to ``exact`` pairs of nodes pair by pair, larger ones a node and a level at a
    time, with the steps of about ``part`` pairs of siblings held at once. Neither number changes the match. The time grows with
    the product of both sizes, the memory with what is held and with the size of ``b``.
    """

    def align(x: list[int], y: list[int]) -> list[tuple[int, int]]:
        """Pairs of siblings, by the size of their match."""
        w = [[(0, 0)] * (len(y) + 1) for _ in range(len(x) + 1)]
        value: dict[tuple[int, int], tuple[int, int]] = {}
        for i, p in enumerate(x):
            row, above = w[i + 1], w[i]
            for j, q in enumerate(y):
                best = max(above[j + 1], row[j])
                if a.tags[p] == b.tags[q]:
                    n, e, _ = match(a.kids[p], b.kids[q])
                    v = value[i, j] = (n + 1, e + (a.bodies[p] == b.bodies[q] != ""))
                    best = max(best, (above[j][0] + v[0], above[j][1] + v[1]))
                row[j + 1] = best
        i, j, got = len(x), len(y), []
        while i and j:
            v = value.get((i - 1, j - 1))
            if v is not None and w[i][j] == (w[i - 1][j - 1][0] + v[0], w[i - 1][j - 1][1] + v[1]):
                got.append((x[i - 1], y[j - 1]))
                i, j = i - 1, j - 1
            elif w[i][j] == w[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return got[::-1]

    levels: _Levels | None = None

    def align_levels(x: list[int], y: list[int]) -> list[tuple[int, int]]:
        nonlocal levels
        both = {a.tags[p] for p in x} & {b.tags[q] for q in y}
        xs, ys = [p for p in x if a.tags[p] in both], [q for q in y if b.tags[q] in both]
        if len(xs) == len(both) and [a.tags[p] for p in xs] == [b.tags[q] for q in ys]:
            return list(zip(xs, ys, strict=True))  # each has one partner at most, and none cross
        levels = levels or _Levels(a, b)
        return levels.align(x, y, part)

    known: dict[tuple[int, int, int, int], tuple[int, int, list]] = {}

    def equal(x: int, y: int) -> tuple[int, int, list]:
        n = a.sizes[x]
        return n, sum(1 for s in a.bodies[x : x + n] if s), [(x + k, y + k) for k in range(n)]

    def match(x: list[int], y: list[int]) -> tuple[int, int, list]:
        if not x or not y:
            return 0, 0, []
        key = (x[0], len(x), y[0], len(y))
        if key in known:
            return known[key]
        n, e, pairs = 0, 0, []

        def add(m: tuple[int, int, list]) -> None:
            nonlocal n, e
            n, e = n + m[0], e + m[1]
            pairs.extend(m[2])

        lo, hx, hy = 0, len(x), len(y)
        while lo < hx and lo < hy and a.same[x[lo]] == b.same[y[lo]]:
            add(equal(x[lo], y[lo]))
            lo += 1
        while hx > lo and hy > lo and a.same[x[hx - 1]] == b.same[y[hy - 1]]:
            hx, hy = hx - 1, hy - 1
            add(equal(x[hx], y[hy]))
        xs, ys = x[lo:hx], y[lo:hy]
        if xs and ys:
            few = sum(a.sizes[p] for p in xs) * sum(b.sizes[q] for q in ys) <= exact
            for p, q in align(xs, ys) if few else align_levels(xs, ys):
                add((1, a.bodies[p] == b.bodies[q] != "", [(p, q)]))
                add(match(a.kids[p], b.kids[q]))
                if not few:
                    known.clear()  # no other pair asks for what lies below this one
        known[key] = (n, e, pairs)
        return known[key]

    n, _, pairs = match(a.roots, b.roots)
    return n, sorted(pairs)


def place(nodes: list[Node], model: list[Node]) -> list[int]:
    """The slot of every node of a page: the number of the model's node it matches, or else a slot of its own.

    A node that the model lacks adds a slot, known by where it is inserted (below which slot, after which
    matched one), its tag and its number there, so pages with the same additions share their slots.
    """
    if nodes == model:
        return list(range(len(nodes)))
    tree = Tree(nodes)
    other = dict(simple_tree_matching(tree, Tree(model))[1])
    out = [-1] * len(nodes)

    todo = [(-1, tree.roots)]
    while todo:
        above, kids = todo.pop()
        last, added = -1, Counter()
        for i in kids:
            slot = other.get(i)
            if slot is None:
                gap = (above, last, tree.tags[i])
                added[gap] += 1
                slot = (1 << 56) + int.from_bytes(hashlib.blake2b(repr((gap, added[gap])).encode(), digest_size=7).digest())
            else:
                last = slot
            out[i] = slot
            todo.append((slot, tree.kids[i]))
    return out


def signatures(nodes: list[Node]) -> list[int]:
    """Digests of a page's set of root paths: all of them, those of two levels, the tags at the root, none.

    What stands in text (inline elements, links, attributes) and in arguments does not count.
    """
    paths: set[tuple[str, ...]] = set()
    path: list[str] = []
    for depth, tag, _ in nodes:
        del path[depth:]
        path.append(tag)
        if tag[0] not in "@~" and not tag.startswith(("arg", "link:")):
            paths.add(tuple(path))
    levels = [paths, {p[:2] for p in paths}, {p[:1] for p in paths}, set()]
    return [int.from_bytes(hashlib.blake2b(repr(sorted(p)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), signed=True) for p in levels]


def _pages(column: pa.ListArray) -> Iterator[list[Node]]:
    """The nodes of each row of a column of pages."""
    flat = column.flatten()
    nodes = list(zip(*(flat.field(i).to_pylist() for i in range(3)), strict=True))
    at = 0
    for n in column.value_lengths().to_pylist():
        yield nodes[at : at + (n or 0)]
        at += n or 0


def induce_wrappers(df: DataFrame, key: str, host: str, text: str, support: int = 3, share: float = 0.5) -> DataFrame:
    """(key, host, n_nodes, n_template, content): each page without the parts that its host's pages share.

    A page belongs to the finest cluster of its host (by all root paths, those of two levels, the tags at the root,
    the host) that has at least ``support`` pages. A slot that holds one and the same text on at least ``share`` of the pages that
    have it, and on at least ``support`` pages, is template; in a slot on fewer than ``support`` pages, text is
    template that another slot of the host, of the same tag, has as such. All other nodes are content, written as
    clean text. Rows with a null key count for nothing; a null host is a host of its own; a page without text has no
    nodes and empty content; one row per key comes out (of differing texts under one key, the greatest). An
    empty table gives an empty result. Whole pages are aligned, whatever their size.
    """
    kind = df.schema[key].dataType.simpleString()

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                b = whole.slice(at, _SLICE)
                pages = [parse(t) for t in b.column(2).to_pylist()]
                nodes = [n for p in pages for n in p]
                fields = [pa.array([n[i] for n in nodes], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string()))]
                ends = pa.array(np.cumsum([0, *map(len, pages)]), pa.int32())
                parts = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, ["depth", "tag", "body"]))
                sigs = pa.array([signatures(p) if p else [] for p in pages], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), parts, sigs], ["k", "h", "parts", "sigs"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, host, cluster, number, tag, slot, digest of the text) of every node that has a text."""
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                b = whole.slice(at, _SLICE)
                owner, number, tags, slots, same = [], [], [], [], []
                for r, (page, model) in enumerate(zip(_pages(b.column(3)), _pages(b.column(4)), strict=True)):
                    for i, (slot, (_, tag, body)) in enumerate(zip(place(page, model), page, strict=True)):
                        if body:
                            owner.append(r)
                            number.append(i)
                            tags.append(tag)
                            slots.append(slot)
                            same.append(xxhash.xxh64_intdigest(body.encode("utf-8", "surrogatepass")) - (1 << 63))
                rows = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(rows) for c in range(3)), pa.array(number, pa.int32()), pa.array(tags, pa.string()), pa.array(slots, pa.int64()), pa.array(same, pa.int64())],
                    ["k", "h", "c", "node", "tag", "slot", "same"],
                )

    def content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                b = whole.slice(at, _SLICE)
                texts, sizes, counts = [], [], []
                for page, gone in zip(_pages(b.column(2)), b.column(3).to_pylist(), strict=True):
                    out = set(gone or ())
                    texts.append(written([(tag, body) for i, (_, tag, body) in enumerate(page) if i not in out]))
                    sizes.append(len(page))
                    counts.append(len(out))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(texts, pa.string())], ["k", "h", "n_nodes", "n_template", "content"])

    h = F.coalesce(df[host].cast("string"), F.lit("\u0000"))
    pages = df.select(df[key].alias("k"), h.alias("h"), F.coalesce(df[text], F.lit("")).alias("t")).filter("k is not null")
    pages = spread(pages.groupBy("k").agg(F.max_by("h", "t").alias("h"), F.max("t").alias("t")))
    pages = write_stage(pages.select("k", "h", "t").mapInArrow(parsed, f"k {kind}, h string, parts {_NODE}, sigs array<bigint>"), "parsed")
    n_pages = pages.count()
    # the finest cluster with enough pages; only keys and digests are shuffled
    levels = pages.filter(F.size("sigs") > 0).select("k", "h", F.size("parts").alias("size"), F.posexplode("sigs").alias("level", "sig"))
    groups = levels.groupBy("h", "level", "sig").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("size", "k"))["k"].alias("mk"))
    groups = write_stage(groups, "clusters")
    every = lookup_join(levels.drop("size"), groups, ["h", "level", "sig"], "n", rows=4 * n_pages).filter((F.col("n") >= support) | (F.col("level") == 3))
    chosen = every.groupBy("k").agg(F.min(F.struct("level", "sig", "mk", "n")).alias("x")).select("k", F.xxhash64("x.level", "x.sig").alias("c"), "x.mk")
    chosen = write_stage(chosen, "chosen")
    uses = chosen.groupBy("mk").agg(F.count(F.lit(1)).alias("uses"))
    models = pages.select(F.col("k").alias("mk"), F.col("parts").alias("model")).join(uses, "mk")
    models = write_stage(models, "models")
    own = pages.drop("sigs").join(chosen, "k")
    aligned = lookup_join(own, models, ["mk"], "uses", 100_000, rows=n_pages).select("k", "h", "c", "parts", "model")
    nodes = write_stage(aligned.mapInArrow(placed, f"k {kind}, h string, c bigint, node int, tag string, slot bigint, same bigint"), "nodes")
    seen = write_stage(nodes.groupBy("h", "c", "slot", "tag", "same").agg(F.count(F.lit(1)).alias("n")), "seen")
    slots = write_stage(seen.groupBy("h", "c", "slot").agg(F.max("n").alias("most"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("texts")), "slots")
    judged = write_stage(lookup_join(seen, slots, ["h", "c", "slot"], "texts", 100_000), "judged")
    sure = judged.filter((F.col("n") >= support) & (F.col("n") == F.col("most")) & (F.col("n") >= share * F.col("all")))
    known = write_stage(sure.select("h", "tag", "same").distinct().withColumn("known", F.lit(True)), "known")
    thin = lookup_join(judged.filter(F.col("all") < support).select("h", "c", "slot", "tag", "same", "n"), known, ["h", "tag", "same"], None, 100_000, rows=judged.count()).filter("known")
    fixed = sure.select("h", "c", "slot", "same", "n").unionByName(thin.select("h", "c", "slot", "same", "n"))
    fixed = write_stage(fixed.withColumn("fixed", F.lit(True)), "fixed")
    marked = lookup_join(nodes.select("k", "h", "c", "node", "slot", "same"), fixed, ["h", "c", "slot", "same"], "n", 100_000, rows=nodes.count()).filter("fixed")
    gone = marked.groupBy("k").agg(F.collect_list("node").alias("gone"))
    got = pages.drop("sigs").join(gone, "k", "left").select("k", "h", "parts", "gone")
    got = got.mapInArrow(content, f"k {kind}, h string, n_nodes bigint, n_template bigint, content string")
    return got.select(F.col("k").alias(key), F.nullif("h", F.lit("\u0000")).alias(host), "n_nodes", "n_template", "content")
