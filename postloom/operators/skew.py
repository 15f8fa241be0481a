"""Per-key results that no heavy key can unbalance: exact offset chunking.

A plain ``groupBy(key)`` with a function that needs the rows of a key in order (distinct counts, gaps,
ranks) puts all rows of one key into one task. Here the rows are brought into one total order, every
row gets its exact number in that order, and the numbers are cut into chunks of equal size, whatever
the keys. Each chunk yields one small state per key it touches; the states of a key, in chunk order,
are then merged at their boundaries.

1. Range partitioning on (keys, order, scan position). The last column breaks ties, so even one
   (key, order) value that makes up a third of the table is spread. The sorted partitions are written
   once, with each row's position, as recomputed range bounds might differ.
2. Rows per partition, prefix-summed, give each partition's offset; offset + position = row number.
3. ``chunk = row number div chunk_rows``: all chunks but the last hold exactly ``chunk_rows`` rows, and more
   than that once there are over 2^17 chunks.
4. Within a chunk, neighbours are compared and one state per (chunk, key) is made.
5. The states of a key are merged in chunk order. There are at most #keys + #chunks of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.session import sized_partitions, write_stage

_POS_BITS = 33  # monotonically_increasing_id: partition number above, position in it below
CHUNK_ROWS = 1 << 16
MOST_CHUNKS = 1 << 17  # beyond so many chunks of CHUNK_ROWS, chunks grow instead


def chunk_size(n_rows: int, chunk_rows: int = CHUNK_ROWS) -> int:
    """Rows of a chunk, so that the boundary states of a single key stay few however many rows it has."""
    return max(chunk_rows, -(-n_rows // MOST_CHUNKS))


def _fresh(name: str, taken: Sequence[str]) -> str:
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str] = (), partitions: int | None = None
) -> DataFrame:
    """Rows in the total order of (keys, order), numbered from 0 without gaps, as column ``row_no``.

    Only the named columns are kept. Nulls sort first. Rows equal in all of (keys, order) come in scan
    order. An empty table gives an empty result. As many partitions are made as the estimated size asks for.
    """
    return _numbered(df, keys, order, payload, partitions)[0]


def _numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str] = (), partitions: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The same, and the written table of all rows, whose number is known from its files."""
    cols = list(dict.fromkeys([*keys, *order, *payload]))
    tie, pos = _fresh("_tie", cols), _fresh("_pos", cols)
    if "row_no" in {c.lower() for c in cols}:
        raise ValueError("row_no is the name of the result's own column")
    slim = df.select(*cols)
    n = partitions or sized_partitions(slim)
    ranged = slim.withColumn(tie, F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(n, *keys, *order, tie).sortWithinPartitions(*keys, *order, tie).drop(tie)
    placed = write_stage(ranged.withColumn(pos, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(F.col(pos), _POS_BITS)
    # one row per partition: the window over them is as small as the number of partitions
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    row_no = F.col("_start") + F.col(pos).bitwiseAND((1 << _POS_BITS) - 1)
    return placed.join(F.broadcast(starts), part == F.col("_part")).select(*cols, row_no.alias("row_no")), placed


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def chunked_group_stats(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Sequence[str] = (),
    chunk_rows: int = CHUNK_ROWS,
    partitions: int | None = None,
) -> DataFrame:
    """Per key: ``n_rows``, ``n_distinct`` values of ``order`` and ``sum_<c>`` of each ``sums`` column,
    taken once per distinct (key, order); all tasks handle equal numbers of rows however uneven the keys.

    Null keys and null order values are values like any other (filter first if they should not count).
    Of rows with equal (key, order), the first in scan order gives the summed values; a null counts as 0.
    An empty table gives an empty result. Other columns of ``df`` are ignored, whatever their names.
    """
    if not keys or not order or chunk_rows < 1:
        raise ValueError("keys, order and a chunk size of at least 1 are needed")
    k = {f"k{i}": c for i, c in enumerate(keys)}
    o = {f"o{i}": c for i, c in enumerate(order)}
    s = {f"s{i}": c for i, c in enumerate(sums)}
    slim = df.select(*(df[c].alias(a) for a, c in {**k, **o, **s}.items()))
    rows, placed = _numbered(slim, list(k), list(o), list(s), partitions)
    rows = rows.select(
        *k, F.struct(*k).alias("k"), F.struct(*o).alias("o"), *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in s),
        F.floor(F.col("row_no") / F.lit(chunk_size(placed.count(), chunk_rows))).alias("chunk"), "row_no",
    )
    w = Window.partitionBy("chunk").orderBy("row_no")
    new = ~(_same(F.col("k"), F.lag("k").over(w)) & _same(F.col("o"), F.lag("o").over(w)))
    rows = rows.withColumn("new", F.coalesce(new, F.lit(True)) | (F.row_number().over(w) == 1))
    states = rows.groupBy("chunk", *k).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("new").cast("long")).alias("d"),
        F.min_by("o", "row_no").alias("head"),
        F.max_by("o", "row_no").alias("tail"),
        *(F.sum(F.when(F.col("new"), F.col(c)).otherwise(0)).alias(c) for c in s),
        *(F.min_by(c, "row_no").alias(f"h{c}") for c in s),
    )
    # a key that ends one chunk and starts the next: its first value there may be the last one here again
    b = Window.partitionBy(*k).orderBy("chunk")
    again = F.coalesce(_same(F.col("head"), F.lag("tail").over(b)), F.lit(False)) & (F.row_number().over(b) > 1)
    merged = states.withColumn("again", again).groupBy(*k).agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.col("d") - F.col("again").cast("long")).alias("n_distinct"),
        *(F.sum(F.col(c) - F.when(F.col("again"), F.col(f"h{c}")).otherwise(0)).alias(f"sum_{name}") for c, name in s.items()),
    )
    return merged.select(*(F.col(a).alias(c) for a, c in k.items()), "n_rows", "n_distinct", *(f"sum_{c}" for c in sums))


def key_ranks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS, partitions: int | None = None
) -> DataFrame:
    """Every row with ``row_no`` and ``key_rank`` (1 for the first row of its key), balanced as above.

    A chunk ranks its own rows; only the key it shares with earlier chunks needs a carry, one number per
    chunk, so nothing that grows with the rows of a key reaches a single task.
    """
    rows, placed = _numbered(df, keys, order, payload, partitions)
    rows = rows.withColumn("_chunk", F.floor(F.col("row_no") / F.lit(chunk_size(placed.count(), chunk_rows))))
    per = rows.groupBy("_chunk", *keys).agg(F.count(F.lit(1)).alias("_n"))
    b = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.withColumn("_carry", F.sum("_n").over(b)).filter("_carry is not null").groupBy("_chunk").agg(
        F.max_by("_carry", "_carry").alias("_carry"), F.max_by(F.struct(*keys), "_carry").alias("_key")
    )
    w = Window.partitionBy("_chunk", *keys).orderBy("row_no")
    got = rows.withColumn("_r", F.row_number().over(w)).join(carry, "_chunk", "left")
    rank = F.col("_r") + F.when(_same(F.struct(*keys), F.col("_key")), F.col("_carry")).otherwise(0)
    return got.select(*(c for c in rows.columns if c != "_chunk"), rank.cast("long").alias("key_rank"))


def document_frequencies(postings: DataFrame, partitions: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(build_id, term, df, tot): distinct documents per term and build, and the sum of ``tf`` over them.

    Rows delivered twice count once; rows whose build, term or document is null count for nothing.
    """
    kept = postings.select("build_id", "term", "doc_id", "tf").dropna(subset=["build_id", "term", "doc_id"])
    got = chunked_group_stats(kept, ["build_id", "term"], ["doc_id"], ["tf"], chunk_rows, partitions)
    return got.select("build_id", "term", F.col("n_distinct").alias("df"), F.col("sum_tf").alias("tot"))


def wrong_global_df(index_globals: DataFrame, postings: DataFrame, partitions: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(build_id, shard, term) of the rows whose ``global_df`` is stated and is not the true count.

    A term without postings, or a null term, has the true count 0. Repeated rows come out once.
    """
    stated = index_globals.filter("global_df is not null").select("build_id", "shard", "term", "global_df").distinct()
    true = document_frequencies(postings, partitions, chunk_rows)
    got = stated.join(true, ["build_id", "term"], "left").filter(F.col("global_df") != F.coalesce(F.col("df"), F.lit(0)))
    return got.select("build_id", "shard", "term").distinct()


def lookup_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], count_col: str | None = None, min_rows: int = 1_000_000, most: int = 10_000,
    rows: int | None = None,
) -> DataFrame:
    """Left outer join of ``left`` with a lookup table that has one row per key, safe from heavy keys.

    A key with more than ``max(min_rows, rows / most)`` rows on the left is heavy. There can be no more than
    ``most`` of them, and only a hash of their keys is broadcast, with the number of salts each needs: the
    rows of a heavy key are spread over that many groups, and its lookup row is copied to each. So no lookup
    row is broadcast, whatever its size, ``left`` is read once, and no key can dominate a task. Without heavy
    keys it is a plain join, and where ``left`` has at most ``min_rows`` rows (``rows`` states a bound on them; those of
    a written stage are counted) there can be none. ``count_col`` of ``right`` states the rows per key where they are known already
    (``right`` is then read for them first, so it should be a written table); otherwise they are counted.
    Null keys match nothing.
    """
    on = list(on)
    if rows is None and hasattr(left, "_stage_path"):
        rows = left.count()
    if rows is not None and rows <= min_rows:
        return left.join(right, on, "left")
    names = [*left.columns, *right.columns]
    cnt, key, salt, salts = (_fresh(c, names) for c in ("_cnt", "_key", "_salt", "_salts"))
    if count_col is None:
        known = write_stage(right.join(left.groupBy(*on).agg(F.count(F.lit(1)).alias(cnt)), on, "left"), "known")
    else:
        known = right.withColumn(cnt, F.col(count_col))
    total, largest = known.agg(F.sum(cnt), F.max(cnt)).first()
    limit = max(min_rows, int(total or 0) // most)
    if not largest or largest <= limit:
        return left.join(known.drop(cnt), on, "left")
    kinds = {f.name: f.dataType for f in right.schema}
    hashed = F.xxhash64(*(F.col(c).cast(kinds[c]) for c in on))
    heavy = known.filter(F.col(cnt) > limit).groupBy(hashed.alias(key)).agg(F.max(F.ceil(F.col(cnt) / limit)).cast("int").alias(salts))
    heavy = F.broadcast(write_stage(heavy, "heavy"))  # at most ``most`` rows of 12 bytes
    # the salt of a row is a hash of its values, so that a lost task chooses the same again
    own = F.when(F.col(salts).isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.col(salts))).cast("int")
    many = left.withColumn(key, hashed).join(heavy, key, "left").withColumn(salt, own).drop(key, salts)
    copies = F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1)
    few = known.drop(cnt).withColumn(key, hashed).join(heavy, key, "left").withColumn(salt, F.explode(copies)).drop(key, salts)
    return many.join(few, [*on, salt], "left").drop(salt)


def small_join(left: DataFrame, right: DataFrame, on: Sequence[str], most: int = 100_000) -> DataFrame:
    """Left outer join with a lookup table that is expected to be small, as one row per build is.

    The table is written and its rows are counted: up to ``most`` of them are broadcast, more are joined by
    ``lookup_join``.
    """
    kept = write_stage(right, "small")
    return left.join(F.broadcast(kept), list(on), "left") if kept.count() <= most else lookup_join(left, kept, on)
