"""Top N items within every group: two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.session import write_stage

ROWS_PER_SUBGROUP = 200_000
MOST_SPLIT_GROUPS = 10_000


def top_n(
    df: DataFrame, group: str, item: str, score: str, n: int = 10, rows_per_subgroup: int = ROWS_PER_SUBGROUP, most_split: int = MOST_SPLIT_GROUPS
) -> DataFrame:
    """(group, item, score, rank): per group the ``n`` distinct items of the highest score.

    An item counts with its highest score in the group; among equal scores the smaller item goes first.
    Rows whose group, item or score is null, or whose score is NaN, count for nothing, so a group without
    any score does not come out; infinite scores are scores. Repeated rows change nothing, and an empty
    table gives an empty result. Other columns are ignored, whatever their names.

    A group is split into ``ceil(rows / size)`` subgroups by a hash of the item, so all rows of an item
    meet in one subgroup; each keeps its ``n`` best, and the survivors are ranked again. ``size`` is
    ``rows_per_subgroup`` or a ``most_split``-th of all rows if that is more, so at most ``most_split``
    groups have several subgroups, which bounds the broadcast table of their numbers. The rows of split
    groups are first combined where they are read, so an item that is delivered very often does not
    fill a subgroup. All other rows are shuffled once; the last shuffle carries survivors only.
    """
    rows = df.select(df[group].alias("g"), df[item].alias("i"), df[score].cast("double").alias("s"))
    rows = rows.filter(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    sizes = write_stage(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "sizes")
    total, largest = sizes.agg(F.sum("n"), F.max("n")).first()
    size = max(rows_per_subgroup, -(-(total or 0) // most_split))
    salted = rows.withColumn("salt", F.lit(0))
    if largest and largest > size:
        split = F.broadcast(write_stage(sizes.filter(F.col("n") > size).select("g", F.ceil(F.col("n") / size).alias("parts")), "split"))
        # per task of the scan one row of an item is left before the shuffle; the task's number spreads them after it
        large = rows.join(split, "g").groupBy("g", "i", "parts", F.spark_partition_id().alias("task")).agg(F.max("s").alias("s"))
        large = large.select("g", "i", "s", F.pmod(F.xxhash64("i"), F.col("parts")).cast("int").alias("salt"))
        salted = salted.join(split, "g", "left_anti").unionByName(large)
    # one exchange serves the dedup of items and the ranking within subgroups
    best = salted.repartition("g", "salt").groupBy("g", "salt", "i").agg(F.max("s").alias("s"))
    order = [F.col("s").desc(), F.col("i").asc()]
    first = best.withColumn("r", F.row_number().over(Window.partitionBy("g", "salt").orderBy(*order))).filter(F.col("r") <= n).drop("r")
    last = first.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(*order))).filter(F.col("r") <= n)
    return last.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("r").alias("rank"))
