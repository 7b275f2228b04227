"""Exact selection and ranking by a seeded hash, without sorting a group in one task.

Rows of each group are spread over buckets of a seeded hash of their identifier.
Counts by bucket give, by a running sum, the bucket in which a cut at rank k
falls; only that bucket's rows are ranked. The number of buckets follows the
number of rows, so a bucket stays small at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.storage import write_table

ROWS_A_BUCKET = 20_000


def seeded_hash(identifier: str | Column, seed: int) -> Column:
    """A 64-bit hash of the identifier that depends on the seed; stable under any partitioning."""
    c = F.col(identifier) if isinstance(identifier, str) else identifier
    return F.xxhash64(F.lit(seed), c.cast("string"))


def buckets_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_A_BUCKET))


def with_bucket(df: DataFrame, identifier: str, seed: int, buckets: int) -> DataFrame:
    """Adds ``_hash`` and its ``_bucket``: buckets are ranges of the hash, so their order is the order of the hash."""
    h = seeded_hash(identifier, seed)
    # shiftrightunsigned by 1 makes it non-negative; the quotient of 2^63 by the buckets gives equal ranges
    width = (2**63 - 1) // buckets + (buckets > 1)  # fits a long also for one bucket
    return df.withColumn("_hash", F.shiftrightunsigned(h, 1)).withColumn("_bucket", F.expr(f"_hash div {width}L"))


def rank_in_group(df: DataFrame, group: list[str], identifier: str, *, seed: int, rows: int) -> DataFrame:
    """Adds ``rank``: 0, 1, ... in each group in the order of the seeded hash, exact for groups of any size.

    One shuffle by (group, bucket); the offsets come from the counts by bucket.
    """
    spread = with_bucket(df, identifier, seed, buckets_for(rows))
    counts = spread.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_bucket").orderBy("_hash", identifier)
    ranked = spread.withColumn("_rank", F.row_number().over(inside))
    keys = [ranked[c].eqNullSafe(offsets[c]) for c in [*group, "_bucket"]]
    condition = keys[0]
    for k in keys[1:]:
        condition = condition & k
    joined = ranked.join(offsets, condition)
    return joined.select(*[ranked[c] for c in df.columns], (F.col("_rank") - 1 + F.col("_before")).cast("long").alias("rank"))


def ranged(df: DataFrame, order: list[str], rows: int | None = None) -> DataFrame:
    """Range partitions of the order with their number ``_part``; a hot key spreads over several of them.

    Written to the shared folder: ranges are sampled, so they must be drawn once for all that reads them, and stay after a loss.
    """
    parts = buckets_for(df.count() if rows is None else rows)
    return write_table(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def number_in_group(df: DataFrame, group: list[str], order: list[str], name: str, *, rows: int | None = None) -> DataFrame:
    """Adds ``name``: 1, 2, ... in each group in the given order, exact for groups of any size.

    Rows are partitioned by ranges of (group, order); a group's rows before a partition are counted, not collected.
    Null groups are one group. The order must be total for a result that does not depend on the partitioning.
    """
    cut = ranged(df, [*group, *order], rows)
    counts = cut.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = cut.withColumn("_in", F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order)))
    condition = numbered["_part"] == offsets["_part"]
    for c in group:
        condition = condition & numbered[c].eqNullSafe(offsets[c])
    joined = numbered.join(offsets, condition)
    return joined.select(*[numbered[c] for c in df.columns], (F.col("_in") + F.col("_before")).cast("long").alias(name))


def running_total(df: DataFrame, order: list[str], value: str, name: str, *, rows: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of the value over all rows before this one in a total order of the whole table.

    Sums by range partition give each partition's start; no task sees more than its own rows.
    """
    cut = ranged(df, order, rows)
    sums = cut.groupBy("_part").agg(F.sum(value).alias("_s"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = sums.select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(offsets, "_part").select(*df.columns, (F.col("_before") + F.col("_in")).alias(name))
