"""Grouping: majority votes, runs, ordered lists, uniqueness. Every order is an explicit column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.operators.ranking import ranged


def majority_vote(df: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """``keys, winner, n``: the most frequent value; ties go to the one seen first."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("_first"))
    best = F.max_by(F.struct(F.col(value).alias("winner"), "n"), F.struct(F.col("n"), -F.col("_first")))
    return counted.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.winner", "_b.n")


def run_groups(df: DataFrame, key: str, pos: str, partition: list[str] | None = None) -> DataFrame:
    """Adds ``run_id``: a key that comes again after another one starts a new run. The position must be unique.

    Runs are counted within ``partition``. Without one the order is over the whole table: its ranges are cut into
    runs apart, and the last key and the runs of each range, one row for each, tell where the next one goes on.
    """
    if partition:
        order = Window.partitionBy(*partition).orderBy(pos)
        changed = ~F.col(key).eqNullSafe(F.lag(key).over(order)) | (F.row_number().over(order) == 1)
        return df.withColumn("_new", changed.cast("int")).withColumn("run_id", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    cut = ranged(df, [pos])
    inside = Window.partitionBy("_part").orderBy(pos)
    new = (F.row_number().over(inside) > 1) & ~F.col(key).eqNullSafe(F.lag(key).over(inside))
    marked = cut.withColumn("_new", new.cast("int"))
    ends = marked.groupBy("_part").agg(F.sum("_new").alias("_runs"), F.min_by(F.struct(key), pos).alias("_first"), F.max_by(F.struct(key), pos).alias("_last"))
    parts = Window.orderBy("_part")  # one row for each range
    before = F.lag("_last").over(parts)
    starts = ends.select("_part", "_runs", (before.isNull() | ~F.col("_first").eqNullSafe(before)).cast("int").alias("_start"))
    base = F.coalesce(F.sum(F.col("_runs") + F.col("_start")).over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_start")
    counted = marked.withColumn("_within", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return counted.join(starts.select("_part", base.alias("_base")), "_part").select(*df.columns, (F.col("_base") + F.col("_within")).alias("run_id"))


def ordered_list(value: str | Column, *order: str) -> Column:
    """An aggregate: the group's values in the given order. For groups of bounded size."""
    v = F.col(value) if isinstance(value, str) else value
    items = F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], v.alias("_v"))))
    return F.transform(items, lambda s: s["_v"])


def group_collect(df: DataFrame, keys: list[str], value: str, *order: str, name: str = "items") -> DataFrame:
    return df.groupBy(*keys).agg(ordered_list(value, *order).alias(name))


def unique_only(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys occur once; all rows of repeated keys go. Null keys equal each other.

    Counting shuffles only keys, and combines before the shuffle, so a hot key is no large group.
    """
    first = F.first(F.struct(*df.columns), ignorenulls=False)
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), first.alias("_row"))
    return counted.filter("_n = 1").select("_row.*")


def dominant_share(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, dominant_share``: how much of a group its most frequent value holds."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg((F.max("_n") / F.sum("_n")).alias("dominant_share"))


def inverted_index(df: DataFrame, item: str, term: str) -> DataFrame:
    """``term, items``: the distinct items of each term, sorted, as one list: for terms of bounded frequency. See ``packing.posting_lists``."""
    return df.select(term, item).distinct().groupBy(term).agg(F.array_sort(F.collect_list(item)).alias("items"))


def top_and_bottom(df: DataFrame, name: str, count: str, k: int) -> DataFrame:
    """``end, place`` and the k most and k least frequent names; ties by name."""
    ends = []
    for end, order in (("top", [F.desc(count), F.asc(name)]), ("bottom", [F.asc(count), F.asc(name)])):
        few = df.orderBy(*order).limit(k)
        ends.append(few.withColumn("place", F.row_number().over(Window.orderBy(*order))).select(F.lit(end).alias("end"), "place", name, count))  # k rows
    return ends[0].unionByName(ends[1])


def rank_curve(df: DataFrame, count: str) -> DataFrame:
    """``first_rank, n_items, count``: the curve of counts in falling order, one row for each level of the count.

    Ranks run over levels, of which there are few, not over items.
    """
    levels = df.groupBy(count).agg(F.count(F.lit(1)).alias("n_items"))
    before = Window.orderBy(F.desc(count)).rowsBetween(Window.unboundedPreceding, -1)
    return levels.select((F.coalesce(F.sum("n_items").over(before), F.lit(0)) + 1).alias("first_rank"), "n_items", count)
