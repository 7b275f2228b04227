"""Joins with the semantics that loaders of annotation corpora need.

Sizes decide how a join runs: Spark broadcasts a side whose measured size is
below its threshold and shuffles both otherwise. No hint overrides that here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.operators.ranking import running_total


def enforced_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which a left row without a match fails the query."""
    marked = right.withColumn("_found", F.lit(True))
    joined = left.join(marked, on, "left")
    checked = F.assert_true(F.col("_found").isNotNull(), F.concat_ws(" ", F.lit("no match for"), *[F.col(c).cast("string") for c in on]))
    return joined.filter(checked.isNull()).drop("_found")


def hot_keys(counted: DataFrame, count: str, rows: int, *, hot_share: float = 1e-4, hot_rows: int = 10_000) -> DataFrame:
    """The keys of ``counted`` with at least ``max(hot_rows, hot_share * rows)`` rows: no more than ``1 / hot_share`` of them."""
    return counted.filter(F.col(count) >= max(hot_rows, int(hot_share * rows))).drop(count)


def split_hot(df: DataFrame, hot: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of hot keys (from ``hot_keys``) and the others; null keys equal each other."""
    few = F.broadcast(hot.select(*[F.col(c).alias(f"_hot_{c}") for c in on]))
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_hot_{c}"))
    return df.join(few, same, "left_semi"), df.join(few, same, "left_anti")


def hot_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key; left rows of hot keys are not shuffled.

    ``hot`` is from ``hot_keys``, so it and its part of ``right`` are small enough to be broadcast. ``how``: inner or left.
    Left rows with a null key have no match.
    """
    hot = F.broadcast(hot.select(*on))
    few = F.broadcast(right.join(hot, on, "left_semi"))
    of_hot = left.join(hot, on, "left_semi").join(few, on, how)
    return of_hot.unionByName(left.join(hot, on, "left_anti").join(right, on, how))


def missing_keys(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left_anti").select(*on)


def last_wins(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """One row for each key: the one with the greatest position."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(pos)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def last_wins_join(left: DataFrame, right: DataFrame, on: list[str], right_pos: str) -> DataFrame:
    return left.join(last_wins(right, on, right_pos), on)


def semi_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on), on, "left_semi")


def anti_join_keep_nulls(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left rows without a match; a null key has none, so its rows stay."""
    return left.join(right.select(*on), on, "left_anti")


def three_way_grouped_join(images: DataFrame, regions: DataFrame, expressions: DataFrame, on: list[str]) -> DataFrame:
    """Images with their grouped regions and grouped expressions; an image without one of them goes."""
    return images.join(regions, on).join(expressions, on)


def numbered(df: DataFrame, pos: str, name: str = "_n") -> DataFrame:
    """Adds a dense number from 0 in the order of a sortable, unique position, by range partitions and their counts."""
    return running_total(df.withColumn("_one", F.lit(1).cast("long")), [pos], "_one", name).drop("_one")


def positional_zip(left: DataFrame, right: DataFrame, left_pos: str, right_pos: str, *, check: list[str] | None = None) -> DataFrame:
    """Rows at the same place of two ordered tables side by side.

    Different numbers of rows fail, as do rows whose ``check`` columns differ.
    Column names must be distinct but for the checked ones.
    """
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} rows on the left and {b} on the right")
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in (check or []) else F.col(c) for c in right.columns])
    joined = numbered(left, left_pos).join(numbered(renamed, right_pos), "_n").drop("_n")
    for c in check or []:
        same = F.assert_true(F.col(c).eqNullSafe(F.col(f"_right_{c}")), F.lit(f"{c} differs between the two sides"))
        joined = joined.filter(same.isNull()).drop(f"_right_{c}")
    return joined


def lookup_elements(ids: Column, table: Column) -> Column:
    """Each id of an array replaced by its value in a map of the row itself; null where it has none."""
    return F.transform(ids, lambda i: F.try_element_at(table, i))


def lookup_in_table(df: DataFrame, keys: list[str], ids: str, table: DataFrame, id_column: str, value: str, name: str = "values") -> DataFrame:
    """``keys, name``: the array's ids replaced, in order, by their values in a table with one row for each id; null where it has none.

    ``keys`` identify a row. The table may have any size: ids are exploded, joined and collected again.
    """
    each = df.select(*keys, F.posexplode_outer(ids).alias("_place", "_id"))
    found = each.join(table.select(F.col(id_column).alias("_id"), F.col(value).alias("_value")), "_id", "left")
    listed = F.array_sort(F.collect_list(F.when(F.col("_place").isNotNull(), F.struct("_place", "_value"))))
    return found.groupBy(*keys).agg(listed.alias("_l")).select(*keys, F.col("_l")["_value"].alias(name))


def first_existing(df: DataFrame, candidates: list[Column], listing: DataFrame, path: str, *, required: bool = False) -> DataFrame:
    """Adds ``found_path``: the first candidate that the listing has. ``required`` fails on a row without one.

    Every distinct candidate is looked up once; rows, equal ones too, are never merged, and their columns may have any type.
    """
    asked = df.select(F.explode(F.array_compact(F.array(*candidates))).alias("_path")).distinct()
    known = listing.select(F.col(path).alias("_path")).distinct().join(asked, "_path", "left_semi").withColumn("_is", F.lit(True))
    out = df
    for i, c in enumerate(candidates):
        out = out.withColumn(f"_c{i}", c)
    for i in range(len(candidates)):
        out = out.join(known.select(F.col("_path").alias(f"_c{i}"), F.col("_is").alias(f"_is{i}")), f"_c{i}", "left")
    found = F.coalesce(*[F.when(F.col(f"_is{i}"), F.col(f"_c{i}")) for i in range(len(candidates))])
    out = out.select(*df.columns, found.alias("found_path"))
    if required:
        out = out.filter(F.assert_true(F.col("found_path").isNotNull(), F.lit("no candidate path exists")).isNull())
    return out


def union_all(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables, duplicates kept, columns by name; a missing column is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def key_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of the left table that the right one lacks; null is a key like any other."""
    return left.select(*keys).subtract(right.select(*keys))
