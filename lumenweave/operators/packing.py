"""Packing rows and arrays into chunks of bounded size, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.operators.grouping import ordered_list
from lumenweave.operators.joins import hot_keys, split_hot
from lumenweave.operators.ranking import number_in_group, running_total


#: Rows of one key that a window may number in one task; beyond it a key is numbered over range partitions.
ROWS_A_KEY = 1_000_000


def numbered_in_key(df: DataFrame, keys: list[str], order: list[str], name: str, *, rows_a_key: int | None = None) -> DataFrame:
    """Adds ``name``: 1, 2, ... of each key's rows in the given order, which must be total.

    One shuffle by key; only keys whose counted rows exceed ``rows_a_key`` take the way over range partitions.
    """
    limit = ROWS_A_KEY if rows_a_key is None else rows_a_key
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows, most = counted.agg(F.sum("_n"), F.max("_n")).first()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    if (most or 0) <= limit:
        return df.withColumn(name, place)
    hot, rest = split_hot(df, hot_keys(counted, "_n", rows, hot_share=0.0, hot_rows=limit + 1), keys)
    return rest.withColumn(name, place).unionByName(number_in_group(hot, keys, order, name))


def pack(df: DataFrame, keys: list[str], order: list[str], max_items: int, item: str | Column, *, rows_a_key: int | None = None) -> DataFrame:
    """``keys, chunk, items``: at most ``max_items`` items of a key in each chunk, in order.

    The lists that are collected hold ``max_items`` items at most. ``rows_a_key``: see ``numbered_in_key``.
    """
    value = F.col(item) if isinstance(item, str) else item
    narrow = df.select(*keys, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], value.alias("_v"))
    numbered = numbered_in_key(narrow, keys, [f"_o{i}" for i in range(len(order))], "_n", rows_a_key=rows_a_key)
    chunked = numbered.withColumn("chunk", F.floor((F.col("_n") - 1) / max_items))
    return chunked.groupBy(*keys, "chunk").agg(ordered_list("_v", "_n").alias("items"))


def posting_lists(df: DataFrame, term: str, item: str, max_items: int) -> DataFrame:
    """``term, chunk, items``: the distinct items of each term, sorted, in lists of at most ``max_items``, however frequent it is."""
    return pack(df.select(term, item).distinct(), [term], [item], max_items, item)


def array_chunks(items: Column, max_items: int) -> Column:
    """The array cut into arrays of at most ``max_items``; an empty array gives none."""
    starts = F.sequence(F.lit(0), F.size(items) - 1, F.lit(max_items))
    return F.when(F.size(items) > 0, F.transform(starts, lambda s: F.slice(items, s + 1, F.lit(max_items)))).otherwise(F.array())


def pack_array(df: DataFrame, column: str, max_items: int) -> DataFrame:
    """One row for each chunk of the array: the row's columns, ``chunk`` and ``items``."""
    rest = [c for c in df.columns if c != column]
    return df.filter(F.size(column) > 0).select(*rest, F.posexplode(array_chunks(F.col(column), max_items)).alias("chunk", "items"))


def unpack(df: DataFrame, column: str, pos_name: str = "pos", item_name: str = "item") -> DataFrame:
    """One row for each item, with its place in the array from 0; rows without items go."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(column).alias(pos_name, item_name))


def unpack_index(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``unpack`` with a dense global ``index`` in the order of (keys, place). The keys must be unique."""
    placed = running_total(df.select(*keys, column).withColumn("_size", F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0))), keys, "_size", "_before")
    items = placed.select(*keys, "_before", F.posexplode(column).alias("pos", "item"))
    return items.select(*keys, "pos", "item", (F.col("_before") + F.col("pos")).alias("index"))


def repack(df: DataFrame, key: str, pos: str) -> DataFrame:
    """``key, first_pos, positions``: the positions of each key as one list, with the place of its first for ordering; keys of bounded size.

    ``posting_lists`` gives the positions of keys of any size in chunks.
    """
    return df.groupBy(key).agg(F.min(pos).alias("first_pos"), F.array_sort(F.collect_list(pos)).alias("positions"))
