"""Row multipliers: choices swapped or inserted, lists exploded and transposed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.operators.grouping import ordered_list


def swapped(choices: Column, correct: Column, slot: Column) -> Column:
    """The choices with the right one (index from 0) and the one in the slot exchanged."""
    return F.transform(choices, lambda c, j: F.when(j == slot, F.get(choices, correct)).when(j == correct, F.get(choices, slot)).otherwise(c))


def swap_choices(df: DataFrame, choices: str, correct: str) -> DataFrame:
    """One row for each slot: ``slot`` and the choices with the right one swapped into it."""
    rest = [c for c in df.columns if c not in (choices, correct)]
    slots = df.filter(F.size(choices) > 0).select("*", F.explode(F.sequence(F.lit(0), F.size(choices) - 1)).alias("slot"))
    return slots.select(*rest, "slot", swapped(F.col(choices), F.col(correct).cast("int"), F.col("slot")).alias(choices))


def insert_choice(df: DataFrame, choices: str, answer: str) -> DataFrame:
    """One row for each of the n + 1 places: ``slot`` and the wrong choices with the answer put in."""
    rest = [c for c in df.columns if c != choices]
    slots = df.select("*", F.explode(F.sequence(F.lit(0), F.size(choices))).alias("slot"))
    c, s = F.col(choices), F.col("slot")
    filled = F.concat(F.slice(c, F.lit(1), s), F.array(F.col(answer)), F.slice(c, s + 1, F.size(c)))
    return slots.select(*rest, "slot", filled.alias(choices))


def zipped(first: Column, second: Column) -> Column:
    """Pairs of two arrays up to the shorter one's length."""
    n = F.least(F.size(first), F.size(second))
    return F.arrays_zip(F.slice(first, F.lit(1), n).alias("a"), F.slice(second, F.lit(1), n).alias("b"))


def transpose(df: DataFrame, keys: list[str], outer: str, inner: str, item: str) -> DataFrame:
    """Items listed by ``inner`` instead of ``outer``: one row for each key and inner place, in outer order."""
    return df.groupBy(*keys, inner).agg(ordered_list(item, outer).alias("items"))


def regions_from_chunks(chunks: Column, caption: Column, width: Column, height: Column) -> Column:
    """``(start, end, x1, y1, x2, y2)`` chunks as regions in order of their spans: a box in pixels and its numbered phrase."""
    ordered = F.array_sort(chunks)
    w, h = width.cast("double"), height.cast("double")

    def one(c: Column, i: Column) -> Column:
        box = F.array(c["x1"] * w, c["y1"] * h, c["x2"] * w, c["y2"] * h)
        phrase = caption.substr(c["start"].cast("int") + 1, (c["end"] - c["start"]).cast("int"))
        return F.struct(box.alias("bbox"), phrase.alias("phrase"), i.alias("number"))

    return F.transform(ordered, one)


def explode_regions(df: DataFrame, regions: str, split: str, test_splits: list[str]) -> DataFrame:
    """One row for each region in the test splits; one row with all of them elsewhere. ``regions`` stays an array."""
    rest = [c for c in df.columns if c != regions]
    single = F.transform(F.col(regions), lambda r: F.array(r))
    lists = F.when(F.col(split).isin(*test_splits), single).otherwise(F.array(F.col(regions)))
    return df.select(*rest, F.posexplode(lists).alias("part", regions))
