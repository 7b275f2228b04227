"""Curation: phrase frequencies and caps, overlaps of spans, filters and seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.operators.ranking import seeded_hash


def phrase_frequency(df: DataFrame, phrase: str, shard: str, item: str) -> DataFrame:
    """``phrase, n``: distinct items of a phrase within each shard, added up over the shards."""
    return df.select(phrase, shard, item).distinct().groupBy(phrase).agg(F.count(F.lit(1)).alias("n"))


def frequency_cap(df: DataFrame, key: str, item: str, *, lo: int = 3, hi: int = 8, order: Column | None = None, seed: int = 7) -> DataFrame:
    """Keys with fewer than ``lo`` distinct items go; of the others ``hi`` items stay, chosen by a seeded hash.

    ``order`` replaces the hash. Spark's group limit keeps at most ``hi`` rows of a key before the shuffle.
    """
    once = df.select(key, item).distinct()
    enough = once.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= lo).select(key)
    chance = order if order is not None else seeded_hash(item, seed)
    place = Window.partitionBy(key).orderBy(chance, item)
    return once.withColumn("_r", F.row_number().over(place)).filter(F.col("_r") <= hi).drop("_r").join(enough, key, "left_semi")


def overlaps(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """``key, has_overlap``: whether two distinct spans of the key overlap; touching ones do not."""
    spans = df.select(key, start, end).distinct()
    following = F.lead(start).over(Window.partitionBy(key).orderBy(start, end))
    return spans.withColumn("_hit", F.coalesce(F.col(end) > following, F.lit(False))).groupBy(key).agg(F.bool_or("_hit").alias("has_overlap"))


def without_overlaps(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The rows as they are; a key with overlapping spans fails the query."""
    checked = overlaps(df, key, start, end)
    bad = F.assert_true(~F.coalesce(F.col("has_overlap"), F.lit(False)), F.concat(F.lit("overlapping spans of "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return df.join(checked, key, "left").filter(bad.isNull()).drop("has_overlap")


def missing_share(whole: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """``n_missing, percent``: distinct keys that a filter lost, and their share in percent, to two digits."""
    before = whole.select(*keys).distinct()
    after = kept.select(*keys).distinct().withColumn("_kept", F.lit(True))
    joined = before.join(after, keys, "left")
    n = F.count_if(F.col("_kept").isNull())
    return joined.agg(n.alias("n_missing"), F.round(F.try_divide(100.0 * n, F.count(F.lit(1))), 2).alias("percent"))


def small_area(boxes: Column, most: float = 16384) -> Column:
    """The xywh boxes (arrays or structs with w, h) whose area is at most the limit."""
    return F.filter(boxes, lambda b: b["w"] * b["h"] <= most)


def min_size(*sides: Column, least: int) -> Column:
    """Whether no side is below the limit; a null side counts as missing and fails."""
    ok = F.lit(True)
    for s in sides:
        ok = ok & F.coalesce(s >= least, F.lit(False))
    return ok


def hash_split(df: DataFrame, identifier: str, *, share: float = 0.9, seed: int = 11, names: tuple[str, str] = ("train", "validation"), portable: bool = False) -> DataFrame:
    """Adds ``new_split``: the first name for about ``share`` of the identifiers, by a seeded hash; disjoint by construction.

    ``portable`` takes the first 32 bits of the MD5 of ``seed:identifier``, which other engines can compute, too.
    """
    text = F.concat(F.lit(f"{seed}:"), F.col(identifier).cast("string"))
    drawn = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") if portable else seeded_hash(identifier, seed)
    bucket = F.pmod(drawn, F.lit(1_000_000))
    return df.withColumn("new_split", F.when(bucket < int(share * 1_000_000), names[0]).otherwise(names[1]))


def markup(caption: Column, spans: Column) -> Column:
    """The caption with each distinct span written ``||text <coords_k>...||``.

    ``spans``: structs ``start, end`` that do not overlap. Spans go by (start, end); every occurrence of a
    span takes the next placeholder number, and text between spans stays; the text before the last span's end is
    trimmed.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))))
    distinct = F.array_distinct(ordered)
    state = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"), F.lit(0).alias("k"))

    def step(acc: Column, s: Column) -> Column:
        n = F.size(F.filter(ordered, lambda o: o == s))
        marks = F.array_join(F.transform(F.sequence(acc["k"], acc["k"] + n - 1), lambda i: F.concat(F.lit("<coords_"), i.cast("string"), F.lit(">"))), "")
        gap = caption.substr(acc["at"] + 1, s["start"] - acc["at"])
        text = F.concat(acc["text"], gap, F.lit("||"), caption.substr(s["start"] + 1, s["end"] - s["start"]), F.lit(" "), marks, F.lit("||"))
        return F.struct(text.alias("text"), s["end"].alias("at"), (acc["k"] + n).alias("k"))

    done = F.aggregate(distinct, state, step)
    return F.concat(F.trim(done["text"]), caption.substr(done["at"] + 1, F.length(caption)))


def running_offset(df: DataFrame, key: str, start: str, count: str) -> DataFrame:
    """Adds ``offset``: the sum of the counts of the key's rows before this one, in order of start; one sorted pass over each key."""
    before = Window.partitionBy(key).orderBy(start).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("offset", F.sum(count).over(before) - F.col(count))
