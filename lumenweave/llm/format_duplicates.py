"""Records that differ only in how they are written, collapsed into one each.

Every record gets a 128-bit key of its canonical content. Partial counts,
combined on the map side, give each key's exact number of rows and smallest
identifier in one shuffle of 24-byte rows. Keys with many rows are hot: there
are at most ``1 / hot_share`` of them, so they are broadcast. Their rows leave the
other path before anything is shuffled for it, are spread over salts, as many as
their number of rows asks for, and are aggregated on two levels: by salt, then by
key. The rest takes one shuffle join with the few keys that have copies. No group
is ever collected into one task.

Defined cases: null and empty captions, phrases and lists agree; a record whose
metadata does not parse, or that has neither a caption with a visible character
nor a region element, is out of scope; repeated rows of a record count once and
are no copies; two or more equal region elements count as often as they occur;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.metadata import variant
from lumenweave.operators.joins import hot_keys
from lumenweave.storage import write_table

#: What does not count when two texts are compared: white space, punctuation, control and format characters. Symbols count.
_IGNORED = r"[\p{P}\p{Z}\p{Cc}\p{Cf}\s]+"
#: Rows of a hot key that go to one task.
_ROWS_A_SALT = 20_000


def canonical_text(text: Column) -> Column:
    """The text's letters, marks, digits and symbols without case; null as the empty text."""
    # Upper case first, as ß becomes SS; Catalyst would drop it from a direct lower(upper(...)).
    return F.lower(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), _IGNORED, ""))


def _canonical_regions(region: Column) -> Column:
    def one(r: Column) -> Column:
        return F.concat(F.coalesce(F.to_json(r["bbox"]), F.lit("null")), F.lit(" "), canonical_text(r["phrase"]))

    present = F.filter(region, lambda r: r.isNotNull())
    return F.coalesce(F.array_join(F.array_sort(F.transform(present, one)), "\n"), F.lit(""))


def canonical_keys(records: DataFrame) -> DataFrame:
    """``record_id`` and the 128-bit key ``h1, h2`` of every record in scope, one row for each row."""
    visible = F.coalesce(F.regexp_replace("caption", r"[\p{Z}\p{C}\s]+", "") != "", F.lit(False))
    has_region = F.coalesce(F.exists("region", lambda r: r.isNotNull()), F.lit(False))
    scoped = records.filter(visible | has_region).select("record_id", "task", F.col("image")["path"].alias("path"), "caption", "region", variant(F.col("metadata")).alias("v"))
    parts = [
        F.coalesce(F.concat(F.lit("="), F.col("task")), F.lit("")),
        F.coalesce(F.concat(F.lit("="), F.col("path")), F.lit("")),
        canonical_text(F.col("caption")),
        _canonical_regions(F.col("region")),
        F.to_json("v"),  # fields in one order, without formatting
    ]
    # Hashing skips nulls, so no part may be null.
    return scoped.filter("v IS NOT NULL").select("record_id", F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *parts).alias("h2"))


def _salted(rows: DataFrame) -> DataFrame:
    """Adds ``salt``: a key's records are dealt to as many as its rows ``n`` ask for; a record's repeated rows stay together."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.ceil(F.col("n") / _ROWS_A_SALT)))


def collapse(keys: DataFrame, *, hot_share: float = 1e-4, hot_rows: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """``(members, groups)``: ``record_id, kept_id`` of every record that has copies, the kept one included, and
    ``kept_id, n_copies`` of every content that occurs more than once.

    A key is hot with at least ``max(hot_rows, hot_share * rows)`` rows.
    """
    keys = write_table(keys, "canonical-keys")
    same = ["h1", "h2"]
    counted = keys.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("kept_id"), F.max("record_id").alias("last_id"))
    several = write_table(counted.filter("kept_id < last_id").drop("last_id"), "repeated-keys")
    hot = F.broadcast(hot_keys(several.select(*same, F.col("n").alias("_rows"), "n"), "_rows", keys.count(), hot_share=hot_share, hot_rows=hot_rows))
    # Hot keys: two levels over salts.
    hot_once = _salted(keys.join(hot, same)).groupBy(*same, "n", "salt", "record_id").agg(F.count(F.lit(1)).alias("_times"))
    by_salt = hot_once.groupBy(*same, "salt").agg(F.min("record_id").alias("kept_id"), F.count(F.lit(1)).alias("n_copies"))
    hot_groups = write_table(by_salt.groupBy(*same).agg(F.min("kept_id").alias("kept_id"), F.sum("n_copies").alias("n_copies")), "hot-groups")
    hot_members = hot_once.select(*same, "record_id").join(F.broadcast(hot_groups), same)
    # The rest: one level, and no row of a hot key in its shuffle.
    rest = several.join(hot.select(*same), same, "left_anti")
    rest_once = keys.join(hot.select(*same), same, "left_anti").join(rest.select(*same, "kept_id"), same).select("record_id", "kept_id").distinct()
    rest_groups = rest_once.groupBy("kept_id").agg(F.count(F.lit(1)).alias("n_copies"))
    return hot_members.select("record_id", "kept_id").unionByName(rest_once), hot_groups.select("kept_id", "n_copies").unionByName(rest_groups)


def copies(members: DataFrame) -> DataFrame:
    """``kept_id, copy_id``: one row for each record that is not kept."""
    return members.filter("record_id <> kept_id").select("kept_id", F.col("record_id").alias("copy_id"))
