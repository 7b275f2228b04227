"""Queries of the training-data problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenweave.functions.metadata import fields, picture_key
from lumenweave.llm import bpe, broken_pairs, cross_split, format_duplicates, mixing, related_splits, sequence_packing, text_quality
from lumenweave.storage import read_tables, write_table

# ---------------------------------------------------------------- 1


def memberships(records: DataFrame, targets: DataFrame) -> DataFrame:
    """``record_id, pattern, size``: the targets that each record may serve, by the source and task of its rows; a record whose rows name several may serve each of them."""
    same = {c: mixing.spelled(F.col(c)) for c in ("source", "task")}
    pairs = F.broadcast(targets.select("target_no", same["source"].alias("s"), same["task"].alias("t")))  # a fixed table
    serving = records.select("record_id", same["source"].alias("s"), same["task"].alias("t")).join(pairs, ["s", "t"])
    return serving.groupBy("record_id").agg(F.array_sort(F.collect_set("target_no")).alias("pattern")).withColumn("size", F.lit(1).cast("long"))


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    records, wanted = read_tables(spark, folder, "records", "mix_targets")
    targets = wanted.withColumn("target_no", F.row_number().over(Window.orderBy("source", "task")))  # a fixed table
    chosen, report = mixing.mix(memberships(records, targets), targets)
    return targets, chosen, report


def p1_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Each record of the mixture, the pair it is drawn for and how often it is used."""
    targets, chosen, _ = _mixture(spark, folder)
    return chosen.join(F.broadcast(targets.select("target_no", "source", "task")), "target_no").select("record_id", "source", "task", "n_uses")


def p1_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of the mixture that each listed pair really has."""
    targets, _, report = _mixture(spark, folder)
    return report.join(targets.select("target_no", "source", "task"), "target_no").select("source", "task", "target_share", "actual_share", "n_records", "n_uses")


# ---------------------------------------------------------------- 2


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    (records,) = read_tables(spark, folder, "records")
    members, _ = format_duplicates.collapse(format_duplicates.canonical_keys(records))
    return format_duplicates.copies(members)


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The kept record of each content that occurs several times and its number of copies, itself included."""
    (records,) = read_tables(spark, folder, "records")
    return format_duplicates.collapse(format_duplicates.canonical_keys(records))[1]


# ---------------------------------------------------------------- 3


def _sides(spark: SparkSession, folder: str) -> DataFrame:
    (records,) = read_tables(spark, folder, "records")
    return write_table(cross_split.sides(records), "sides")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return cross_split.found_pairs(cross_split.overlaps(_sides(spark, folder)))


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation records whose picture is in the training side, per split and source."""
    return cross_split.report(_sides(spark, folder), mixing.spelled(F.col("source")))


# ---------------------------------------------------------------- 5


def linking_values(records: DataFrame) -> DataFrame:
    """``record_id``, the distinct ``values`` that link it (its picture key, author, annotator and document, each with a prefix) and its picture's key as ``name``.

    One row for each record; if its repeated rows differ, all their values count.
    """
    # Only a text that may name a field is parsed; a field's name could also be written with escapes.
    named = F.lit(False)
    for text in ("coco_id", "author_name", "annotator_id", "ucsf_document_id", "\\u"):
        named = named | F.contains("metadata", F.lit(text))
    parsed = F.when(F.col("image")["path"].isNull() | named, F.col("metadata"))
    j = fields(parsed, "image_path", "coco_id", "author_name", "annotator_id", "ucsf_document_id")
    r = records.select("record_id", F.col("image")["path"].alias("path"), j.alias("j"))

    def bare(c: str):
        return F.lower(F.regexp_replace(F.upper(F.col("j")[c]), r"[\s\p{Z}]+", ""))

    values = [
        F.concat(F.lit("p:"), picture_key(F.coalesce("path", F.col("j.image_path")), F.col("j.coco_id"))),
        F.concat(F.lit("a:"), bare("author_name")),
        F.concat(F.lit("n:"), F.regexp_replace(F.trim("j.annotator_id"), r"^([0-9]+)\.0+$", "$1")),
        F.concat(F.lit("d:"), F.trim("j.ucsf_document_id")),
    ]
    kept = r.select("record_id", F.filter(F.array_compact(F.array(*values)), lambda v: F.length(v) > 2).alias("v"))
    once = kept.groupBy("record_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("v")))).alias("values"))
    return once.withColumn("name", F.expr("substring(array_min(filter(values, v -> v LIKE 'p:%')), 3)"))


def _grouped(spark: SparkSession, folder: str) -> DataFrame:
    (records,) = read_tables(spark, folder, "records")
    return write_table(related_splits.group_records(write_table(linking_values(records), "linking-values")), "grouped")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return related_splits.named_groups(_grouped(spark, folder))


def p5_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The new split of every record; ``group_key`` is the same for all records of a group."""
    (targets,) = read_tables(spark, folder, "split_targets")
    return related_splits.assign_splits(_grouped(spark, folder), targets).select("record_id", F.col("root").alias("group_key"), "new_split")


def p5_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of the records that each split really has."""
    (targets,) = read_tables(spark, folder, "split_targets")
    return related_splits.shares(related_splits.assign_splits(_grouped(spark, folder), targets), targets)


# ---------------------------------------------------------------- 6


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    records, common = read_tables(spark, folder, "records", "common_words")
    return broken_pairs.defective_pairs(records, common)


# ---------------------------------------------------------------- 7

#: Folder of the public vocabularies.
TOKENIZERS = "/opt/tokenizers"


def p7_ids(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    (documents,) = read_tables(spark, folder, "documents")
    return bpe.encode_texts(documents, "doc_id", "text", f"{tokenizers}/byte_bpe_50k.json")


# ---------------------------------------------------------------- 8


def _packed(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    documents, budgets = read_tables(spark, folder, "documents", "sequence_budgets")
    sizes = write_table(bpe.count_tokens(documents, "doc_id", "text", f"{tokenizers}/byte_bpe_50k.json"), "token-counts")
    return sequence_packing.pack(sizes, budgets), budgets


def p8_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Which tokens of which text lie in which sequence, for every stage."""
    return _packed(spark, folder)[0]


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """How many sequences each stage has and how full they are."""
    return sequence_packing.report(*_packed(spark, folder))


# ---------------------------------------------------------------- 9


def _measured(spark: SparkSession, folder: str) -> DataFrame:
    documents, common = read_tables(spark, folder, "documents", "common_words")
    return text_quality.measure(documents, "doc_id", "text", common)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _measured(spark, folder).filter("kind IS NOT NULL").select("doc_id", "kind")


def p9_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of every text, the published rules that it fails and the rule that gave its kind."""
    return _measured(spark, folder)


QUERIES = {
    "p1_mixture": p1_mixture,
    "p1_shares": p1_shares,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p5_found": p5_found,
    "p5_splits": p5_splits,
    "p5_shares": p5_shares,
    "p6_found": p6_found,
    "p7_ids": p7_ids,
    "p8_sequences": p8_sequences,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_stats": p9_stats,
}

ORACLE: dict[str, str] = {}
