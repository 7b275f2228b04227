"""Evaluations as queries: predictions joined with the records they are for, cleaned, and scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions import boxes as B
from lumenweave.functions.text import first_segment, format_text, letter_choices, parse_bbox, truncate_output, unbroken
from lumenweave.operators import grouping, joins, metrics
from lumenweave.operators.sequence import PROMPTS


def prompt_vqa(question: Column, *, ocr_words: Column | None = None, prompt: str = PROMPTS["vqa"]) -> Column:
    """The prompt, read words if given, and the question."""
    asked = F.concat(F.lit("\nQuestion: "), format_text(question), F.lit("\nAnswer: "))
    if ocr_words is None:
        return F.concat(F.lit(prompt), asked)
    return F.concat(F.lit(prompt + "\nOCR text:\n"), F.array_join(ocr_words, " "), asked)


def prompt_choices(question: Column, choices: Column, *, ocr_text: Column | None = None, capitalized: bool = True) -> Column:
    head = F.lit(PROMPTS["multiple_choice_vqa"])
    if ocr_text is not None:
        head = F.when(F.coalesce(ocr_text, F.lit("")) != "", F.concat(head, F.lit("\n"), ocr_text)).otherwise(head)
    return F.concat(head, F.lit("\nQuestion: "), format_text(question, capitalized=capitalized), F.lit("\n"), letter_choices(choices))


def prompt_line(task: str, text: Column) -> Column:
    """The task's prompt and one line of text: phrases to ground, captions to match, plain questions."""
    return F.concat(F.lit(PROMPTS[task] + "\n"), format_text(text), F.lit("\n"))


def clean(prediction: Column, how: str) -> Column:
    """``sentence``: up to the closing stop, lower case; ``cased``: the same, case kept; ``segment``: the first segment; ``line``: up to the end mark;
    ``box``: the same without its last character; ``caption``: up to the end mark, line breaks removed."""
    until = F.substring_index(prediction, "<|endoftext|>", 1)
    return {
        "sentence": truncate_output(prediction), "cased": truncate_output(prediction, lowered=False), "segment": first_segment(prediction),
        "line": F.lower(until), "box": until.substr(F.lit(1), F.length(until) - 1), "caption": unbroken(until),
    }[how]


def scored(truth: DataFrame, predictions: DataFrame, on: str, how: str) -> DataFrame:
    """Truth rows with their cleaned ``prediction``; the last one given for a key counts, a missing one is null.

    ``predictions``: ``on, prediction`` and optionally ``pos``, their order.
    """
    given = predictions.withColumn("prediction", clean(F.col("prediction"), how))
    last = joins.last_wins(given, [on], "pos").select(on, "prediction") if "pos" in given.columns else given.select(on, "prediction")
    return truth.join(last, on, "left")


def evaluate_soft_votes(truth: DataFrame, predictions: DataFrame, *, digits: int = 2, on: str = "question_id") -> DataFrame:
    """``answers``: what ten annotators said; the mean of the soft votes, in percent."""
    rows = scored(truth, predictions, on, "sentence")
    return rows.agg(F.round(F.avg(F.coalesce(metrics.soft_vote(F.col("answers"), F.col("prediction")), F.lit(0.0))) * 100, digits).alias("score"), F.count(F.lit(1)).alias("n"))


def evaluate_exact(truth: DataFrame, predictions: DataFrame, *, on: str = "question_id", by: list[str] | None = None) -> DataFrame:
    """``answer`` against the prediction without case."""
    return metrics.accuracy(scored(truth, predictions, on, "sentence"), metrics.exact_match(F.col("prediction"), F.col("answer")), by=by)


def evaluate_letters(truth: DataFrame, predictions: DataFrame, *, on: str = "question_id", by: list[str] | None = None, how: str = "segment") -> DataFrame:
    """``correct``: the right choice's number from 0."""
    return metrics.accuracy(scored(truth, predictions, on, how), metrics.letter_match(F.col("prediction"), F.col("correct")), by=by)


def evaluate_boxes(truth: DataFrame, predictions: DataFrame, *, on: str = "region_id", threshold: float = 0.5) -> DataFrame:
    """``box`` (pixels), ``width``, ``height``: predicted boxes are shares of the picture; only an overlap above the threshold counts."""
    rows = scored(truth, predictions, on, "box")
    box = B.denormalize(parse_bbox(F.col("prediction")), F.col("width"), F.col("height"))
    return metrics.accuracy(rows, F.coalesce(B.iou(box, F.col("box")) > threshold, F.lit(False)))


def evaluate_yes_no(truth: DataFrame, predictions: DataFrame, negative: str, *, on: str = "question_id", how: str = "line", normalized: bool = False) -> DataFrame:
    """``label``: 0 or 1; anything but the negative answer counts as yes."""
    rows = scored(truth, predictions, on, how).withColumn("_p", metrics.encode_label(F.col("prediction"), negative, normalized=normalized))
    return metrics.binary_metrics(metrics.confusion(rows, "_p", "label"))


def evaluate_captions(references: DataFrame, predictions: DataFrame, *, on: str = "image_id") -> DataFrame:
    """Mean n-gram overlap with the best of a picture's references: ``precision, recall, n``."""
    formatted = references.select(on, format_text(F.col("reference")).alias("reference"))
    candidates = predictions.select(on, clean(F.col("prediction"), "caption").alias("caption"))
    each = metrics.caption_overlap(candidates, formatted, on)
    return each.agg(F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"), F.count(F.lit(1)).alias("n"))


def references_by_picture(captions: DataFrame, key: str, pos: str) -> DataFrame:
    """Each picture's captions in the order in which it is first seen."""
    return captions.groupBy(key).agg(F.min(pos).alias("first_pos"), grouping.ordered_list("caption", pos).alias("references"))
