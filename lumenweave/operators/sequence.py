"""Records as conversation turns, and turns as token sequences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.functions.arrays import MASKED_LABEL, PADDING, pad
from lumenweave.functions.text import answer_letter, fill_placeholders, format_bbox, format_text, strip, without_image_mark
from lumenweave.operators.validate import has_payload, validate

EOS = "<|endoftext|>"
#: The prompt of each task. Fixed values.
PROMPTS = {
    "grounded_captioning": "Provide a one-sentence caption for the image and mention each entity.",
    "captioning": "Provide a one-sentence caption for the provided image.",
    "vqa": "Answer the question using a single word or phrase.",
    "multiple_choice_vqa": "Answer with the option's letter from the given choices directly.",
    "grounded_multiple_choice_vqa": "Answer with the option's letter from the given choices directly.",
    "dense_captioning": "Provide a short description of the region:",
    "visual_grounding": "Locate the region that is described by:",
    "image_text_match": "Determine if the image matches the description:",
}
#: Corpora whose questions keep their case.
CASED = ("docvqa", "infographics_vqa")


def _turn(text: Column, target: bool | Column = False) -> Column:
    return F.struct(text.alias("text"), (F.lit(target) if isinstance(target, bool) else target).alias("is_target"))


def _prompt(task: str, end: str = "\n") -> Column:
    return F.array(_turn(F.lit(PROMPTS[task] + end)))


def turns_captioning(caption: Column, prompt: Column | None = None) -> Column:
    """The prompt, or the record's own one, and the caption with the end mark."""
    own = F.coalesce(without_image_mark(prompt), F.lit(PROMPTS["captioning"])) if prompt is not None else F.lit(PROMPTS["captioning"])
    return F.array(_turn(F.concat(own, F.lit("\n"))), _turn(F.concat(format_text(caption), F.lit(EOS)), True))


def turns_grounded_captioning(caption: Column, boxes: Column) -> Column:
    """The caption's placeholders become boxes."""
    filled = fill_placeholders(format_text(caption), F.transform(boxes, lambda b: format_bbox(b, punctuated=False)))
    return F.concat(_prompt("grounded_captioning"), F.array(_turn(F.concat(filled, F.lit(EOS)), True)))


def turns_dense(regions: Column, *, with_answers: bool) -> Column:
    """Each box, then its phrase; the end mark follows the last phrase."""
    if not with_answers:
        return F.concat(_prompt("dense_captioning"), F.transform(regions, lambda r: _turn(F.concat(format_bbox(r["bbox"]), F.lit("\n")))))

    def one(r: Column, i: Column) -> Column:
        end = F.when(i == F.size(regions) - 1, F.lit("\n" + EOS)).otherwise(F.lit("\n"))
        return F.array(_turn(F.concat(format_bbox(r["bbox"]), F.lit("\n"))), _turn(F.concat(format_text(r["phrase"]), end), True))

    return F.concat(_prompt("dense_captioning"), F.flatten(F.transform(regions, one)))


def turns_grounding(regions: Column, *, with_answers: bool) -> Column:
    """Each phrase, then its box with the end mark."""
    if not with_answers:
        return F.concat(_prompt("visual_grounding", ""), F.transform(regions, lambda r: _turn(format_text(r["phrase"]))))

    def one(r: Column) -> Column:
        return F.array(_turn(F.concat(F.lit("\n"), format_text(r["phrase"]), F.lit("\n"))), _turn(F.concat(format_bbox(r["bbox"]), F.lit(EOS)), True))

    return F.concat(_prompt("visual_grounding", ""), F.flatten(F.transform(regions, one)))


def turns_chat(chat: Column, *, with_answers: bool) -> Column:
    """The turns as they are, formatted; the model's are targets, and the last one carries the end mark."""

    def one(t: Column, i: Column) -> Column:
        text = format_text(t["text"])
        text = F.when(i == 0, without_image_mark(text)).otherwise(text)
        last = F.when((i == F.size(chat) - 1) & F.lit(with_answers), F.lit("\n" + EOS)).otherwise(F.lit("\n"))
        return _turn(F.concat(text, last), (t["role"] == "gpt") & F.lit(with_answers))

    return F.transform(chat, one)


def _choice_turns(lines: Column) -> Column:
    lettered = F.transform(F.slice(lines, 1, 26), lambda x, i: F.concat(F.char(i + 65), F.lit(": "), x, F.lit("\n")))
    return F.transform(lettered, lambda x, i: _turn(F.when(i == F.size(lettered) - 1, F.concat(x, F.lit("Answer: "))).otherwise(x)))


def turns_mcq(questions: Column, *, source: Column, ocr_text: Column | None = None, with_answers: bool) -> Column:
    """Multiple choice: ``questions`` is an array of (question, answer, choices); letters stand for choices.

    ai2d questions keep their case; an OCR text follows the prompt.
    """
    prompt = F.lit(PROMPTS["multiple_choice_vqa"])
    if ocr_text is not None:
        prompt = F.when(F.coalesce(ocr_text, F.lit("")) != "", F.concat(prompt, F.lit("\n"), ocr_text)).otherwise(prompt)

    def one(q: Column) -> Column:
        asked = F.when(source == "ai2d", format_text(q["question"], capitalized=False)).otherwise(format_text(q["question"]))
        choices = _choice_turns(F.transform(q["choices"], lambda c: format_text(c, punctuated=False)))
        answer = F.array(_turn(F.concat(answer_letter(q["choices"], q["answer"]), F.lit("." + EOS)), True)) if with_answers else F.array().cast("array<struct<text:string,is_target:boolean>>")
        return F.concat(F.array(_turn(F.concat(F.lit("\nQuestion: "), asked, F.lit("\n")))), choices, answer)

    return F.concat(F.array(_turn(prompt)), F.flatten(F.transform(questions, one)))


def turns_grounded_mcq(questions: Column, regions: Column, *, with_answers: bool) -> Column:
    """Multiple choice between boxes: choices are phrases that name regions."""
    names = F.transform(regions, lambda r: r["phrase"])

    def box(c: Column) -> Column:
        at = F.array_position(names, c).cast("int")
        return format_bbox(F.get(regions, at - 1)["bbox"])

    def one(q: Column) -> Column:
        choices = _choice_turns(F.transform(q["choices"], box))
        answer = F.array(_turn(F.concat(answer_letter(q["choices"], q["answer"]), F.lit("." + EOS)), True)) if with_answers else F.array().cast("array<struct<text:string,is_target:boolean>>")
        return F.concat(F.array(_turn(F.concat(F.lit("\nQuestion: "), format_text(q["question"]), F.lit("\n")))), choices, answer)

    return F.concat(_prompt("grounded_multiple_choice_vqa"), F.flatten(F.transform(questions, one)))


def turns_vqa(qa_pairs: Column, source: Column) -> Column:
    """Each question, and its answer with the end mark; a null or empty answer gives no turn."""

    def formatted(c: Column) -> Column:
        return F.when(source.isin(*CASED), format_text(c, capitalized=False)).otherwise(format_text(c))

    def one(p: Column) -> Column:
        asked = _turn(F.concat(F.lit("\nQuestion: "), formatted(p["question"]), F.lit("\nAnswer: ")))
        return F.when(F.coalesce(p["answer"], F.lit("")) == "", F.array(asked)).otherwise(F.array(asked, _turn(F.concat(formatted(p["answer"]), F.lit(EOS)), True)))

    return F.concat(_prompt("vqa", ""), F.flatten(F.transform(qa_pairs, one)))


def turns_itm(caption: Column, label: Column, *, with_answers: bool) -> Column:
    """The prompt, the caption, and whether they match."""
    asked = F.concat(_prompt("image_text_match"), F.array(_turn(F.concat(format_text(caption), F.lit("\n")))))
    if not with_answers:
        return asked
    answer = F.when(label.cast("boolean"), F.lit("True." + EOS)).otherwise(F.lit("False." + EOS))
    return F.concat(asked, F.array(_turn(answer, True)))


def turns_of(records: DataFrame, *, with_answers: bool = True, name: str = "turns", mode: str = "fail") -> DataFrame:
    """The turns of every record by its task; a task without a template raises.

    A record needs what its task's template shows (questions, a caption, regions, a chat): ``mode`` says what becomes of one
    that lacks it, see ``validate``.
    Multiple choice records have their choices in ``metadata.choices``, image-text pairs their label in ``metadata.label``.
    """
    meta = F.from_json("metadata", "struct<choices:array<string>,label:int,ocr_text:string,prompt:string>")
    needed = has_payload(F.col("task"), F.col("caption"), F.col("region"), F.col("qa_pairs"), F.col("chat"))
    df = validate(records, {"payload": needed}, mode).withColumn("_m", meta)
    questions = F.transform("qa_pairs", lambda p: F.struct(p["question"].alias("question"), p["answer"].alias("answer"), F.col("_m.choices").alias("choices")))
    t, source = F.col("task"), F.col("source")
    boxes = F.transform("region", lambda r: r["bbox"])
    chosen = (
        F.when(t == "vqa", turns_vqa(F.col("qa_pairs"), source))
        .when(t == "captioning", turns_captioning(F.col("caption"), F.col("_m.prompt")))
        .when(t == "grounded_captioning", turns_grounded_captioning(F.col("caption"), boxes))
        .when(t == "dense_captioning", turns_dense(F.col("region"), with_answers=with_answers))
        .when(t == "visual_grounding", turns_grounding(F.col("region"), with_answers=with_answers))
        .when(t == "chat", turns_chat(F.col("chat"), with_answers=with_answers))
        .when(t == "multiple_choice_vqa", turns_mcq(questions, source=source, ocr_text=F.col("_m.ocr_text"), with_answers=with_answers))
        .when(t == "grounded_multiple_choice_vqa", turns_grounded_mcq(questions, F.col("region"), with_answers=with_answers))
        .when(t == "image_text_match", turns_itm(F.col("caption"), F.col("_m.label"), with_answers=with_answers))
        .otherwise(F.raise_error(F.concat(F.lit("no template for task "), F.coalesce(t, F.lit("null")))))
    )
    return df.withColumn(name, chosen).drop("_m")


def word_tokens(text: Column, vocabulary: int = 50_000) -> Column:
    """A deterministic stand-in for a tokenizer: one id for each word, from a hash."""
    words = F.filter(F.split(strip(text), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: (F.pmod(F.crc32(F.encode(w, "utf-8")), F.lit(vocabulary)) + 1).cast("int"))


def byte_tokens(text: Column) -> Column:
    """One id from 1 to 256 for each byte of the text: a tokenizer that can be undone."""
    code = F.hex(F.encode(text, "utf-8"))
    places = F.sequence(F.lit(0), (F.length(code) / 2).cast("int") - 1)
    digits = F.transform(places, lambda i: (F.conv(code.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("int") + 1))
    return F.when(F.length(code) > 0, digits).when(text.isNotNull(), F.array().cast("array<int>"))


def byte_text(ids: Column) -> Column:
    """The text of ``byte_tokens``; ids outside 1 to 256, such as padding and image tokens, are skipped."""
    bytes_ = F.filter(ids, lambda i: (i >= 1) & (i <= 256))
    return F.decode(F.unhex(F.array_join(F.transform(bytes_, lambda i: F.lpad(F.hex(i - 1), 2, "0")), "")), "utf-8")


def tokenized(df: DataFrame, turns: str, tokenizer: object | None = None) -> DataFrame:
    """Adds ``input_ids`` and ``labels`` of the turns, labels masked outside targets.

    ``tokenizer``: any picklable with ``encode(text) -> list of int``; without one, ``word_tokens`` stays in the JVM.
    """
    if tokenizer is None:
        tokens = F.transform(turns, lambda t: word_tokens(t["text"]))
    else:

        @F.pandas_udf("array<array<int>>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield texts.map(lambda ts: None if ts is None else [list(tokenizer.encode(x)) for x in ts])

        tokens = encode(F.transform(turns, lambda t: t["text"]))
    with_tokens = df.withColumn("_tokens", tokens)
    masked = F.zip_with("_tokens", turns, lambda ids, t: F.when(t["is_target"], ids).otherwise(F.transform(ids, lambda _: F.lit(MASKED_LABEL))))
    return with_tokens.withColumn("input_ids", F.flatten("_tokens")).withColumn("labels", F.flatten(masked)).drop("_tokens")


def collate(df: DataFrame, batch: str, fields: list[str], *, side: str = "right") -> DataFrame:
    """Each field padded to its longest array in the batch; rows with a null field go."""
    kept = df.dropna(subset=fields)
    whole = Window.partitionBy(batch)
    for f in fields:
        kept = kept.withColumn(f, pad(F.col(f), F.max(F.size(f)).over(whole), PADDING.get(f, 0), side=side))
    return kept
