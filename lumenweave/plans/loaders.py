"""Annotation corpora as records: each loader composes the operators over the source's tables.

Every loader takes DataFrames (see ``lumenweave.sources`` for reading them) and
returns the nine columns of the record. Where files have an order that matters,
the source has a position column, ``pos``. Answers are null where a split
withholds them. Paths are built by a function of the picture's id.

Where a source promises something of its rows (ten answers, two turns, whole boxes), ``mode``
says what becomes of a row that breaks it: ``fail`` ends the query, ``skip`` leaves the row out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions import boxes as B
from lumenweave.functions.text import numbered_image, ocr_context, upper_first
from lumenweave.operators import augment, curation, grouping, joins, packing, traces, validate
from lumenweave.schema import pack_metadata, to_record

PathOf = Callable[[Column], Column]


def in_folder(folder: str, extension: str = "") -> PathOf:
    return lambda name: F.concat(F.lit(folder.rstrip("/") + "/"), name.cast("string"), F.lit(extension))


def coco_path(folder: str) -> PathOf:
    return lambda number: F.concat(F.lit(folder.rstrip("/") + "/"), numbered_image(number))


def _image(path: Column) -> Column:
    return F.struct(path.alias("path"), F.lit(None).cast("binary").alias("bytes"))


def _pair(question: Column, answer: Column) -> Column:
    return F.struct(question.cast("string").alias("question"), answer.cast("string").alias("answer"))


def _no_answer() -> Column:
    return F.lit(None).cast("string")


def _vote(answers: Column) -> Column:
    """The most frequent element of an array, the first seen among equals."""
    counted = F.transform(F.array_distinct(answers), lambda a: F.struct(F.size(F.filter(answers, lambda x: x.eqNullSafe(a))).alias("n"), (-F.array_position(answers, a)).alias("p"), a.alias("a")))
    return F.array_max(counted)["a"]


def _packed_questions(questions: DataFrame, keys: list[str], order: list[str], most: int | None, pair: Column, **details: Column) -> DataFrame:
    """Questions of a key packed into rows of at most ``most``: ``keys, chunk, qa_pairs`` and an array for each detail."""
    item = F.struct(pair.alias("pair"), *[v.alias(k) for k, v in details.items()])
    packed = packing.pack(questions.withColumn("_item", item), keys, order, most or 2**31 - 1, "_item")
    return packed.select(*keys, "chunk", F.transform("items", lambda i: i["pair"]).alias("qa_pairs"), *[F.col("items")[k].alias(k) for k in details])


def _in_runs(questions: DataFrame, key: str) -> DataFrame:
    """Adds ``run_id``: the runs of one picture's questions in the order of ``pos``, the row's unique place in the file. Only keys and places are sorted."""
    runs = grouping.run_groups(questions.select(F.col("pos").alias("_pos"), F.col(key).alias("_key")), "_key", "_pos")
    return questions.join(runs.select(F.col("_pos").alias("pos"), "run_id"), "pos")


#: How many annotators answered each question. Fixed value.
ANNOTATORS = 10


def _ten(answers: Column) -> dict[str, Column]:
    return {"ten_answers": validate.exactly(answers, ANNOTATORS)}


def vqa_v2(questions: DataFrame, answers: DataFrame | None, path: PathOf, *, most: int = 20, source: str = "vqa_v2", mode: str = "fail") -> DataFrame:
    """Runs of questions of one picture, at most ``most`` in a record; the answer is the annotators' vote.

    ``questions`` has ``pos``, its place in the file: a picture that comes again after another one starts a new record.
    A question needs ten answers. Without answers, as in test splits, every question is a record.
    """
    if answers is None:
        rows = questions.select("image_id", "question_id", F.array(_pair(F.col("question"), _no_answer())).alias("qa_pairs"))
        meta = pack_metadata(image_id=F.col("image_id"), question_ids=F.array("question_id"), image_path=path(F.col("image_id")))
        return to_record(rows, task=F.lit("vqa"), source=F.lit(source), image=_image(path(F.col("image_id"))), qa_pairs=F.col("qa_pairs"), metadata=meta)
    sound = validate.validate(answers, _ten(F.col("answers")), mode)
    last = sound.select("question_id", "question_type", "answer_type", F.transform("answers", lambda a: a["answer"]).alias("answers"))
    known = questions if mode == "fail" else joins.semi_join(questions, last, ["question_id"])
    joined = joins.enforced_join(_in_runs(known, "image_id"), last, ["question_id"])
    packed = _packed_questions(
        joined, ["image_id", "run_id"], ["pos"], most, _pair(F.col("question"), _vote(F.col("answers"))),
        question_ids=F.col("question_id"), question_types=F.col("question_type"), answer_types=F.col("answer_type"), answers=F.col("answers"),
    )
    p = path(F.col("image_id"))
    meta = pack_metadata(image_id=F.col("image_id"), **{k: F.col(k) for k in ("question_ids", "question_types", "answer_types", "answers")}, image_path=p)
    return to_record(packed, task=F.lit("vqa"), source=F.lit(source), image=_image(p), qa_pairs=F.col("qa_pairs"), metadata=meta)


def gqa(questions: DataFrame, path: PathOf, *, short: bool = True, balanced: bool | None = None, most: int | None = 20) -> DataFrame:
    """Questions grouped by picture; short or full answers; only balanced questions if asked. ``most=1`` for test splits."""
    kept = questions if balanced is None else questions.filter(F.col("is_balanced") == balanced)
    answer = F.col("answer") if short else F.col("full_answer")
    packed = _packed_questions(kept, ["image_id"], ["question_id"], most, _pair(F.col("question"), answer), question_ids=F.col("question_id"), is_balanced=F.col("is_balanced"), full_answer=F.col("full_answer"))
    p = path(F.col("image_id"))
    meta = pack_metadata(image_id=F.col("image_id"), **{k: F.col(k) for k in ("question_ids", "is_balanced", "full_answer")}, use_short_answer=F.lit(short), image_path=p)
    return to_record(packed, task=F.lit("vqa"), source=F.lit("gqa"), image=_image(p), qa_pairs=F.col("qa_pairs"), metadata=meta)


def _run_vqa(questions: DataFrame, key: str, source: str, path: PathOf, *, most: int | None, raised: bool, details: list[str]) -> DataFrame:
    """Runs of questions of one picture in file order with voted answers; a null list of answers gives null."""
    question = upper_first(F.col("question")) if raised else F.col("question")
    packed = _packed_questions(_in_runs(questions, key), [key, "run_id"], ["pos"], most, _pair(question, _vote(F.col("answers"))), **{d: F.col(d) for d in details}, answers=F.col("answers"))
    p = path(F.col(key))
    meta = pack_metadata(**{d: F.col(d) for d in details}, answers=F.col("answers"), image_path=p)
    return to_record(packed, task=F.lit("vqa"), source=F.lit(source), image=_image(p), qa_pairs=F.col("qa_pairs"), metadata=meta)


def text_vqa(questions: DataFrame, ocr: DataFrame, path: PathOf, *, most: int | None = None, mode: str = "fail") -> DataFrame:
    """``ocr``: ``image_id, ocr_info, pos``; the last row of a picture counts. Ten answers, or none where they are withheld."""
    withheld = {name: F.col("answers").isNull() | rule for name, rule in _ten(F.col("answers")).items()}
    joined = joins.last_wins_join(validate.validate(questions, withheld, mode), ocr.withColumnRenamed("pos", "ocr_pos"), ["image_id"], "ocr_pos")
    return _run_vqa(joined, "image_id", "text_vqa", path, most=most, raised=False, details=["question_id", "ocr_info"])


def docvqa(questions: DataFrame, path: PathOf, *, most: int | None = None) -> DataFrame:
    return _run_vqa(questions, "image", "docvqa", path, most=most, raised=True, details=["question_id", "doc_id", "ucsf_document_id", "ucsf_document_page_no"])


def infographics_vqa(questions: DataFrame, path: PathOf, *, most: int | None = None) -> DataFrame:
    return _run_vqa(questions, "image", "infographics_vqa", path, most=most, raised=False, details=["question_id", "image_url", "ocr_output_file"])


def vizwiz(questions: DataFrame, path: PathOf) -> DataFrame:
    """One question for each picture, with the annotators' vote."""
    votes = F.transform("answers", lambda a: a["answer"])
    p = path(F.col("image"))
    meta = pack_metadata(answerable=F.col("answerable"), answers=F.array("answers"), image_path=p)
    return to_record(questions, task=F.lit("vqa"), source=F.lit("vizwiz_vqa"), image=_image(p), qa_pairs=F.array(_pair(F.col("question"), _vote(votes))), metadata=meta)


def _caption(rows: DataFrame, source: str, path: Column, caption: Column, **details: Column) -> DataFrame:
    return to_record(rows, task=F.lit("captioning"), source=F.lit(source), image=_image(path), caption=caption, metadata=pack_metadata(**details, image_path=path))


def text_caps(captions: DataFrame, ocr: DataFrame, path: PathOf) -> DataFrame:
    joined = joins.last_wins_join(captions, ocr.withColumnRenamed("pos", "ocr_pos"), ["image_id"], "ocr_pos")
    return _caption(joined, "text_caps", path(F.col("image_id")), F.col("caption_str"), image_id=F.col("image_id"), caption_id=F.col("caption_id"), ocr=F.col("ocr_info"))


def coco(images: DataFrame, split: str, path: PathOf) -> DataFrame:
    """One record for each caption; ``images`` has ``cocoid, split, sentids, sentences`` (array of texts)."""
    kept = images.filter(F.when(F.col("split") == "restval", "train").when(F.col("split") == "val", "validation").otherwise(F.col("split")) == split)
    rows = kept.select("cocoid", F.inline(augment.zipped(F.col("sentids"), F.col("sentences"))))
    return _caption(rows, "coco", path(F.col("cocoid")), F.col("b"), coco_id=F.col("cocoid"), caption_id=F.col("a"))


#: Codes of the splits in the book covers' file. Fixed values.
OCR_VQA_SPLITS = {"train": 1, "validation": 2, "test": 3}


def ocr_vqa(books: DataFrame, keep: DataFrame, split: str, path: PathOf, *, mode: str = "fail") -> DataFrame:
    """Covers whose url is unique and whose picture is kept; ``keep``: ``image_url, keep``. A url without an entry fails. As many answers as questions."""
    sound = validate.validate(books, {"same_length": validate.same_length(F.col("questions"), F.col("answers"))}, mode)
    once = grouping.unique_only(sound.filter(F.col("split") == OCR_VQA_SPLITS[split]), ["image_url"])
    kept = joins.enforced_join(once, keep, ["image_url"]).filter("keep").filter(F.size("questions") > 0)
    pairs = F.transform(augment.zipped(F.col("questions"), F.col("answers")), lambda z: _pair(z["a"], z["b"]))
    p = path(F.col("id"))
    meta = pack_metadata(**{k: F.col(k) for k in ("id", "image_url", "title", "author_name", "genre")}, image_path=p)
    return to_record(kept, task=F.lit("vqa"), source=F.lit("ocr_vqa"), image=_image(p), qa_pairs=pairs, metadata=meta)


def _choice_records(rows: DataFrame, source: str, path: Column, **details: Column) -> DataFrame:
    """``question, answer, choices`` rows as multiple choice records."""
    meta = pack_metadata(**details, answers=F.array("choices"), choices=F.col("choices"), image_path=path)
    return to_record(rows, task=F.lit("multiple_choice_vqa"), source=F.lit(source), image=_image(path), qa_pairs=F.array(_pair(F.col("question"), F.col("answer"))), metadata=meta)


def _swapped(rows: DataFrame, choices: str, correct: str) -> DataFrame:
    """A row for each slot of the right answer where it is known; one row, without answer, elsewhere."""
    known = rows.filter(F.col(correct).isNotNull()).withColumn("answer", F.get(F.col(choices), F.col(correct).cast("int")))
    swapped = augment.swap_choices(known, choices, correct)
    return swapped.unionByName(rows.filter(F.col(correct).isNull()).drop(correct).withColumn("answer", _no_answer()).withColumn("slot", F.lit(None).cast("int")))


def aok_vqa(questions: DataFrame, path: PathOf, patches: dict[str, list[str]] | None = None) -> DataFrame:
    """``patches``: choices of single questions that the source has wrong."""
    rows = questions
    for question_id, choices in (patches or {}).items():
        rows = rows.withColumn("choices", F.when(F.col("question_id") == question_id, F.array(*[F.lit(c) for c in choices])).otherwise(F.col("choices")))
    swapped = _swapped(rows.select("image_id", "question_id", "question", "choices", "correct_choice_idx", "rationales"), "choices", "correct_choice_idx")
    return _choice_records(swapped, "aok_vqa", path(F.col("image_id")), question_id=F.col("question_id"), correct_choice_idx=F.col("slot"), rationales=F.col("rationales"))


def ai2d(images: DataFrame, annotations: DataFrame, test_ids: DataFrame, split: str, path: PathOf, *, share: float = 0.9, seed: int = 11) -> DataFrame:
    """Diagrams: test ids are listed, the others split by a seeded hash; ``annotations``: ``image_name, tokens`` (key, value)."""
    ids = images.select("image_name")
    if split == "test":
        chosen = joins.semi_join(ids, test_ids, ["image_name"])
    else:
        train = joins.anti_join_keep_nulls(ids, test_ids, ["image_name"])
        chosen = curation.hash_split(train, "image_name", share=share, seed=seed).filter(F.col("new_split") == split).select("image_name")
    asked = joins.semi_join(images, chosen, ["image_name"]).select("image_name", F.explode("questions").alias("q"))
    rows = asked.select("image_name", "q.question", "q.question_id", F.col("q.answers").alias("choices"), (F.lit(None).cast("int") if split == "test" else F.col("q.correct_answer")).alias("correct"))
    text = annotations.select("image_name", ocr_context(F.col("tokens")).alias("ocr_text"))
    joined = _swapped(rows, "choices", "correct").join(text, "image_name", "left")
    return _choice_records(joined, "ai2d", path(F.col("image_name")), question_id=F.col("question_id"), ocr_text=F.coalesce("ocr_text", F.lit("")))


def visual7w(images: DataFrame, split: str, path: PathOf, *, boxes: DataFrame | None = None, per_turn: int = 3) -> DataFrame:
    """Questions with the answer put at every place among the wrong choices, ``per_turn`` of one place in a record.

    ``images``: ``image_id, split, filename, width, height, qa_pairs`` (question, answer, multiple_choices). With ``boxes``
    (``box_id, x, y, width, height``) choices are boxes and the records point; else they tell.
    """
    kept = images.filter(F.when(F.col("split") == "val", "validation").otherwise(F.col("split")) == split)
    asked = kept.select("image_id", "filename", "width", "height", F.posexplode("qa_pairs").alias("pos", "q"))
    rows = asked.select("image_id", "filename", "width", "height", "pos", "q.question", F.col("q.answer").cast("string").alias("answer"), F.col("q.multiple_choices").cast("array<string>").alias("choices"))
    placed = augment.insert_choice(rows, "choices", "answer")
    if split == "test":
        placed = placed.filter(F.pmod(F.xxhash64("image_id", "pos"), F.size("choices")) == F.col("slot"))
    item = placed.withColumn("_item", F.struct(_pair(F.col("question"), F.col("answer")).alias("pair"), F.col("choices").alias("choices")))
    packed = packing.pack(item, ["image_id", "filename", "width", "height", "slot"], ["pos"], 1 if split == "test" else per_turn, "_item")
    out = packed.select("image_id", "filename", "width", "height", "slot", "chunk", F.col("items")["pair"].alias("qa_pairs"), F.col("items")["choices"].alias("answers"))
    p = path(F.col("filename"))
    common = {"source": F.lit("visual7w pointing" if boxes is not None else "visual7w telling"), "image": _image(p), "qa_pairs": F.col("qa_pairs")}
    meta = pack_metadata(image_id=F.col("image_id"), slot=F.col("slot"), answers=F.col("answers"), image_path=p)
    if boxes is None:
        return to_record(out, task=F.lit("multiple_choice_vqa"), metadata=meta, **common)
    used = out.select("image_id", "slot", "chunk", F.explode(F.array_distinct(F.flatten("answers"))).alias("box_id"))
    sized = used.join(boxes.withColumn("box_id", F.col("box_id").cast("string")).withColumnsRenamed({"width": "w", "height": "h"}), "box_id").join(images.select("image_id", "width", "height"), "image_id")
    box = B.xywh_to_xyxy(B.clamp_xywh(F.array("x", "y", "w", "h"), F.col("width"), F.col("height")))
    listed = sized.groupBy("image_id", "slot", "chunk").agg(F.array_sort(F.collect_list(F.struct(F.col("box_id").alias("phrase"), box.cast("array<float>").alias("bbox")))).alias("r"))
    regions = F.transform("r", lambda x: F.struct(x["bbox"].alias("bbox"), x["phrase"].alias("phrase")))
    return to_record(out.join(listed, ["image_id", "slot", "chunk"]), task=F.lit("grounded_multiple_choice_vqa"), region=regions, metadata=meta, **common)


def refcoco(images: DataFrame, regions: DataFrame, expressions: DataFrame, split: str, path: PathOf, *, source: str = "refcoco", task: str = "visual_grounding", mode: str = "fail") -> DataFrame:
    """Regions with their last expression, all of a picture in one record; each alone in test splits. A box has four coordinates, none negative.

    ``regions``: ``annotation_id, image_id, x, y, w, h, pos``; ``expressions``: ``annotation_id, sentence, pos``.
    """
    whole = validate.validate(regions, {"valid_box": validate.valid_box(F.array("x", "y", "w", "h"))}, mode)
    named = joins.last_wins_join(whole, expressions.withColumnRenamed("pos", "said"), ["annotation_id"], "said")
    box = B.xywh_to_xyxy(F.array("x", "y", "w", "h")).cast("array<float>")
    region = F.struct(box.alias("bbox"), F.col("sentence").alias("phrase"), F.col("annotation_id").alias("id"))
    listed = named.groupBy("image_id").agg(grouping.ordered_list(region, "pos").alias("region"))
    rows = augment.explode_regions(images.withColumn("split", F.lit(split)).join(listed, "image_id"), "region", "split", ["test"])
    p = path(F.col("image_path"))
    meta = pack_metadata(image_id=F.col("image_id"), annotation_id=F.col("region")["id"], width=F.col("width"), height=F.col("height"), image_path=p)
    plain = F.transform("region", lambda r: F.struct(r["bbox"].alias("bbox"), r["phrase"].alias("phrase")))
    return to_record(rows, task=F.lit(task), source=F.lit(source), image=_image(p), region=plain, metadata=meta)


def _genome_split(images: DataFrame, validation_ids: DataFrame, split: str) -> DataFrame:
    """Validation has the pictures whose ``coco_id`` is listed; training all others, also those without one."""
    keep = joins.semi_join if split == "validation" else joins.anti_join_keep_nulls
    return keep(images, validation_ids, ["coco_id"])


def visual_genome_regions(images: DataFrame, validation_ids: DataFrame, split: str, path: PathOf, *, task: str = "dense_captioning", most: int = 10, most_area: float = 16384) -> DataFrame:
    """``regions``: (x, y, width, height, phrase); those with too large an area go; ``most`` in a record."""
    kept = _genome_split(images, validation_ids, split)
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    small = F.filter("regions", lambda r: r["width"] * r["height"] <= most_area)

    def region(r: Column) -> Column:
        box = B.xywh_to_xyxy(B.clamp_xywh(F.array(r["x"].cast("double"), r["y"].cast("double"), r["width"].cast("double"), r["height"].cast("double")), w, h))
        return F.struct(box.cast("array<float>").alias("bbox"), r["phrase"].alias("phrase"))

    rows = packing.pack_array(kept.withColumn("regions", F.transform(small, region)), "regions", most)
    p = path(F.col("image_id"))
    meta = pack_metadata(image_id=F.col("image_id"), coco_id=F.col("coco_id"), width=F.col("width"), height=F.col("height"), image_path=p)
    return to_record(rows, task=F.lit(task), source=F.lit("visual_genome"), image=_image(p), region=F.col("items"), metadata=meta)


def visual_genome_qa(images: DataFrame, validation_ids: DataFrame, split: str, path: PathOf, *, most: int = 10) -> DataFrame:
    """``qas``: (qa_id, question, answer)."""
    rows = packing.pack_array(_genome_split(images, validation_ids, split), "qas", most)
    p = path(F.col("image_id"))
    meta = pack_metadata(image_id=F.col("image_id"), coco_id=F.col("coco_id"), qa_ids=F.col("items")["qa_id"], image_path=p)
    pairs = F.transform("items", lambda i: _pair(i["question"], i["answer"]))
    return to_record(rows, task=F.lit("vqa"), source=F.lit("visual_genome"), image=_image(p), qa_pairs=pairs, metadata=meta)


def visual_genome_relations(images: DataFrame, validation_ids: DataFrame, split: str, path: PathOf, *, most: int = 10) -> DataFrame:
    """``relationships``: (predicate, subject, object), each end with names, x, y, w, h. More than one name for an end fails."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")

    def name(end: Column) -> Column:
        return F.when(F.size(end["names"]) == 1, F.get(end["names"], F.lit(0))).otherwise(F.raise_error(F.lit("an end of a relation has not one name")))

    def box(end: Column) -> Column:
        return B.xywh_to_xyxy(B.clamp_xywh(F.array(*[end[k].cast("double") for k in "xywh"]), w, h)).cast("array<float>")

    def relation(r: Column) -> Column:
        s, o = r["subject"], r["object"]
        return F.struct(name(s).alias("subject_name"), box(s).alias("subject_bbox"), name(o).alias("object_name"), box(o).alias("object_bbox"), r["predicate"].alias("predicate"))

    kept = _genome_split(images, validation_ids, split).withColumn("relationships", F.transform("relationships", relation))
    rows = packing.pack_array(kept, "relationships", most)
    p = path(F.col("image_id"))
    meta = pack_metadata(image_id=F.col("image_id"), coco_id=F.col("coco_id"), width=F.col("width"), height=F.col("height"), image_path=p)
    return to_record(rows, task=F.lit("relationship_detection"), source=F.lit("visual_genome"), image=_image(p), relation=F.col("items"), metadata=meta)


def grit(pictures: DataFrame, *, least_side: int | None = None, mode: str = "fail") -> DataFrame:
    """``path, caption, width, height, original_width, original_height, noun_chunks, url``; chunks are (start, end, x1, y1, x2, y2, ...).

    Regions and the caption's placeholders are numbered by the same sorted spans. Distinct spans of a caption may not overlap.
    """
    kept = pictures if least_side is None else pictures.filter(curation.min_size(F.col("width"), F.col("height"), F.col("original_width"), F.col("original_height"), least=least_side))
    chunks = F.transform("noun_chunks", lambda c: F.struct(c[0].cast("int").alias("start"), c[1].cast("int").alias("end"), c[2].alias("x1"), c[3].alias("y1"), c[4].alias("x2"), c[5].alias("y2")))
    spans = F.array_sort(F.array_distinct(F.transform("_c", lambda c: F.struct(c["start"], c["end"]))))
    apart = F.forall(F.transform(spans, lambda s, i: (i == 0) | (F.get(spans, i - 1)["end"] <= s["start"])), lambda ok: ok)
    rows = validate.validate(kept.filter(F.size("noun_chunks") > 0).withColumn("_c", chunks), {"spans_apart": apart}, mode)
    regions = augment.regions_from_chunks(F.col("_c"), F.col("caption"), F.col("width"), F.col("height"))
    plain = F.transform(regions, lambda r: F.struct(r["bbox"].cast("array<float>").alias("bbox"), r["phrase"].alias("phrase")))
    marked = curation.markup(F.col("caption"), F.transform("_c", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))))
    rows = rows.select("*", plain.alias("_regions"), marked.alias("_marked"))
    meta = pack_metadata(**{k: F.col(k) for k in ("url", "width", "height", "original_width", "original_height", "noun_chunks")}, image_path=F.col("path"))
    return to_record(rows, task=F.lit("grounded_captioning"), source=F.lit("grit"), image=_image(F.col("path")), caption=F.col("_marked"), region=F.col("_regions"), metadata=meta)


def llava_pretrain(annotations: DataFrame, details: DataFrame, path: PathOf, *, mode: str = "fail") -> DataFrame:
    """Two files side by side by position: ``annotations`` (id, image, conversations, pos), ``details`` (id, image, url, pos).

    Ids and pictures must agree, and a conversation has a human turn and a model turn. The first model turn is the caption, the first human turn the prompt.
    """
    right = details.select(F.col("pos").alias("right_pos"), "id", "image", "url")
    both = joins.positional_zip(annotations, right, "pos", "right_pos", check=["id", "image"])
    said = lambda who: F.get(F.filter("conversations", lambda t: t["role"] == who), F.lit(0))["text"]
    sound = validate.validate(both, {"two_turns": validate.two_turns(F.col("conversations"))}, mode)
    rows = sound.withColumn("caption", said("gpt")).withColumn("prompt", said("human"))
    return _caption(rows, "llava_pretrain", path(F.col("image")), F.col("caption"), id=F.col("id"), url=F.col("url"), prompt=F.col("prompt"))


def llava_instruct(conversations: DataFrame, path: PathOf) -> DataFrame:
    """``id, image, conversations`` with (from, value) turns."""
    chat = F.transform("conversations", lambda t: F.struct(t["from"].alias("role"), t["value"].alias("text")))
    p = path(F.col("image"))
    return to_record(conversations, task=F.lit("chat"), source=F.lit("llava_instruct"), image=_image(p), chat=chat, metadata=pack_metadata(id=F.col("id"), image_path=p))


def pope(questions: DataFrame, kind: str, path: PathOf, *, mode: str = "fail") -> DataFrame:
    """The label, yes or no, stays in the metadata: it is what is to be predicted."""
    questions = validate.validate(questions, {"label": validate.one_of(F.col("label"), "yes", "no")}, mode)
    p = path(F.col("image"))
    meta = pack_metadata(question_id=F.col("question_id"), answer=F.col("label"), image_path=p)
    return to_record(questions, task=F.lit("vqa"), source=F.lit(f"pope_{kind}"), image=_image(p), qa_pairs=F.array(_pair(F.col("text"), _no_answer())), metadata=meta)


def vsr(rows: DataFrame, path: PathOf) -> DataFrame:
    p = path(F.col("image"))
    meta = pack_metadata(label=F.col("label"), relation=F.col("relation"), image_path=p)
    return to_record(rows, task=F.lit("image_text_match"), source=F.lit("vsr"), image=_image(p), caption=F.col("caption"), metadata=meta)


def nocaps(rows: DataFrame, path: PathOf) -> DataFrame:
    p = path(F.col("image_file_name"))
    meta = pack_metadata(image_id=F.col("image_id"), captions=F.col("annotations_captions"), url=F.col("image_coco_url"), image_path=p)
    return to_record(rows, task=F.lit("captioning"), source=F.lit("nocaps"), image=_image(p), metadata=meta)


def localized_narratives(rows: DataFrame, path: PathOf, *, window: float = 0.4) -> DataFrame:
    """``image_id, caption, width, height, traces`` (arrays of x, y, t): each trace clamped, scaled, cut into windows and thinned to their middles.

    Narratives without traces go; a trace without points stays empty.
    """
    scaled = rows.filter(F.size("traces") > 0).withColumn("_scaled", F.transform("traces", lambda t: traces.clamp_scale(t, F.col("width"), F.col("height"))))
    out = scaled.withColumn("_kept", traces.middle_places(F.transform("_scaled", lambda t: F.transform(t, lambda p: p["t"].cast("double"))), window))
    thinned = F.transform("_scaled", lambda points, k: F.transform(F.get("_kept", k), lambda i: F.get(points, i)))
    out = out.withColumn("traces_downsampled", thinned)
    return _caption(out, "localized_narratives", path(F.col("image_id")), F.col("caption"), image_id=F.col("image_id"), traces_downsampled=F.col("traces_downsampled"), traces=F.col("traces"))
