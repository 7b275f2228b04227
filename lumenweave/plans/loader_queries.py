"""Every loader over source tables that are made from the test tables: whole records in the shape of each source's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.functions.metadata import fields, variant
from lumenweave.plans import loaders
from lumenweave.storage import read_tables

from .registry import Registry

R = Registry()
QUERIES, ORACLE, q = R.queries, R.oracle, R.query

_SQL_ONCE = """once AS (SELECT DISTINCT ON (record_id) *, image.path AS path, regexp_replace(lower(trim(source)), '[ -]+', '_', 'g') AS src, CASE WHEN json_valid(metadata) THEN metadata::JSON END AS j FROM records)"""


def _once(spark: SparkSession, folder: str) -> DataFrame:
    (r,) = read_tables(spark, folder, "records")
    source = F.regexp_replace(F.lower(F.trim("source")), "[ -]+", "_")
    return r.dropDuplicates(["record_id"]).withColumn("path", F.col("image")["path"]).withColumn("src", source)


def _asked(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """``record_id, path, pos, question, answer`` of a source's pairs; ``pos`` is unique."""
    r = _once(spark, folder).filter((F.col("src") == source) & F.col("path").isNotNull()).select("record_id", "path", F.posexplode("qa_pairs").alias("k", "p"))
    return r.filter("p.question IS NOT NULL").select("record_id", "path", (F.col("record_id") * 1000 + F.col("k")).alias("pos"), "p.question", "p.answer")


def _sql_asked(source: str) -> str:
    return f"""{_SQL_ONCE}, asked AS (SELECT record_id, path, record_id * 1000 + k AS pos, qa_pairs[k + 1].question AS question, qa_pairs[k + 1].answer AS answer
    FROM once, range(0, coalesce(len(qa_pairs), 0)) AS t(k) WHERE src = '{source}' AND path IS NOT NULL AND qa_pairs[k + 1].question IS NOT NULL)"""


_SQL_RUNS = "runs AS (SELECT *, sum(new) OVER (ORDER BY pos) AS run FROM (SELECT *, CASE WHEN path IS DISTINCT FROM lag(path) OVER (ORDER BY pos) THEN 1 ELSE 0 END AS new FROM asked))"
_SAME = loaders.in_folder("p")


def _joined(pairs: Column, field: str) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.coalesce(p[field], F.lit("-"))), "|")


@q(
    "load_gqa",
    f"""WITH {_sql_asked("gqa")}, n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pos) - 1 AS n FROM asked)
    SELECT 'p/' || path AS path, string_agg(question, '|' ORDER BY pos) AS questions, string_agg(coalesce(answer, '-'), '|' ORDER BY pos) AS answers FROM n GROUP BY path, n // 20""",
)
def _(spark, folder):
    a = _asked(spark, folder, "gqa").select(F.lpad(F.col("pos").cast("string"), 12, "0").alias("question_id"), F.col("path").alias("image_id"), "question", F.lit("short").alias("answer"), F.col("answer").alias("full_answer"), F.lit(True).alias("is_balanced"))
    r = loaders.gqa(a, _SAME, short=False, balanced=True)
    return r.select("image.path", _joined(F.col("qa_pairs"), "question").alias("questions"), _joined(F.col("qa_pairs"), "answer").alias("answers"))


def _read_words(spark: SparkSession, folder: str) -> DataFrame:
    r = _once(spark, folder).filter("path IS NOT NULL")
    return r.select(F.col("path").alias("image_id"), F.array(F.col("record_id").cast("string")).alias("ocr_info"), F.col("record_id").alias("pos"))


@q(
    "load_text_vqa",
    f"""WITH {_sql_asked("text_vqa")}, {_SQL_RUNS}, o AS (SELECT path, max(record_id) AS last FROM once WHERE path IS NOT NULL GROUP BY path)
    SELECT 'p/' || path AS path, string_agg(question, '|' ORDER BY pos) AS questions, string_agg(coalesce(answer, '-'), '|' ORDER BY pos) AS answers, max(last)::VARCHAR AS ocr FROM runs JOIN o USING (path) GROUP BY path, run""",
)
def _(spark, folder):
    """Questions in runs of a picture; the last row of words read from it counts; a question with nine answers is left out."""
    asked = _asked(spark, folder, "text_vqa")
    ten = F.when(F.col("answer").isNotNull(), F.array_repeat("answer", 10))
    spoiled = asked.select(F.col("path").alias("image_id"), (F.col("pos") + 500).alias("question_id"), "question", F.array_repeat(F.lit("nine"), 9).alias("answers"), (F.col("pos") + 500).alias("pos"))
    questions = asked.select(F.col("path").alias("image_id"), F.col("pos").alias("question_id"), "question", ten.alias("answers"), "pos").unionByName(spoiled)
    r = loaders.text_vqa(questions, _read_words(spark, folder), _SAME, mode="skip")
    last = F.get(F.from_json(F.get_json_object("metadata", "$.ocr_info"), "array<array<string>>"), F.lit(0))[0]
    return r.select("image.path", _joined(F.col("qa_pairs"), "question").alias("questions"), _joined(F.col("qa_pairs"), "answer").alias("answers"), last.alias("ocr"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    a = _asked(spark, folder, "docvqa")
    return a.select(F.col("path").alias("image"), F.col("pos").alias("question_id"), "question", F.array(F.lit("other"), "answer", "answer").alias("answers"), F.lit(1).alias("doc_id"), F.lit("d").alias("ucsf_document_id"), F.lit("1").alias("ucsf_document_page_no"), F.lit("u").alias("image_url"), F.lit("o").alias("ocr_output_file"), "pos")


def _sql_documents(question: str) -> str:
    return f"""WITH {_sql_asked("docvqa")}, {_SQL_RUNS} SELECT 'p/' || path AS path, string_agg({question}, '|' ORDER BY pos) AS questions, string_agg(coalesce(answer, '-'), '|' ORDER BY pos) AS answers FROM runs GROUP BY path, run"""


@q("load_docvqa", _sql_documents("upper(left(question, 1)) || substr(question, 2)"))
def _(spark, folder):
    r = loaders.docvqa(_documents(spark, folder), _SAME)
    return r.select("image.path", _joined(F.col("qa_pairs"), "question").alias("questions"), _joined(F.col("qa_pairs"), "answer").alias("answers"))


@q("load_infographics_vqa", _sql_documents("question"))
def _(spark, folder):
    r = loaders.infographics_vqa(_documents(spark, folder), _SAME)
    return r.select("image.path", _joined(F.col("qa_pairs"), "question").alias("questions"), _joined(F.col("qa_pairs"), "answer").alias("answers"))


@q(
    "load_vizwiz",
    """WITH a AS (SELECT question_id, arg_min(answers, s) AS answers FROM (SELECT DISTINCT question_id, answers, CAST(list_transform(answers, lambda x: x.answer) AS VARCHAR) AS s FROM vqa_annotations WHERE answers IS NOT NULL) GROUP BY question_id),
    u AS (SELECT question_id, answers[i + 1].answer AS answer, i FROM a, range(0, len(answers)) AS t(i)), c AS (SELECT question_id, answer, count(*) AS n, min(i) AS f FROM u GROUP BY question_id, answer),
    v AS (SELECT question_id, arg_max(answer, n * 1000 - f) AS answer FROM c GROUP BY question_id)
    SELECT 'p/' || image_id AS path, question, answer FROM (SELECT DISTINCT question_id, image_id, question FROM vqa_questions WHERE image_id IS NOT NULL) JOIN v USING (question_id)""",
)
def _(spark, folder):
    questions, answers = read_tables(spark, folder, "vqa_questions", "vqa_annotations")
    text = F.to_json(F.transform("answers", lambda a: a["answer"]))
    last = answers.filter("answers IS NOT NULL").groupBy("question_id").agg(F.min_by("answers", text).alias("answers"))
    rows = questions.filter("image_id IS NOT NULL").distinct().join(last, "question_id").select(F.col("image_id").cast("string").alias("image"), "question", F.lit(1).alias("answerable"), "answers")
    pair = F.get("qa_pairs", F.lit(0))
    return loaders.vizwiz(rows, _SAME).select("image.path", pair["question"].alias("question"), pair["answer"].alias("answer"))


def _captions(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder).filter("task = 'captioning' AND caption IS NOT NULL AND path IS NOT NULL").select("record_id", "path", "caption", "split")


@q(
    "load_text_caps",
    f"""WITH {_SQL_ONCE}, o AS (SELECT path, max(record_id) AS last FROM once WHERE path IS NOT NULL GROUP BY path)
    SELECT 'p/' || path AS path, caption, last::VARCHAR AS ocr FROM once JOIN o USING (path) WHERE task = 'captioning' AND caption IS NOT NULL""",
)
def _(spark, folder):
    rows = _captions(spark, folder).select(F.col("path").alias("image_id"), F.col("caption").alias("caption_str"), F.col("record_id").alias("caption_id"))
    r = loaders.text_caps(rows, _read_words(spark, folder), _SAME)
    return r.select("image.path", "caption", F.get(F.from_json(F.get_json_object("metadata", "$.ocr"), "array<string>"), F.lit(0)).alias("ocr"))


@q(
    "load_coco",
    f"""WITH {_SQL_ONCE}, s AS (SELECT image_id, min(split) AS split FROM (SELECT path AS image_id, split FROM once WHERE task = 'captioning' AND caption IS NOT NULL AND path IS NOT NULL) GROUP BY image_id)
    SELECT record_id::VARCHAR AS caption_id, caption FROM once JOIN s ON path = image_id WHERE task = 'captioning' AND caption IS NOT NULL AND s.split IN ('train', 'restval')""",
)
def _(spark, folder):
    """Captions listed by picture and taken apart again, those of the split restval with train."""
    said = F.array_sort(F.collect_list(F.struct("record_id", "caption")))
    images = _captions(spark, folder).groupBy(F.xxhash64("path").alias("cocoid"), "path").agg(F.min("split").alias("split"), said.alias("s"))
    images = images.select("cocoid", "split", F.col("s")["record_id"].alias("sentids"), F.col("s")["caption"].alias("sentences"))
    r = loaders.coco(images, "train", loaders.coco_path("coco"))
    return r.select(F.get_json_object("metadata", "$.caption_id").alias("caption_id"), "caption")


_SQL_COVERS = f"""WITH {_SQL_ONCE}, b AS (SELECT *, json_extract_string(j, '$.image_url') AS url, list_filter(qa_pairs, lambda p: p IS NOT NULL) AS pairs FROM once WHERE src = 'ocr_vqa' AND json_extract_string(j, '$.image_url') IS NOT NULL)"""


@q(
    "load_ocr_vqa",
    _SQL_COVERS + """, one AS (SELECT url FROM b GROUP BY url HAVING count(*) = 1)
    SELECT 'p/' || record_id AS path, array_to_string(list_transform(pairs, lambda p: coalesce(p.question, '-')), '|') AS questions, array_to_string(list_transform(pairs, lambda p: coalesce(p.answer, '-')), '|') AS answers
    FROM b JOIN one USING (url) WHERE length(url) > 38 AND len(pairs) > 0""",
)
def _(spark, folder):
    """Covers whose url is unique and kept; a row with a question too many is left out."""
    j = fields(F.col("metadata"), "image_url", "title", "author_name", "genre")
    b = _once(spark, folder).filter("src = 'ocr_vqa'").select(F.col("record_id").cast("string").alias("id"), j.alias("j"), F.filter("qa_pairs", lambda p: p.isNotNull()).alias("p"))
    books = b.select("id", "j.image_url", F.lit(1).alias("split"), F.col("p")["question"].alias("questions"), F.col("p")["answer"].alias("answers"), "j.title", "j.author_name", "j.genre").filter("image_url IS NOT NULL")
    keep = books.select("image_url").distinct().withColumn("keep", F.length("image_url") > 38)
    spoiled = books.withColumn("questions", F.concat("questions", F.array(F.lit("more"))))
    r = loaders.ocr_vqa(books.unionByName(spoiled), keep, "train", _SAME, mode="skip")
    return r.select("image.path", _joined(F.col("qa_pairs"), "question").alias("questions"), _joined(F.col("qa_pairs"), "answer").alias("answers"))


def _chosen(spark: SparkSession, folder: str) -> DataFrame:
    """``record_id, path, split, question, answer, choices, correct`` of multiple choice records; ``correct`` from 0, null if the answer is none of them."""
    r = _once(spark, folder).filter("task = 'multiple_choice_vqa'")
    choices = F.try_variant_get(variant(F.col("metadata")), "$.choices", "array<string>")
    pair = F.get("qa_pairs", F.lit(0))
    rows = r.select("record_id", "path", "split", pair["question"].alias("question"), pair["answer"].alias("answer"), choices.alias("choices")).filter("size(choices) > 0 AND path IS NOT NULL AND question IS NOT NULL")
    whole = rows.filter(F.forall("choices", lambda c: c.isNotNull()) & (F.size(F.array_distinct("choices")) == F.size("choices")))
    return whole.withColumn("correct", F.nullif(F.array_position("choices", F.coalesce("answer", F.lit(""))), F.lit(0)).cast("int") - 1)


_SQL_CHOSEN = f"""{_SQL_ONCE}, c0 AS (SELECT record_id, path, split, qa_pairs[1].question AS question, qa_pairs[1].answer AS answer, CASE WHEN json_type(json_extract(j, '$.choices')) = 'ARRAY' THEN json_extract_string(j, '$.choices[*]') END AS choices FROM once WHERE task = 'multiple_choice_vqa'),
    chosen AS (SELECT *, nullif(coalesce(list_position(choices, answer), 0), 0) - 1 AS correct FROM c0 WHERE len(choices) > 0 AND path IS NOT NULL AND question IS NOT NULL AND len(list_filter(choices, lambda c: c IS NULL)) = 0 AND len(list_distinct(choices)) = len(choices))"""
_SQL_SWAPPED = """swapped AS (SELECT *, list_transform(choices, lambda c, i: CASE WHEN i - 1 = slot THEN choices[correct + 1] WHEN i - 1 = correct THEN choices[slot + 1] ELSE c END) AS s, choices[correct + 1] AS given FROM chosen, range(0, len(choices)) AS t(slot) WHERE correct IS NOT NULL
    UNION ALL SELECT *, NULL AS slot, choices AS s, NULL AS given FROM chosen WHERE correct IS NULL)"""


@q("load_aok_vqa", f"WITH {_SQL_CHOSEN}, {_SQL_SWAPPED} SELECT 'p/' || path AS path, question, given AS answer, array_to_string(s, '|') AS choices, slot::VARCHAR AS slot FROM swapped")
def _(spark, folder):
    """A row for each slot of the right choice; one where it isn't known."""
    c = _chosen(spark, folder).select(F.col("path").alias("image_id"), F.col("record_id").cast("string").alias("question_id"), "question", "choices", F.col("correct").alias("correct_choice_idx"), F.array().cast("array<string>").alias("rationales"))
    r = loaders.aok_vqa(c, _SAME)
    pair = F.get("qa_pairs", F.lit(0))
    choices = F.from_json(F.get_json_object("metadata", "$.choices"), "array<string>")
    return r.select("image.path", pair["question"].alias("question"), pair["answer"].alias("answer"), F.array_join(choices, "|").alias("choices"), F.get_json_object("metadata", "$.correct_choice_idx").alias("slot"))


def _diagrams(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = _chosen(spark, folder)
    question = F.struct("question", F.col("record_id").cast("string").alias("question_id"), F.col("choices").alias("answers"), F.col("correct").alias("correct_answer"))
    images = c.groupBy(F.col("path").alias("image_name")).agg(F.collect_list(question).alias("questions"))
    tokens = c.groupBy(F.col("path").alias("image_name")).agg(F.array(F.struct(F.lit("k").alias("key"), F.max("question").alias("value"))).alias("tokens"))
    return images, tokens, c.filter("split = 'test'").select(F.col("path").alias("image_name")).distinct()


def _diagram_rows(r: DataFrame) -> DataFrame:
    pair = F.get("qa_pairs", F.lit(0))
    choices = F.from_json(F.get_json_object("metadata", "$.choices"), "array<string>")
    return r.select("image.path", pair["question"].alias("question"), pair["answer"].alias("answer"), F.array_join(choices, "|").alias("choices"), (F.get_json_object("metadata", "$.ocr_text") != "").alias("has_text"))


@q(
    "load_ai2d",
    f"""WITH {_SQL_CHOSEN}, {_SQL_SWAPPED}, held AS (SELECT DISTINCT path FROM chosen WHERE split = 'test')
    SELECT 'p/' || path AS path, question, given AS answer, array_to_string(s, '|') AS choices, true AS has_text FROM swapped WHERE path NOT IN (SELECT path FROM held)""",
)
def _(spark, folder):
    """Training and validation diagrams together: all that are not listed for the test."""
    images, tokens, held = _diagrams(spark, folder)
    both = [loaders.ai2d(images, tokens, held, s, _SAME) for s in ("train", "validation")]
    return _diagram_rows(both[0].unionByName(both[1]))


@q("load_ai2d_test", f"WITH {_SQL_CHOSEN} SELECT 'p/' || path AS path, question, NULL::VARCHAR AS answer, array_to_string(choices, '|') AS choices, true AS has_text FROM chosen WHERE path IN (SELECT path FROM chosen WHERE split = 'test')")
def _(spark, folder):
    images, tokens, held = _diagrams(spark, folder)
    return _diagram_rows(loaders.ai2d(images, tokens, held, "test", _SAME))


@q(
    "load_visual7w_telling",
    f"""WITH {_SQL_CHOSEN}, w AS (SELECT *, list_filter(choices, lambda c: c <> choices[correct + 1]) AS wrong, choices[correct + 1] AS given FROM chosen WHERE correct IS NOT NULL),
    n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY record_id) - 1 AS pos FROM w), p AS (SELECT *, array_to_string(list_concat(list_concat(wrong[1:slot], [given]), wrong[slot + 1:]), '/') AS shown FROM n, range(0, len(wrong) + 1) AS t(slot)),
    r AS (SELECT *, row_number() OVER (PARTITION BY path, slot ORDER BY pos) - 1 AS place FROM p)
    SELECT 'p/' || path AS path, slot::VARCHAR AS slot, string_agg(question, '|' ORDER BY pos) AS questions, string_agg(shown, '|' ORDER BY pos) AS choices FROM r GROUP BY path, slot, place // 3""",
)
def _(spark, folder):
    """The answer at every place among the wrong choices, three questions of one place in a record."""
    c = _chosen(spark, folder).filter("correct IS NOT NULL").withColumn("given", F.get("choices", F.col("correct")))
    pair = F.struct("record_id", "question", F.col("given").alias("answer"), F.array_remove("choices", F.col("given")).alias("multiple_choices"))
    images = c.groupBy(F.xxhash64("path").alias("image_id"), F.col("path").alias("filename")).agg(F.array_sort(F.collect_list(pair)).alias("qa_pairs"))
    r = loaders.visual7w(images.withColumn("split", F.lit("train")).withColumn("width", F.lit(1)).withColumn("height", F.lit(1)), "train", _SAME)
    shown = F.transform(F.from_json(F.get_json_object("metadata", "$.answers"), "array<array<string>>"), lambda c: F.array_join(c, "/"))
    return r.select("image.path", F.get_json_object("metadata", "$.slot").alias("slot"), _joined(F.col("qa_pairs"), "question").alias("questions"), F.array_join(shown, "|").alias("choices"))


def _boxes(spark: SparkSession, folder: str, task: str) -> DataFrame:
    """``record_id, path, pos, x, y, w, h, phrase`` of regions with a whole box and a phrase; sides in whole pixels."""
    r = _once(spark, folder).filter((F.col("task") == task) & F.col("path").isNotNull()).select("record_id", "path", "split", "metadata", F.posexplode("region").alias("pos", "r"))
    whole = r.filter((F.size("r.bbox") == 4) & F.forall("r.bbox", lambda v: v.isNotNull() & (v >= 0)) & F.col("r.phrase").isNotNull())
    side = lambda i: F.floor(F.get("r.bbox", F.lit(i)).cast("double")).cast("double")
    return whole.select("record_id", "path", "split", "metadata", "pos", side(0).alias("x"), side(1).alias("y"), (side(2) - side(0)).alias("w"), (side(3) - side(1)).alias("h"), F.col("r.phrase").alias("phrase")).filter("w >= 0 AND h >= 0")


def _sql_boxes(task: str) -> str:
    return f"""{_SQL_ONCE}, b0 AS (SELECT record_id, path, split, j, k AS pos, region[k + 1] AS r FROM once, range(0, coalesce(len(region), 0)) AS t(k) WHERE task = '{task}' AND path IS NOT NULL),
    b AS (SELECT record_id, path, split, j, pos, floor(r.bbox[1]::DOUBLE) AS x, floor(r.bbox[2]::DOUBLE) AS y, floor(r.bbox[3]::DOUBLE) - floor(r.bbox[1]::DOUBLE) AS w, floor(r.bbox[4]::DOUBLE) - floor(r.bbox[2]::DOUBLE) AS h, r.phrase AS phrase
          FROM b0 WHERE len(r.bbox) = 4 AND len(list_filter(r.bbox, lambda v: v IS NOT NULL AND v >= 0)) = 4 AND r.phrase IS NOT NULL),
    boxes AS (SELECT * FROM b WHERE w >= 0 AND h >= 0)"""


def _corners(region: Column) -> Column:
    """Phrases and boxes as text, in whole pixels."""
    return F.array_join(F.transform(region, lambda r: F.concat_ws(" ", r["phrase"], F.array_join(F.transform(r["bbox"], lambda v: v.cast("int").cast("string")), " "))), "|")


_SQL_CORNERS = "concat_ws(' ', phrase, x::INTEGER, y::INTEGER, (x + w)::INTEGER, (y + h)::INTEGER)"


@q(
    "load_visual7w_pointing",
    f"""WITH {_sql_boxes("visual_grounding")}, n AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY record_id) AS n FROM boxes), t AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY pos) AS _ FROM n WHERE n >= 2 AND k <= 4),
    i AS (SELECT record_id, path, max(CASE WHEN k = 1 THEN phrase END) AS question, count(*) AS m, string_agg(concat_ws(' ', record_id || ':' || pos, x::INTEGER, y::INTEGER, (x + least(w, 90))::INTEGER, (y + least(h, 70))::INTEGER), '|' ORDER BY record_id || ':' || pos) AS regions FROM t GROUP BY record_id, path)
    SELECT 'p/' || path AS path, slot::VARCHAR AS slot, question, regions FROM i, range(0, m) AS u(slot)""",
)
def _(spark, folder):
    """Boxes as choices: up to four of a record, the first is right, its phrase the question."""
    b = _boxes(spark, folder, "visual_grounding").withColumn("box_id", F.concat_ws(":", "record_id", "pos"))
    listed = b.groupBy("record_id", "path").agg(F.array_sort(F.collect_list(F.struct("pos", "box_id", "phrase"))).alias("l")).filter("size(l) >= 2").withColumn("l", F.slice("l", 1, 4))
    ids = F.col("l")["box_id"]
    pair = F.struct(F.get("l", F.lit(0))["phrase"].alias("question"), F.get(ids, F.lit(0)).alias("answer"), F.slice(ids, F.lit(2), F.size(ids)).alias("multiple_choices"))
    images = listed.select(F.col("record_id").alias("image_id"), F.lit("train").alias("split"), F.col("path").alias("filename"), F.lit(90).alias("width"), F.lit(70).alias("height"), F.array(pair).alias("qa_pairs"))
    boxes = b.select("box_id", "x", "y", F.col("w").alias("width"), F.col("h").alias("height"))
    r = loaders.visual7w(images, "train", _SAME, boxes=boxes)
    return r.select("image.path", F.get_json_object("metadata", "$.slot").alias("slot"), F.get("qa_pairs", F.lit(0))["question"].alias("question"), _corners(F.col("region")).alias("regions"))


def _referred(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = _boxes(spark, folder, "visual_grounding").withColumn("annotation_id", F.concat_ws(":", "record_id", "pos"))
    images = b.select(F.col("record_id").cast("string").alias("image_id"), F.col("path").alias("image_path")).distinct().withColumn("width", F.lit(640)).withColumn("height", F.lit(480))
    regions = b.select("annotation_id", F.col("record_id").cast("string").alias("image_id"), "x", "y", "w", "h", F.col("pos").cast("long").alias("pos"))
    said = b.select("annotation_id", F.lit("first").alias("sentence"), F.lit(0).alias("pos")).unionByName(b.select("annotation_id", F.col("phrase").alias("sentence"), F.lit(1).alias("pos")))
    return images, regions, said


@q("load_refcoco", f"WITH {_sql_boxes('visual_grounding')} SELECT 'p/' || path AS path, string_agg({_SQL_CORNERS}, '|' ORDER BY pos) AS regions FROM boxes GROUP BY record_id, path")
def _(spark, folder):
    """Regions of a picture together, each with the last that was said of it."""
    r = loaders.refcoco(*_referred(spark, folder), "train", _SAME)
    return r.select("image.path", _corners(F.col("region")).alias("regions"))


@q("load_refcoco_test", f"WITH {_sql_boxes('visual_grounding')} SELECT 'p/' || path AS path, {_SQL_CORNERS} AS regions FROM boxes")
def _(spark, folder):
    """In a test split every region is a record."""
    r = loaders.refcoco(*_referred(spark, folder), "test", _SAME, source="refcocog")
    return r.select("image.path", _corners(F.col("region")).alias("regions"))


def _held_out(spark: SparkSession, folder: str) -> DataFrame:
    r = _once(spark, folder).filter("split = 'validation'").select(fields(F.col("metadata"), "coco_id").alias("j"))
    return r.select(F.col("j.coco_id").cast("long").alias("coco_id")).filter("coco_id IS NOT NULL").distinct()


_SQL_HELD = "held AS (SELECT DISTINCT TRY_CAST(json_extract_string(j, '$.coco_id') AS BIGINT) AS coco_id FROM once WHERE split = 'validation' AND TRY_CAST(json_extract_string(j, '$.coco_id') AS BIGINT) IS NOT NULL)"
_SQL_COCO = "TRY_CAST(json_extract_string(j, '$.coco_id') AS BIGINT)"


def _coco_id() -> Column:
    return F.expr("try_cast(j.coco_id AS BIGINT)")


def _genome_regions(spark: SparkSession, folder: str) -> DataFrame:
    b = _boxes(spark, folder, "dense_captioning").withColumn("j", fields(F.col("metadata"), "coco_id"))
    region = F.struct("pos", "x", "y", F.col("w").alias("width"), F.col("h").alias("height"), "phrase")
    return b.groupBy(F.col("record_id").alias("image_id"), _coco_id().alias("coco_id")).agg(F.array_sort(F.collect_list(region)).alias("regions")).withColumn("width", F.lit(60)).withColumn("height", F.lit(50))


def _sql_genome_regions(where: str) -> str:
    return f"""WITH {_sql_boxes("dense_captioning")}, {_SQL_HELD}, c AS (SELECT *, {_SQL_COCO} AS coco_id FROM boxes WHERE w * h <= 16384), n AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY pos) - 1 AS k FROM c WHERE {where})
    SELECT 'p/' || record_id AS path, string_agg(concat_ws(' ', phrase, x::INTEGER, y::INTEGER, (x + least(w, 60))::INTEGER, (y + least(h, 50))::INTEGER), '|' ORDER BY pos) AS regions FROM n GROUP BY record_id, k // 10"""


@q("load_visual_genome_regions", _sql_genome_regions("coco_id IS NULL OR coco_id NOT IN (SELECT coco_id FROM held)"))
def _(spark, folder):
    """Training pictures, those without a number too; large regions go; ten in a record."""
    r = loaders.visual_genome_regions(_genome_regions(spark, folder), _held_out(spark, folder), "train", _SAME)
    return r.select("image.path", _corners(F.col("region")).alias("regions"))


@q("load_visual_genome_regions_validation", _sql_genome_regions("coco_id IN (SELECT coco_id FROM held)"))
def _(spark, folder):
    r = loaders.visual_genome_regions(_genome_regions(spark, folder), _held_out(spark, folder), "validation", _SAME)
    return r.select("image.path", _corners(F.col("region")).alias("regions"))


@q(
    "load_visual_genome_qa",
    f"""WITH {_sql_asked("visual_genome")}, {_SQL_HELD}, n AS (SELECT a.*, row_number() OVER (PARTITION BY a.record_id ORDER BY pos) - 1 AS k FROM asked a JOIN (SELECT record_id, {_SQL_COCO} AS coco_id FROM once) USING (record_id) WHERE coco_id IS NULL OR coco_id NOT IN (SELECT coco_id FROM held))
    SELECT 'p/' || record_id AS path, string_agg(question, '|' ORDER BY pos) AS questions, string_agg(coalesce(answer, '-'), '|' ORDER BY pos) AS answers FROM n GROUP BY record_id, k // 10""",
)
def _(spark, folder):
    asked = _asked(spark, folder, "visual_genome").groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("qa_id"), "question", "answer"))).alias("qas"))
    numbers = _once(spark, folder).select("record_id", fields(F.col("metadata"), "coco_id").alias("j")).select("record_id", _coco_id().alias("coco_id"))
    images = asked.join(numbers, "record_id").withColumnRenamed("record_id", "image_id")
    r = loaders.visual_genome_qa(images, _held_out(spark, folder), "train", _SAME)
    return r.select("image.path", _joined(F.col("qa_pairs"), "question").alias("questions"), _joined(F.col("qa_pairs"), "answer").alias("answers"))


@q(
    "load_visual_genome_relations",
    f"""WITH {_SQL_ONCE}, {_SQL_HELD}, e AS (SELECT record_id, {_SQL_COCO} AS coco_id, k, relation[k + 1] AS r FROM once, range(0, coalesce(len(relation), 0)) AS t(k) WHERE task = 'relationship_detection'),
    n AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY k) - 1 AS place FROM e WHERE r IS NOT NULL AND r.subject_name IS NOT NULL AND r.object_name IS NOT NULL AND r.predicate IS NOT NULL AND (coco_id IS NULL OR coco_id NOT IN (SELECT coco_id FROM held)))
    SELECT 'p/' || record_id AS path, string_agg(r.subject_name || ' ' || r.predicate || ' ' || r.object_name || ' 10 20 40 60', '|' ORDER BY k) AS relations FROM n GROUP BY record_id, place // 10""",
)
def _(spark, folder):
    r = _once(spark, folder).filter("task = 'relationship_detection'").withColumn("j", fields(F.col("metadata"), "coco_id"))
    kept = F.filter("relation", lambda x: x.isNotNull() & x["subject_name"].isNotNull() & x["object_name"].isNotNull() & x["predicate"].isNotNull())
    end = lambda name: F.struct(F.array(name).alias("names"), F.lit(10).alias("x"), F.lit(20).alias("y"), F.lit(30).alias("w"), F.lit(40).alias("h"))
    found = F.transform(kept, lambda x: F.struct(x["predicate"].alias("predicate"), end(x["subject_name"]).alias("subject"), end(x["object_name"]).alias("object")))
    images = r.select(F.col("record_id").alias("image_id"), _coco_id().alias("coco_id"), F.lit(300).alias("width"), F.lit(200).alias("height"), found.alias("relationships")).filter("size(relationships) > 0")
    out = loaders.visual_genome_relations(images, _held_out(spark, folder), "train", _SAME)
    corner = lambda b: F.array_join(F.transform(b, lambda v: v.cast("int").cast("string")), " ")
    said = F.transform("relation", lambda x: F.concat_ws(" ", x["subject_name"], x["predicate"], x["object_name"], corner(x["object_bbox"])))
    return out.select("image.path", F.array_join(said, "|").alias("relations"))


@q(
    "load_grit",
    f"""WITH {_SQL_ONCE}, g AS (SELECT record_id, caption, json_extract(j, '$.noun_chunks') AS l FROM once WHERE task = 'grounded_captioning' AND length(caption) > 20),
    c AS (SELECT record_id, caption, i * 5 AS a, i * 5 + 3 AS b FROM g, range(0, CASE WHEN json_type(l) = 'ARRAY' THEN least(json_array_length(l), 3)::BIGINT ELSE 0 END) AS t(i))
    SELECT 'p/' || record_id AS path, string_agg(substr(caption, (a + 1)::INTEGER, 3), '|' ORDER BY a) AS phrases, count(*)::INTEGER AS n FROM c GROUP BY record_id""",
)
def _(spark, folder):
    """Up to three spans of each caption; captions with overlapping spans are left out."""
    r = _once(spark, folder).filter("task = 'grounded_captioning' AND length(caption) > 20")
    listed = F.try_variant_get(variant(F.col("metadata")), "$.noun_chunks", "array<variant>")
    n = F.when(F.size(listed) > 0, F.least(F.size(listed), F.lit(3)))
    chunk = lambda a, b: F.array(a.cast("double"), b.cast("double"), *[F.lit(v) for v in (0.1, 0.1, 0.5, 0.5)])
    chunks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: chunk(i * 5, i * 5 + 3)))
    rows = r.select("record_id", "caption", chunks.alias("noun_chunks")).filter("noun_chunks IS NOT NULL")
    spoiled = rows.withColumn("noun_chunks", F.concat("noun_chunks", F.array(chunk(F.lit(1), F.lit(4)))))
    side = {c: F.lit(100) for c in ("width", "height", "original_width", "original_height")}
    pictures = rows.unionByName(spoiled).select(F.concat(F.lit("p/"), F.col("record_id").cast("string")).alias("path"), "caption", "noun_chunks", *[v.alias(k) for k, v in side.items()], F.lit("u").alias("url"))
    out = loaders.grit(pictures, least_side=50, mode="skip")
    return out.select("image.path", F.array_join(F.col("region")["phrase"], "|").alias("phrases"), F.size("region").alias("n"))


@q(
    "load_llava_pretrain",
    f"""WITH {_SQL_ONCE}, c AS (SELECT record_id, list_filter(chat, lambda t: t IS NOT NULL) AS t FROM once WHERE len(chat) > 0)
    SELECT 'p/' || record_id AS path, list_filter(t, lambda x: x.role = 'gpt')[1].text AS caption, list_filter(t, lambda x: x.role = 'human')[1].text AS prompt FROM c
    WHERE len(t) = 2 AND len(list_filter(t, lambda x: x.role = 'gpt')) = 1 AND len(list_filter(t, lambda x: x.role = 'human')) = 1""",
)
def _(spark, folder):
    """Conversations of other than a human and a model turn are left out."""
    c = _once(spark, folder).filter("size(chat) > 0").select(F.col("record_id").cast("string").alias("id"), F.col("record_id").cast("string").alias("image"), F.filter("chat", lambda t: t.isNotNull()).alias("conversations"), F.col("record_id").alias("pos"))
    details = c.select("id", "image", F.lit("u").alias("url"), "pos")
    out = loaders.llava_pretrain(c, details, _SAME, mode="skip")
    return out.select("image.path", "caption", F.get_json_object("metadata", "$.prompt").alias("prompt"))


_SQL_MATCHED = f"{_SQL_ONCE}, m AS (SELECT record_id, path, caption, json_extract_string(j, '$.label') AS label, json_extract_string(j, '$.relation') AS relation FROM once WHERE task = 'image_text_match' AND caption IS NOT NULL AND path IS NOT NULL)"


def _matched(spark: SparkSession, folder: str) -> DataFrame:
    r = _once(spark, folder).filter("task = 'image_text_match' AND caption IS NOT NULL AND path IS NOT NULL")
    return r.select("record_id", "path", "caption", fields(F.col("metadata"), "label", "relation").alias("j")).select("record_id", "path", "caption", "j.label", "j.relation")


@q("load_pope", f"WITH {_SQL_MATCHED} SELECT 'p/' || path AS path, caption AS question, NULL::VARCHAR AS answer, CASE label WHEN '1' THEN 'yes' ELSE 'no' END AS label FROM m WHERE label IN ('0', '1')")
def _(spark, folder):
    """The label stays in the metadata; a row with another label than yes or no is left out."""
    m = _matched(spark, folder)
    label = F.when(F.col("label") == "1", "yes").when(F.col("label") == "0", "no").otherwise(F.col("label"))
    out = loaders.pope(m.select(F.col("record_id").alias("question_id"), F.col("path").alias("image"), F.col("caption").alias("text"), label.alias("label")), "random", _SAME, mode="skip")
    pair = F.get("qa_pairs", F.lit(0))
    return out.select("image.path", pair["question"].alias("question"), pair["answer"].alias("answer"), F.get_json_object("metadata", "$.answer").alias("label"))


@q("load_vsr", f"WITH {_SQL_MATCHED} SELECT 'p/' || path AS path, caption, label, relation FROM m")
def _(spark, folder):
    out = loaders.vsr(_matched(spark, folder).withColumn("image", F.col("path")), _SAME)
    return out.select("image.path", "caption", F.get_json_object("metadata", "$.label").alias("label"), F.get_json_object("metadata", "$.relation").alias("relation"))


@q(
    "load_nocaps",
    f"WITH {_SQL_ONCE} SELECT 'p/' || path AS path, count(*)::INTEGER AS n_captions, NULL::VARCHAR AS caption, min(caption) AS first FROM once WHERE task = 'captioning' AND caption IS NOT NULL AND path IS NOT NULL GROUP BY path",
)
def _(spark, folder):
    """Captions to score against stay in the metadata."""
    images = _captions(spark, folder).groupBy("path").agg(F.array_sort(F.collect_list("caption")).alias("annotations_captions"))
    out = loaders.nocaps(images.select(F.xxhash64("path").alias("image_id"), F.col("path").alias("image_file_name"), F.lit("u").alias("image_coco_url"), "annotations_captions"), _SAME)
    said = F.from_json(F.get_json_object("metadata", "$.captions"), "array<string>")
    return out.select("image.path", F.size(said).alias("n_captions"), "caption", F.get(said, F.lit(0)).alias("first"))
