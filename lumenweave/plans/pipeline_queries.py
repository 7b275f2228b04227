"""Whole loaders, evaluations, sources and streams over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave import sources, streaming
from lumenweave.functions.text import format_bbox
from lumenweave.plans import evaluators, loaders, sequence_queries
from lumenweave.storage import new_path, read_tables

from .registry import Registry

R = Registry()
QUERIES, ORACLE, q = R.queries, R.oracle, R.query

_ONCE = "once AS (SELECT DISTINCT ON (record_id) * FROM records)"
_ANSWERED = """a AS (SELECT question_id, arg_min(answers, s) AS answers FROM (SELECT DISTINCT question_id, answers, CAST(list_transform(answers, lambda x: x.answer) AS VARCHAR) AS s FROM vqa_annotations WHERE answers IS NOT NULL) GROUP BY question_id),
q AS (SELECT DISTINCT question_id, image_id, question FROM vqa_questions WHERE image_id IS NOT NULL AND question_id IN (SELECT question_id FROM a))"""


def _vqa(spark, folder):
    """Questions with one annotation each; of several annotations the one whose answers come first."""
    questions, answers = read_tables(spark, folder, "vqa_questions", "vqa_annotations")
    text = F.to_json(F.transform("answers", lambda a: a["answer"]))
    last = answers.filter("answers IS NOT NULL").groupBy("question_id").agg(F.min_by(F.struct("question_type", "answer_type", "answers"), text).alias("a")).select("question_id", "a.*")
    asked = questions.filter("image_id IS NOT NULL").distinct().join(last.select("question_id"), "question_id", "left_semi")
    return asked.withColumn("pos", F.col("question_id")), last


@q(
    "load_vqa_v2",
    f"""WITH {_ANSWERED}, r AS (SELECT *, sum(new) OVER (ORDER BY question_id, question) AS run FROM (SELECT *, CASE WHEN image_id IS DISTINCT FROM lag(image_id) OVER (ORDER BY question_id, question) THEN 1 ELSE 0 END AS new FROM q)),
    n AS (SELECT *, row_number() OVER (PARTITION BY image_id, run ORDER BY question_id, question) - 1 AS k FROM r)
    SELECT 'coco/' || lpad(image_id::VARCHAR, 12, '0') || '.jpg' AS path, count(*)::INTEGER AS n_pairs, string_agg(question, '|' ORDER BY question_id, question) AS questions FROM n GROUP BY image_id, run, k // 20""",
)
def _(spark, folder):
    """Questions in the order of their numbers; a picture that comes again after another one has a new record."""
    r = loaders.vqa_v2(*_vqa(spark, folder), loaders.coco_path("coco"), mode="skip")
    return r.select("image.path", F.size("qa_pairs").alias("n_pairs"), F.array_join(F.col("qa_pairs")["question"], "|").alias("questions"))


@q("load_vqa_v2_test", "SELECT 'coco/' || lpad(image_id::VARCHAR, 12, '0') || '.jpg' AS path, question, NULL::VARCHAR AS answer FROM (SELECT DISTINCT * FROM vqa_questions WHERE image_id IS NOT NULL)")
def _(spark, folder):
    (questions,) = read_tables(spark, folder, "vqa_questions")
    r = loaders.vqa_v2(questions.filter("image_id IS NOT NULL").distinct(), None, loaders.coco_path("coco"))
    pair = F.get("qa_pairs", F.lit(0))
    return r.select("image.path", pair["question"].alias("question"), pair["answer"].alias("answer"))


@q(
    "load_llava_instruct",
    f"WITH {_ONCE} SELECT record_id::VARCHAR AS id, len(chat)::INTEGER AS n_turns, chat[1].text AS first FROM once WHERE chat IS NOT NULL",
)
def _(spark, folder):
    (r,) = read_tables(spark, folder, "records")
    turns = F.transform("chat", lambda t: F.struct(t["role"].alias("from"), t["text"].alias("value")))
    rows = r.filter("chat IS NOT NULL").dropDuplicates(["record_id"]).select(F.col("record_id").cast("string").alias("id"), F.coalesce(F.col("image")["path"], F.lit("")).alias("image"), turns.alias("conversations"))
    out = loaders.llava_instruct(rows, loaders.in_folder("pictures"))
    return out.select(F.get_json_object("metadata", "$.id").alias("id"), F.size("chat").alias("n_turns"), F.get("chat", F.lit(0))["text"].alias("first"))


@q("load_localized_narratives")  # exact segmentation is a sequential scan; tested against the definition
def _(spark, folder):
    (r,) = read_tables(spark, folder, "records")
    rows = r.filter("task = 'captioning' AND caption IS NOT NULL").dropDuplicates(["record_id"])
    traces = F.from_json("metadata", "struct<traces:array<array<struct<x:double,y:double,t:double>>>>")["traces"]
    narrated = rows.select(F.col("record_id").alias("image_id"), "caption", F.lit(640).alias("width"), F.lit(480).alias("height"), traces.alias("traces")).filter(F.size(F.flatten("traces")) > 0)
    out = loaders.localized_narratives(narrated, loaders.in_folder("coco", ".jpg"))
    return out.select("image.path", "caption", F.size(F.flatten(F.from_json(F.get_json_object("metadata", "$.traces_downsampled"), "array<array<struct<x:double>>>"))).alias("n_points"))


@q(
    "evaluate_soft_votes",
    """WITH d AS (SELECT question_id, min(multiple_choice_answer) AS p, arg_min(answers, s) AS answers FROM (SELECT DISTINCT question_id, multiple_choice_answer, answers, CAST(list_transform(answers, lambda x: x.answer) AS VARCHAR) AS s FROM vqa_annotations WHERE answers IS NOT NULL) GROUP BY question_id)
    SELECT round(avg(least(1.0, round(0.3 * len(list_filter(answers, lambda a: a.answer = lower(p))), 1))) * 100, 2) AS score, count(*) AS n FROM d""",
)
def _(spark, folder):
    (a,) = read_tables(spark, folder, "vqa_annotations")
    said = F.transform("answers", lambda x: x["answer"])
    d = a.filter("answers IS NOT NULL").groupBy("question_id").agg(F.min("multiple_choice_answer").alias("p"), F.min_by(said, F.to_json(said)).alias("answers"))
    predictions = d.select("question_id", F.concat(F.coalesce("p", F.lit("?")), F.lit(".<|endoftext|>")).alias("prediction"))
    return evaluators.evaluate_soft_votes(d.select("question_id", "answers"), predictions)


@q(
    "evaluate_yes_no",
    f"""WITH {_ONCE}, l AS (SELECT record_id, TRY_CAST(json_extract(metadata, '$.label') AS INTEGER) AS y, caption LIKE '%inside%' AS p FROM once WHERE task = 'image_text_match' AND json_valid(metadata) AND caption IS NOT NULL),
    c AS (SELECT count(*) FILTER (p AND y = 1) AS tp, count(*) FILTER (p AND y = 0) AS fp, count(*) FILTER (NOT p AND y = 0) AS tn, count(*) FILTER (NOT p AND y = 1) AS fn FROM l)
    SELECT (tp + tn) / (tp + fp + tn + fn) AS accuracy, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, (tp + fp) / (tp + fp + tn + fn) AS yes_share FROM c""",
)
def _(spark, folder):
    (r,) = read_tables(spark, folder, "records")
    label = F.from_json("metadata", "struct<label:int,_bad:string>", {"columnNameOfCorruptRecord": "_bad"})
    rows = r.filter("task = 'image_text_match' AND caption IS NOT NULL").dropDuplicates(["record_id"]).withColumn("l", label).filter("l._bad IS NULL")
    said = F.when(F.contains("caption", F.lit("inside")), "true").otherwise("false")
    predictions = rows.select("record_id", F.concat(said, F.lit("<|endoftext|>")).alias("prediction"))
    return evaluators.evaluate_yes_no(rows.select("record_id", F.col("l.label").alias("label")), predictions, "false", on="record_id")


@q(
    "evaluate_letters",
    f"""WITH {_ONCE}, m AS (SELECT record_id, source, qa_pairs[1].answer AS an, json_extract_string(metadata, '$.choices[*]') AS c FROM once WHERE json_valid(metadata) AND task = 'multiple_choice_vqa')
    SELECT source, round(avg(CASE WHEN list_position(c, an) = 2 THEN 1.0 ELSE 0.0 END) * 100, 2) AS accuracy FROM m WHERE list_contains(c, an) GROUP BY source""",
)
def _(spark, folder):
    (r,) = read_tables(spark, folder, "records")
    rows = r.filter("task = 'multiple_choice_vqa'").dropDuplicates(["record_id"]).withColumn("c", F.from_json("metadata", "struct<choices:array<string>>")["choices"])
    answer = F.get("qa_pairs", F.lit(0))["answer"]
    truth = rows.filter(F.array_contains("c", answer)).select("record_id", "source", (F.array_position("c", answer) - 1).alias("correct"))
    predictions = truth.select("record_id", F.lit("B. or so<|endoftext|>").alias("prediction"))
    return evaluators.evaluate_letters(truth, predictions, on="record_id", by=["source"])


@q(
    "evaluate_exact",
    """WITH d AS (SELECT question_id, min(multiple_choice_answer) AS p, min(answers[1].answer) AS answer, min(answer_type) AS kind FROM vqa_annotations WHERE answers IS NOT NULL GROUP BY question_id)
    SELECT kind, round(avg(CASE WHEN lower(p) = lower(answer) THEN 1.0 ELSE 0.0 END) * 100, 2) AS accuracy FROM d GROUP BY kind""",
)
def _(spark, folder):
    (a,) = read_tables(spark, folder, "vqa_annotations")
    first = F.get("answers", F.lit(0))["answer"]
    d = a.filter("answers IS NOT NULL").groupBy("question_id").agg(F.min("multiple_choice_answer").alias("p"), F.min(first).alias("answer"), F.min("answer_type").alias("kind"))
    predictions = d.select("question_id", F.concat("p", F.lit(".<|endoftext|>")).alias("prediction"))
    return evaluators.evaluate_exact(d, predictions, by=["kind"])


@q(
    "evaluate_boxes",
    f"""WITH {_ONCE}, e AS (SELECT unnest(region) AS r FROM once WHERE task = 'visual_grounding'), b AS (SELECT r.bbox[1]::DOUBLE AS x1, r.bbox[2]::DOUBLE AS y1, r.bbox[3]::DOUBLE AS x2, r.bbox[4]::DOUBLE AS y2 FROM e WHERE r IS NOT NULL AND len(r.bbox) = 4 AND list_aggregate(r.bbox, 'count') = 4),
    o AS (SELECT *, greatest(least(x2, 400) - greatest(x1, 100), 0) * greatest(least(y2, 400) - greatest(y1, 100), 0) AS i FROM b)
    SELECT round(avg(CASE WHEN i / ((x2 - x1) * (y2 - y1) + 90000.0 - i) > 0.1 THEN 1.0 ELSE 0.0 END) * 100, 2) AS accuracy FROM o""",
)
def _(spark, folder):
    (r,) = read_tables(spark, folder, "records")
    regions = r.filter("task = 'visual_grounding'").dropDuplicates(["record_id"]).select("record_id", F.posexplode("region").alias("pos", "r"))
    whole = regions.filter((F.size("r.bbox") == 4) & F.forall("r.bbox", lambda v: v.isNotNull()))
    truth = whole.select(F.struct("record_id", "pos").alias("region_id"), F.transform("r.bbox", lambda v: v.cast("double")).alias("box"), F.lit(1000).alias("width"), F.lit(1000).alias("height"))
    predictions = truth.select("region_id", F.lit("[0.10,0.10,0.40,0.40].<|endoftext|>").alias("prediction"))
    return evaluators.evaluate_boxes(truth, predictions, on="region_id", threshold=0.1)


@q(
    "evaluate_text_vqa",
    """WITH d AS (SELECT question_id, min(multiple_choice_answer) AS p, arg_min(answers, s) AS answers FROM (SELECT DISTINCT question_id, multiple_choice_answer, answers, CAST(list_transform(answers, lambda x: x.answer) AS VARCHAR) AS s FROM vqa_annotations WHERE answers IS NOT NULL) GROUP BY question_id)
    SELECT round(avg(least(1.0, round(0.3 * len(list_filter(answers, lambda a: a.answer = lower(p))), 1))) * 100, 5) AS score, count(*) AS n FROM d""",
)
def _(spark, folder):
    """Soft votes to five digits, on predictions with text after the end mark."""
    (a,) = read_tables(spark, folder, "vqa_annotations")
    said = F.transform("answers", lambda x: x["answer"])
    d = a.filter("answers IS NOT NULL").groupBy("question_id").agg(F.min("multiple_choice_answer").alias("p"), F.min_by(said, F.to_json(said)).alias("answers"))
    predictions = d.select("question_id", F.concat(F.coalesce("p", F.lit("?")), F.lit(".<|endoftext|>and more")).alias("prediction"))
    return evaluators.evaluate_soft_votes(d.select("question_id", "answers"), predictions, digits=5)


@q(
    "prompt_with_words",
    f"""WITH {_ONCE} SELECT record_id, 'Answer the question using a single word or phrase.' || chr(10) || 'OCR text:' || chr(10) || 'one two' || chr(10) || 'Question: ' || f || chr(10) || 'Answer: ' AS prompt
    FROM (SELECT record_id, CASE WHEN regexp_matches(c, '[.?!]$') THEN c ELSE c || '.' END AS f FROM (SELECT record_id, upper(left(t, 1)) || lower(substr(t, 2)) AS c FROM (SELECT record_id, regexp_replace(qa_pairs[1].question, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS t FROM once WHERE qa_pairs[1].question IS NOT NULL)))""",
)
def _(spark, folder):
    """The prompt of a question about a picture with words read from it."""
    (r,) = read_tables(spark, folder, "records")
    rows = r.dropDuplicates(["record_id"]).withColumn("q", F.get("qa_pairs", F.lit(0))["question"]).filter("q IS NOT NULL")
    return rows.select("record_id", evaluators.prompt_vqa(F.col("q"), ocr_words=F.array(F.lit("one"), F.lit("two"))).alias("prompt"))


@q(
    "evaluate_true_false",
    f"""WITH {_ONCE}, l AS (SELECT record_id, TRY_CAST(json_extract(metadata, '$.label') AS INTEGER) AS y, caption LIKE '%inside%' AS p FROM once WHERE task = 'image_text_match' AND json_valid(metadata) AND caption IS NOT NULL),
    c AS (SELECT count(*) FILTER (p AND y = 1) AS tp, count(*) FILTER (p AND y = 0) AS fp, count(*) FILTER (NOT p AND y = 0) AS tn, count(*) FILTER (NOT p AND y = 1) AS fn FROM l)
    SELECT (tp + tn) / (tp + fp + tn + fn) AS accuracy, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, (tp + fp) / (tp + fp + tn + fn) AS yes_share FROM c""",
)
def _(spark, folder):
    """Captions true or false of a picture: the label's case counts, what follows the closing stop does not."""
    (r,) = read_tables(spark, folder, "records")
    label = F.from_json("metadata", "struct<label:int,_bad:string>", {"columnNameOfCorruptRecord": "_bad"})
    rows = r.filter("task = 'image_text_match' AND caption IS NOT NULL").dropDuplicates(["record_id"]).withColumn("l", label).filter("l._bad IS NULL")
    said = F.when(F.contains("caption", F.lit("inside")), "True").otherwise("False")
    predictions = rows.select("record_id", F.concat(said, F.lit(".<|endoftext|>so")).alias("prediction"))
    return evaluators.evaluate_yes_no(rows.select("record_id", F.col("l.label").alias("label")), predictions, "False", on="record_id", how="cased")


@q(
    "evaluate_box_choices",
    f"""WITH {_ONCE}, e AS (SELECT record_id, len(region) AS n FROM once WHERE task = 'visual_grounding' AND len(region) BETWEEN 1 AND 20)
    SELECT round(avg(CASE WHEN record_id % n = 1 THEN 1.0 ELSE 0.0 END) * 100, 2) AS accuracy FROM e""",
)
def _(spark, folder):
    """Boxes to choose from by letter: the prompt lists them, the prediction's first segment is a letter."""
    (r,) = read_tables(spark, folder, "records")
    rows = r.filter("task = 'visual_grounding' AND size(region) BETWEEN 1 AND 20").dropDuplicates(["record_id"])
    boxes = F.transform("region", lambda b: format_bbox(F.transform(b["bbox"], lambda v: v.cast("double"))))
    asked = rows.select("record_id", F.pmod("record_id", F.size("region")).cast("int").alias("correct"), evaluators.prompt_choices(F.lit("which one?"), boxes, capitalized=False).alias("prompt"))
    # The second letter, which only stands for a choice where there are two.
    predictions = asked.select("record_id", F.concat(F.lit("B. "), F.coalesce(F.substring("prompt", 1, 3), F.lit("")), F.lit("<|endoftext|>")).alias("prediction"))
    return evaluators.evaluate_letters(asked.select("record_id", "correct"), predictions, on="record_id")


#: As caption_overlap; line breaks are taken out of the candidate first.
_SCORES = (
    sequence_queries.OVERLAP.replace("caption FROM once", "caption, 0 AS side FROM once", 1)
    .replace("), w AS (", " UNION ALL SELECT record_id, image.path, replace(caption, chr(10), ''), 1 FROM once WHERE task = 'captioning' AND caption IS NOT NULL AND image.path IS NOT NULL), w AS (", 1)
    .replace("USING (record_id))", "USING (record_id) WHERE side = 1)").replace("JOIN g USING (path)", "JOIN g USING (path) WHERE side = 0")
    + " SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, count(*) AS n FROM o"
)


def _references(spark, folder):
    (r,) = read_tables(spark, folder, "records")
    return r.filter("task = 'captioning' AND caption IS NOT NULL").dropDuplicates(["record_id"]).select(F.col("image")["path"].alias("image_id"), "record_id", "caption").filter("image_id IS NOT NULL")


@q("evaluate_nocaps", _SCORES)
def _(spark, folder):
    """References come from the metadata of whole records of the loader."""
    rows = _references(spark, folder)
    images = rows.groupBy("image_id").agg(F.array_sort(F.collect_list("caption")).alias("annotations_captions"))
    made = loaders.nocaps(images.select("image_id", F.col("image_id").alias("image_file_name"), F.lit("u").alias("image_coco_url"), "annotations_captions"), loaders.in_folder("p"))
    read = F.from_json("metadata", "struct<image_id:string,captions:array<string>>")
    references = made.select(read.alias("m")).select("m.image_id", F.explode("m.captions").alias("reference"))
    predictions = rows.groupBy("image_id").agg(F.concat(F.min_by("caption", "record_id"), F.lit("<|endoftext|>")).alias("prediction"))
    return evaluators.evaluate_captions(references, predictions)


@q("evaluate_text_caps", _SCORES)
def _(spark, folder):
    """References listed by picture in the order in which they come."""
    rows = _references(spark, folder)
    listed = evaluators.references_by_picture(rows, "image_id", "record_id")
    predictions = rows.groupBy("image_id").agg(F.concat(F.min_by("caption", "record_id"), F.lit("<|endoftext|>more")).alias("prediction"))
    return evaluators.evaluate_captions(listed.select("image_id", F.explode("references").alias("reference")), predictions)


@q("evaluate_captions", _SCORES)
def _(spark, folder):
    (r,) = read_tables(spark, folder, "records")
    rows = r.filter("task = 'captioning' AND caption IS NOT NULL").dropDuplicates(["record_id"]).select(F.col("image")["path"].alias("image_id"), "record_id", "caption").filter("image_id IS NOT NULL")
    predictions = rows.groupBy("image_id").agg(F.concat(F.min_by("caption", "record_id"), F.lit("<|endoftext|>")).alias("prediction"))
    return evaluators.evaluate_captions(rows.select("image_id", F.col("caption").alias("reference")), predictions)


@q("json_lines_roundtrip", "SELECT n_nationkey, n_name, NULL::VARCHAR AS note FROM nation")
def _(spark, folder):
    """Written as JSON lines, nulls included, and read again."""
    (n,) = read_tables(spark, folder, "nation")
    path = new_path(spark, "lines")
    sources.write_json(n.select("n_nationkey", "n_name", F.lit(None).cast("string").alias("note")), path)
    return sources.read_json_lines(spark, path, "n_nationkey int, n_name string, note string")


@q("partitioned_roundtrip", "SELECT r_regionkey, n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 3")
def _(spark, folder):
    """Written by partition and read with the partition pruned."""
    (n,) = read_tables(spark, folder, "nation")
    path = new_path(spark, "parts")
    sources.write_records(n.withColumnRenamed("n_regionkey", "r_regionkey"), path, partitions=("r_regionkey",))
    return sources.read_parquet(spark, path).filter("r_regionkey = 3").select("r_regionkey", "n_nationkey", "n_name")


@q("status_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def _(spark, folder):
    """The status filter of the Parquet source, which reaches the scan."""
    (orders,) = read_tables(spark, folder, "orders")
    path = new_path(spark, "by-status")
    sources.write_records(orders.select("o_orderkey", F.col("o_orderstatus").alias("status")), path, partitions=())
    return sources.read_parquet(spark, path, status="F", ignore_corrupt=True).select("o_orderkey")


@q("listed_files")  # names differ with the folder
def _(spark, folder):
    return sources.list_files(spark, folder, "*.parquet", recursive=True).select("stem", "length")


@q(
    "stream_windows",
    "SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
)
def _(spark, folder):
    """The streaming aggregation run over the table at once; the tests run it as a stream."""
    (e,) = read_tables(spark, folder, "events")
    return streaming.windowed_counts(e, "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))
