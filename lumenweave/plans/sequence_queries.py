"""Conversation turns, token sequences, row constraints and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenweave import catalog, schema
from lumenweave.functions import arrays as A
from lumenweave.functions.text import format_text
from lumenweave.operators import metrics, sequence, validate
from lumenweave.storage import read_tables

from .registry import Registry
from .text_queries import _STRIP, _sql_format

R = Registry()
QUERIES, ORACLE, q = R.queries, R.oracle, R.query

_ONCE = "once AS (SELECT DISTINCT ON (record_id) * FROM records)"
_EOS = "<|endoftext|>"


def _records(spark, folder, *columns):
    (r,) = read_tables(spark, folder, "records")
    return r.select("record_id", *columns).dropDuplicates(["record_id"])


def _joined(turns):
    """The turns' whole text and which of them are targets."""
    return [F.array_join(F.transform(turns, lambda t: t["text"]), "").alias("text"), F.array_join(F.transform(turns, lambda t: t["is_target"].cast("int").cast("string")), "").alias("targets")]


@q("turns_captioning", f"WITH {_ONCE} SELECT record_id, '{sequence.PROMPTS['captioning']}' || chr(10) || {_sql_format('caption')} || '{_EOS}' AS text, '01' AS targets FROM once WHERE task = 'captioning' AND caption IS NOT NULL")
def _(spark, folder):
    r = _records(spark, folder, "task", "caption").filter("task = 'captioning' AND caption IS NOT NULL")
    return r.select("record_id", *_joined(sequence.turns_captioning(F.col("caption"))))


def _box_sql(box: str) -> str:
    return f"'[' || printf('%.2f', {box}[1]::DOUBLE) || ',' || printf('%.2f', {box}[2]::DOUBLE) || ',' || printf('%.2f', {box}[3]::DOUBLE) || ',' || printf('%.2f', {box}[4]::DOUBLE) || ']'"


_WHOLE = "phrase IS NOT NULL AND len(bbox) = 4 AND list_min(bbox) IS NOT NULL AND list_aggregate(bbox, 'count') = 4"
_REGIONS = f"""{_ONCE}, e AS (SELECT record_id, task, i, region[i + 1].bbox AS bbox, region[i + 1].phrase AS phrase FROM once, range(0, coalesce(len(region), 0)::BIGINT) AS t(i) WHERE region[i + 1] IS NOT NULL),
w AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY i) AS k, count(*) OVER (PARTITION BY record_id) AS n FROM e WHERE {_WHOLE})"""


def _regions(spark, folder, *columns):
    whole = F.filter("region", lambda r: r.isNotNull() & r["phrase"].isNotNull() & (F.size(r["bbox"]) == 4) & F.forall(r["bbox"], lambda v: v.isNotNull()))
    return _records(spark, folder, "task", "region", *columns).withColumn("region", whole).filter(F.size("region") > 0)


@q(
    "turns_dense",
    f"""WITH {_REGIONS} SELECT record_id, '{sequence.PROMPTS['dense_captioning']}' || chr(10) || string_agg({_box_sql('bbox')} || '.' || chr(10) || {_sql_format('phrase')} || chr(10), '' ORDER BY k) || '{_EOS}' AS text,
    '0' || repeat('01', any_value(n)::INTEGER) AS targets FROM w WHERE task = 'dense_captioning' GROUP BY record_id""",
)
def _(spark, folder):
    r = _regions(spark, folder).filter("task = 'dense_captioning'")
    return r.select("record_id", *_joined(sequence.turns_dense(F.col("region"), with_answers=True)))


@q(
    "turns_grounding",
    f"""WITH {_REGIONS} SELECT record_id, '{sequence.PROMPTS['visual_grounding']}' || string_agg(chr(10) || {_sql_format('phrase')} || chr(10) || {_box_sql('bbox')} || '.{_EOS}', '' ORDER BY k) AS text,
    '0' || repeat('01', any_value(n)::INTEGER) AS targets FROM w WHERE task = 'visual_grounding' GROUP BY record_id""",
)
def _(spark, folder):
    r = _regions(spark, folder).filter("task = 'visual_grounding'")
    return r.select("record_id", *_joined(sequence.turns_grounding(F.col("region"), with_answers=True)))


@q(
    "turns_grounded_captioning",
    f"""WITH {_REGIONS}, f AS (SELECT record_id, {_box_sql('bbox')} AS b FROM w WHERE k = 1), c AS (SELECT record_id, {_sql_format("caption || ' <coords_0>'")} AS c FROM once WHERE task = 'grounded_captioning' AND caption IS NOT NULL)
    SELECT c.record_id, '{sequence.PROMPTS['grounded_captioning']}' || chr(10) || replace(c, '<coords_0>', b) || '{_EOS}' AS text, '01' AS targets FROM c JOIN f ON c.record_id = f.record_id""",
)
def _(spark, folder):
    r = _regions(spark, folder, "caption").filter("task = 'grounded_captioning' AND caption IS NOT NULL")
    turns = sequence.turns_grounded_captioning(F.concat("caption", F.lit(" <coords_0>")), F.transform("region", lambda x: x["bbox"]))
    return r.select("record_id", *_joined(turns))


@q(
    "turns_chat",
    f"""WITH {_ONCE}, t AS (SELECT record_id, i, len(chat) AS n, chat[i + 1].role AS role, {_sql_format('chat[i + 1].text')} AS x FROM once, range(0, coalesce(len(chat), 0)::BIGINT) AS r(i)),
    f AS (SELECT record_id, i, n, role, CASE WHEN i = 0 THEN replace(replace(x, chr(10) || '<image>', ''), '<image>' || chr(10), '') ELSE x END || chr(10) || CASE WHEN i = n - 1 THEN '{_EOS}' ELSE '' END AS x FROM t)
    SELECT record_id, string_agg(x, '' ORDER BY i) AS text, string_agg(CASE WHEN role = 'gpt' THEN '1' ELSE '0' END, '' ORDER BY i) AS targets FROM f GROUP BY record_id""",
)
def _(spark, folder):
    r = _records(spark, folder, "chat").filter(F.size("chat") > 0)
    return r.select("record_id", *_joined(sequence.turns_chat(F.col("chat"), with_answers=True)))


_ASK = "CASE WHEN source IN ('docvqa', 'infographics_vqa') THEN {cased} ELSE {plain} END"


def _asked(c: str) -> str:
    stripped = _STRIP.format(c)
    cased = f"CASE WHEN regexp_matches({stripped}, '[.?!]$') THEN {stripped} ELSE {stripped} || '.' END"
    return _ASK.format(cased=cased, plain=_sql_format(c))


@q(
    "turns_vqa",
    f"""WITH {_ONCE}, p AS (SELECT record_id, coalesce(source, '') AS source, i, qa_pairs[i + 1].question AS qu, qa_pairs[i + 1].answer AS an FROM once, range(0, coalesce(len(qa_pairs), 0)::BIGINT) AS r(i) WHERE qa_pairs[i + 1] IS NOT NULL)
    SELECT record_id, '{sequence.PROMPTS['vqa']}' || string_agg(chr(10) || 'Question: ' || {_asked('qu')} || chr(10) || 'Answer: ' || CASE WHEN coalesce(an, '') = '' THEN '' ELSE {_asked('an')} || '{_EOS}' END, '' ORDER BY i) AS text,
    '0' || string_agg(CASE WHEN coalesce(an, '') = '' THEN '0' ELSE '01' END, '' ORDER BY i) AS targets FROM p GROUP BY record_id""",
)
def _(spark, folder):
    pairs = F.filter("qa_pairs", lambda p: p.isNotNull())
    r = _records(spark, folder, "source", "qa_pairs").withColumn("qa_pairs", pairs).filter(F.size("qa_pairs") > 0)
    return r.select("record_id", *_joined(sequence.turns_vqa(F.col("qa_pairs"), F.coalesce("source", F.lit("")))))


_MCQ = f"""{_ONCE}, m AS (SELECT record_id, qa_pairs[1].question AS qu, qa_pairs[1].answer AS an, json_extract_string(metadata, '$.choices[*]') AS c FROM once WHERE json_valid(metadata) AND task = 'multiple_choice_vqa'),
w AS (SELECT *, list_position(c, an)::INTEGER AS k FROM m WHERE list_contains(c, an))"""


def _capital(x: str) -> str:
    s = _STRIP.format(x)
    return f"upper(left({s}, 1)) || lower(substr({s}, 2))"


@q(
    "turns_mcq",
    f"""WITH {_MCQ} SELECT record_id, '{sequence.PROMPTS['multiple_choice_vqa'].replace("'", "''")}' || chr(10) || 'Question: ' || {_sql_format('qu')} || chr(10) ||
    list_aggregate(list_transform(c, lambda x, i: chr((64 + i)::INTEGER) || ': ' || {_capital('x')} || chr(10)), 'string_agg', '') || 'Answer: ' || chr(64 + k) || '.{_EOS}' AS text, repeat('0', (2 + len(c))::INTEGER) || '1' AS targets FROM w""",
)
def _(spark, folder):
    r = _records(spark, folder, "task", "source", "qa_pairs", "metadata").filter("task = 'multiple_choice_vqa'")
    c = r.withColumn("c", F.from_json("metadata", "struct<choices:array<string>>")["choices"]).filter(F.array_contains("c", F.get("qa_pairs", F.lit(0))["answer"]))
    first = F.get("qa_pairs", F.lit(0))
    asked = F.array(F.struct(first["question"].alias("question"), first["answer"].alias("answer"), F.col("c").alias("choices")))
    return c.select("record_id", *_joined(sequence.turns_mcq(asked, source=F.lit("aok_vqa"), with_answers=True)))


@q(
    "turns_grounded_mcq",
    f"""WITH {_REGIONS}, g AS (SELECT record_id, list(phrase ORDER BY k) AS c, list({_box_sql('bbox')} || '.' ORDER BY k) AS b FROM w GROUP BY record_id HAVING count(*) = count(DISTINCT phrase))
    SELECT record_id, '{sequence.PROMPTS['grounded_multiple_choice_vqa'].replace("'", "''")}' || chr(10) || chr(10) || 'Question: Which one?' || chr(10) ||
    list_aggregate(list_transform(b[1:26], lambda x, i: chr((64 + i)::INTEGER) || ': ' || x || chr(10)), 'string_agg', '') || 'Answer: A.{_EOS}' AS text, repeat('0', (2 + least(len(c), 26))::INTEGER) || '1' AS targets FROM g""",
)
def _(spark, folder):
    r = _regions(spark, folder).withColumn("c", F.transform("region", lambda x: x["phrase"])).filter(F.size(F.array_distinct("c")) == F.size("c"))
    asked = F.array(F.struct(F.lit("which one?").alias("question"), F.get("c", F.lit(0)).alias("answer"), F.col("c").alias("choices")))
    return r.select("record_id", *_joined(sequence.turns_grounded_mcq(asked, F.col("region"), with_answers=True)))


@q(
    "turns_itm",
    f"""WITH {_ONCE} SELECT record_id, '{sequence.PROMPTS['image_text_match']}' || chr(10) || {_sql_format('caption')} || chr(10) || CASE WHEN TRY_CAST(json_extract(metadata, '$.label') AS INTEGER) = 1 THEN 'True.' ELSE 'False.' END || '{_EOS}' AS text, '001' AS targets
    FROM once WHERE task = 'image_text_match' AND caption IS NOT NULL AND json_valid(metadata)""",
)
def _(spark, folder):
    r = _records(spark, folder, "task", "caption", "metadata").filter("task = 'image_text_match' AND caption IS NOT NULL")
    label = F.from_json("metadata", "struct<label:int,_bad:string>", {"columnNameOfCorruptRecord": "_bad"})
    rows = r.withColumn("l", label).filter("l._bad IS NULL")
    return rows.select("record_id", *_joined(sequence.turns_itm(F.col("caption"), F.col("l.label"), with_answers=True)))


@q("turns_by_task", f"WITH {_ONCE} SELECT task, count(*) AS n FROM once WHERE task IN ('captioning', 'chat', 'vqa', 'image_text_match') AND CASE task WHEN 'vqa' THEN len(qa_pairs) > 0 WHEN 'chat' THEN len(chat) > 0 ELSE caption IS NOT NULL END GROUP BY task")
def _(spark, folder):
    """Records that lack what their template shows are left out."""
    r = _records(spark, folder, "task", "caption", "qa_pairs", "region", "chat", "source", "metadata").filter("task IN ('captioning', 'chat', 'vqa', 'image_text_match')")
    return sequence.turns_of(r, mode="skip").groupBy("task").agg(F.count(F.lit(1)).alias("n"))


def _captions(spark, folder):
    r = _records(spark, folder, "task", "caption").filter("task = 'captioning' AND caption IS NOT NULL")
    return sequence.tokenized(r.select("record_id", sequence.turns_captioning(F.col("caption")).alias("turns")), "turns")


_WORDS = f"""{_ONCE}, c AS (SELECT record_id, {_sql_format('caption')} || '{_EOS}' AS t FROM once WHERE task = 'captioning' AND caption IS NOT NULL),
n AS (SELECT record_id, len(list_filter(regexp_split_to_array(t, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''))::INTEGER AS k FROM c)"""


@q("label_mask", f"WITH {_WORDS} SELECT record_id, 8 + k AS n_ids, 8 AS n_masked FROM n")
def _(spark, folder):
    masked = F.size(F.filter("labels", lambda x: x == A.MASKED_LABEL))
    return _captions(spark, folder).select("record_id", F.size("input_ids").alias("n_ids"), masked.alias("n_masked"))


@q("assemble_sequence", f"WITH {_WORDS} SELECT record_id, least(20, 7 + 8 + k)::INTEGER AS n_ids, -200 AS first_image FROM n")
def _(spark, folder):
    c = _captions(spark, folder)
    image = A.image_tokens(F.lit(2), F.lit(2))
    ids = A.assemble(image, F.slice("input_ids", 1, 8), F.slice("input_ids", F.lit(9), F.size("input_ids")), order="image", max_length=20)
    return c.select("record_id", F.size(ids).alias("n_ids"), F.get(ids, F.lit(1)).alias("first_image"))


@q(
    "pad_batch",
    """WITH l AS (SELECT l_orderkey, l_suppkey, array_agg(l_linenumber) AS x FROM lineitem GROUP BY l_orderkey, l_suppkey)
    SELECT l_orderkey, l_suppkey, max(len(x)) OVER (PARTITION BY l_orderkey)::INTEGER AS n, (max(len(x)) OVER (PARTITION BY l_orderkey) - len(x))::INTEGER AS n_padding FROM l""",
)
def _(spark, folder):
    (l,) = read_tables(spark, folder, "lineitem")
    x = l.groupBy("l_orderkey", "l_suppkey").agg(F.collect_list(F.col("l_linenumber") + 1).alias("input_ids"))
    padded = sequence.collate(x, "l_orderkey", ["input_ids"], side="left")
    return padded.select("l_orderkey", "l_suppkey", F.size("input_ids").alias("n"), F.size(F.filter("input_ids", lambda v: v == 0)).alias("n_padding"))


@q("attention_mask", f"WITH {_WORDS} SELECT record_id, (8 + k)::INTEGER AS total FROM n")
def _(spark, folder):
    mask = A.ones_like(F.col("input_ids"))
    return _captions(spark, folder).select("record_id", F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("total"))


@q("task_number", f"WITH {_ONCE} SELECT task, list_position([{', '.join(repr(t) for t in schema.TASKS)}], task)::INTEGER - 1 AS number, count(*) AS n FROM once GROUP BY task")
def _(spark, folder):
    return _records(spark, folder, "task").groupBy("task", schema.task_number(F.col("task")).alias("number")).agg(F.count(F.lit(1)).alias("n"))


@q("target_places", f"WITH {_ONCE} SELECT record_id, len(qa_pairs)::INTEGER AS n_targets FROM once WHERE len(qa_pairs) > 0 AND len(list_filter(qa_pairs, lambda p: p IS NOT NULL AND coalesce(p.answer, '') <> '')) = len(qa_pairs)")
def _(spark, folder):
    r = _records(spark, folder, "qa_pairs", "source").filter(F.size("qa_pairs") > 0).filter(F.forall("qa_pairs", lambda p: F.coalesce(p["answer"], F.lit("")) != ""))
    turns = sequence.turns_vqa(F.col("qa_pairs"), F.coalesce("source", F.lit("")))
    odd = F.filter(F.transform(turns, lambda t, i: F.when(t["is_target"] & (i % 2 == 0), i)), lambda i: i.isNotNull())
    return r.select("record_id", F.size(odd).alias("n_targets"))


@q("token_words", f"WITH {_WORDS} SELECT record_id, k AS n_tokens FROM n")
def _(spark, folder):
    r = _records(spark, folder, "task", "caption").filter("task = 'captioning' AND caption IS NOT NULL")
    return r.select("record_id", F.size(sequence.word_tokens(F.concat(format_text(F.col("caption")), F.lit(_EOS)))).alias("n_tokens"))


@q("byte_roundtrip", "SELECT DISTINCT question_id, question AS text, strlen(question) AS n_bytes FROM vqa_questions")
def _(spark, folder):
    """Questions as byte tokens, padded, and read back."""
    (v,) = read_tables(spark, folder, "vqa_questions")
    ids = v.select("question_id", sequence.byte_tokens(F.col("question")).alias("ids")).distinct()
    return ids.select("question_id", sequence.byte_text(F.concat("ids", F.array(F.lit(0), F.lit(-200)))).alias("text"), F.size("ids").cast("long").alias("n_bytes"))


# ---- constraints


@q(
    "broken_rules",
    f"""WITH {_ONCE}, e AS (SELECT record_id, unnest(region) AS r FROM once), b AS (SELECT record_id, count(*) FILTER (NOT (r IS NOT NULL AND r.bbox IS NOT NULL AND len(r.bbox) = 4 AND coalesce(list_min(r.bbox), -1) >= 0 AND list_aggregate(r.bbox, 'count') = 4)) AS bad FROM e GROUP BY record_id)
    SELECT record_id, bad FROM b WHERE bad > 0""",
)
def _(spark, folder):
    """Records with a region whose box has not four coordinates of at least 0, and how many there are."""
    bad = F.filter("region", lambda r: ~F.coalesce(validate.valid_box(r["bbox"]), F.lit(False)))
    r = _records(spark, folder, "region").filter(F.size("region") > 0)
    broken = validate.validate(r.select("record_id", F.size(bad).cast("long").alias("bad")), {"boxes": F.col("bad") == 0}, "quarantine")
    return broken.select("record_id", "bad")


@q("two_turn_chats", f"WITH {_ONCE} SELECT record_id, len(chat) = 2 AND list_contains(list_transform(chat, lambda t: t.role), 'human') AND list_contains(list_transform(chat, lambda t: t.role), 'gpt') AS ok FROM once WHERE chat IS NOT NULL")
def _(spark, folder):
    return _records(spark, folder, "chat").filter("chat IS NOT NULL").select("record_id", validate.two_turns(F.col("chat")).alias("ok"))


@q("ten_answers", "SELECT question_id, bool_and(len(answers) = 10) AS ok FROM vqa_annotations GROUP BY question_id")
def _(spark, folder):
    (a,) = read_tables(spark, folder, "vqa_annotations")
    return a.groupBy("question_id").agg(F.bool_and(validate.exactly(F.col("answers"), 10)).alias("ok"))


@q(
    "has_payload",
    f"""WITH {_ONCE} SELECT task, count(*) FILTER (CASE WHEN task IN ('vqa', 'multiple_choice_vqa') THEN coalesce(len(qa_pairs), 0) > 0 WHEN task IN ('captioning', 'image_text_match') THEN caption IS NOT NULL
    WHEN task IN ('dense_captioning', 'visual_grounding') THEN coalesce(len(region), 0) > 0 WHEN task = 'chat' THEN coalesce(len(chat), 0) > 0 ELSE caption IS NOT NULL AND coalesce(len(region), 0) > 0 END) AS n FROM once WHERE task <> 'relationship_detection' GROUP BY task""",
)
def _(spark, folder):
    r = _records(spark, folder, "task", "caption", "region", "qa_pairs", "chat").filter("task <> 'relationship_detection'")
    ok = validate.has_payload(F.col("task"), F.col("caption"), F.col("region"), F.col("qa_pairs"), F.col("chat"))
    return r.groupBy("task").agg(F.count_if(ok).alias("n"))


# ---- metrics


def _answers(spark, folder):
    """Predictions are the majority answers; the truth is each pair's answer in the records."""
    (a,) = read_tables(spark, folder, "vqa_annotations")
    return a.select("question_id", "answer_type", "multiple_choice_answer", "answers").distinct()


@q(
    "soft_vote_score",
    """WITH d AS (SELECT DISTINCT question_id, answer_type, multiple_choice_answer AS p, answers FROM vqa_annotations), s AS (SELECT answer_type, least(1.0, round(0.3 * len(list_filter(answers, lambda a: a.answer = p)), 1)) AS v FROM d WHERE answers IS NOT NULL AND p IS NOT NULL)
    SELECT answer_type, count(*) AS n, round(avg(v) * 100, 2) AS score FROM s GROUP BY answer_type""",
)
def _(spark, folder):
    d = _answers(spark, folder).filter("answers IS NOT NULL AND multiple_choice_answer IS NOT NULL")
    score = metrics.soft_vote(F.transform("answers", lambda a: a["answer"]), F.col("multiple_choice_answer"))
    return d.groupBy("answer_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score) * 100, 2).alias("score"))


_PRED = "CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END"
_CONFUSION = f"""SELECT l_returnflag, count(*) FILTER ({_PRED} = 1 AND y = 1) AS tp, count(*) FILTER ({_PRED} = 1 AND y = 0) AS fp, count(*) FILTER ({_PRED} = 0 AND y = 0) AS tn, count(*) FILTER ({_PRED} = 0 AND y = 1) AS fn
FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y FROM lineitem) GROUP BY l_returnflag"""


def _confusion(spark, folder):
    (l,) = read_tables(spark, folder, "lineitem")
    rows = l.select("l_returnflag", F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("p"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("y"))
    return metrics.confusion(rows, "p", "y", by=["l_returnflag"])


@q("confusion", _CONFUSION)
def _(spark, folder):
    return _confusion(spark, folder)


@q(
    "binary_metrics",
    f"""SELECT l_returnflag, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1,
    round((tp + fp) / (tp + fp + tn + fn), 6) AS yes_share FROM ({_CONFUSION})""",
)
def _(spark, folder):
    m = metrics.binary_metrics(_confusion(spark, folder))
    return m.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "yes_share")])


@q(
    "exact_match_accuracy",
    "SELECT round(avg(CASE WHEN lower(upper(multiple_choice_answer)) = lower(answers[1].answer) THEN 1.0 ELSE 0.0 END) * 100, 2) AS accuracy FROM (SELECT DISTINCT question_id, answer_type, multiple_choice_answer, answers FROM vqa_annotations)",
)
def _(spark, folder):
    first = F.get("answers", F.lit(0))["answer"]
    return metrics.accuracy(_answers(spark, folder), metrics.exact_match(F.upper("multiple_choice_answer"), first))


@q("accuracy_by_source", "SELECT source, round(avg(CASE WHEN n_chars = length(text) THEN 1.0 ELSE 0.0 END) * 100, 2) AS accuracy FROM documents GROUP BY source")
def _(spark, folder):
    (d,) = read_tables(spark, folder, "documents")
    return metrics.accuracy(d, F.coalesce(F.col("n_chars") == F.length("text"), F.lit(False)), by=["source"])


@q("letter_match", "SELECT p_type, count(*) FILTER (chr((65 + p_size % 4)::INTEGER) = 'B') AS n FROM part GROUP BY p_type")
def _(spark, folder):
    (p,) = read_tables(spark, folder, "part")
    return p.groupBy("p_type").agg(F.count_if(metrics.letter_match(F.lit("B"), F.col("p_size") % 4)).alias("n"))


@q("label_encode", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS strict, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS normalized FROM orders")
def _(spark, folder):
    (o,) = read_tables(spark, folder, "orders")
    noisy = F.concat(F.lit(" "), F.lower("o_orderstatus"), F.lit(". "))
    return o.select("o_orderkey", metrics.encode_label(F.col("o_orderstatus"), "F").alias("strict"), metrics.encode_label(noisy, "f", normalized=True).alias("normalized"))


@q(
    "running_accuracy",
    "SELECT l_orderkey, k AS place, round(avg(c) OVER (PARTITION BY l_orderkey ORDER BY k ROWS UNBOUNDED PRECEDING), 6) AS running FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END AS c FROM lineitem)",
)
def _(spark, folder):
    (l,) = read_tables(spark, folder, "lineitem")
    rows = l.select("l_orderkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long").alias("place"), (F.col("l_returnflag") == "A").cast("double").alias("c"))
    got = metrics.running_mean(rows, "c", ["place"], by=["l_orderkey"])
    return got.select("l_orderkey", "place", F.round("running", 6).alias("running"))


@q(
    "mean_of_means",
    "SELECT l_linestatus, round(avg(m), 4) AS mean_loss FROM (SELECT l_linestatus, l_orderkey, coalesce(avg(CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END), 0) AS m FROM lineitem GROUP BY ALL) GROUP BY l_linestatus",
)
def _(spark, folder):
    (l,) = read_tables(spark, folder, "lineitem")
    rows = l.withColumn("label", F.when(F.col("l_returnflag") == "N", -100).otherwise(1))
    got = metrics.mean_of_means(rows, "l_orderkey", "l_extendedprice", "label", by=["l_linestatus"])
    return got.select("l_linestatus", F.round("mean_loss", 4).alias("mean_loss"))


@q(
    "shifted_labels",
    "SELECT o_custkey, o_orderkey, nxt AS o_orderpriority FROM (SELECT o_custkey, o_orderkey, lead(o_orderpriority) OVER w AS nxt, row_number() OVER w AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE k < n",
)
def _(spark, folder):
    (o,) = read_tables(spark, folder, "orders")
    return metrics.shifted_labels(o.select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderkey", "o_orderpriority")


#: Distinct pairs of words of a text, as metrics.caption_overlap takes them; a text of one word is itself.
_PAIRS = r"""w AS (SELECT *, string_split(trim(regexp_replace(lower(caption), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM k),
g AS (SELECT *, list_distinct(list_transform(range(0, greatest(len(w) - 2, 0) + 1), lambda i: array_to_string(w[i + 1 : i + 2], ' '))) AS g FROM w)"""
OVERLAP = f"""WITH {_ONCE}, k AS (SELECT record_id, image.path AS path, caption FROM once WHERE task = 'captioning' AND caption IS NOT NULL AND image.path IS NOT NULL), {_PAIRS},
c AS (SELECT path, g AS c FROM g JOIN (SELECT min(record_id) AS record_id FROM k GROUP BY path) USING (record_id)),
o AS (SELECT path, max(len(list_intersect(c, g)) / len(c)) AS precision, max(len(list_intersect(c, g)) / len(g)) AS recall FROM c JOIN g USING (path) GROUP BY path)"""


@q("caption_overlap", OVERLAP + " SELECT path, precision, recall FROM o")
def _(spark, folder):
    r = _records(spark, folder, "task", "caption", "image").filter("task = 'captioning' AND caption IS NOT NULL")
    keyed = r.select(F.col("image")["path"].alias("path"), "record_id", "caption").filter("path IS NOT NULL")
    # One candidate for each picture, its smallest record, against all of the picture's captions.
    candidate = keyed.groupBy("path").agg(F.min_by("caption", "record_id").alias("caption"))
    return metrics.caption_overlap(candidate, keyed.select("path", F.col("caption").alias("reference")), "path")


@q(
    "catalog",
    """SELECT corpus, task, corpus = 'llava_pretrain' AS in_pretraining,
    corpus IN ('ai2d', 'aok_vqa', 'coco', 'docvqa', 'gqa', 'grit', 'infographics_vqa', 'llava_instruct', 'ocr_vqa', 'refcoco', 'refcoco_plus', 'refcocog', 'text_caps', 'visual7w', 'visual_genome', 'vqa_v2', 'vsr') AS in_instruction_tuning
    FROM (SELECT unnest(['vqa_v2', 'gqa', 'text_vqa', 'docvqa', 'infographics_vqa', 'ocr_vqa', 'vizwiz_vqa', 'pope_adversarial', 'pope_popular', 'pope_random', 'visual_genome']) AS corpus, 'vqa' AS task
    UNION ALL SELECT unnest(['text_caps', 'coco', 'llava_pretrain', 'nocaps', 'localized_narratives']), 'captioning' UNION ALL SELECT unnest(['aok_vqa', 'ai2d', 'visual7w']), 'multiple_choice_vqa'
    UNION ALL SELECT unnest(['refcoco', 'refcoco_plus', 'refcocog', 'visual_genome']), 'visual_grounding' UNION ALL SELECT 'visual7w', 'grounded_multiple_choice_vqa' UNION ALL SELECT 'visual_genome', 'dense_captioning'
    UNION ALL SELECT 'visual_genome', 'relationship_detection' UNION ALL SELECT 'grit', 'grounded_captioning' UNION ALL SELECT 'llava_instruct', 'chat' UNION ALL SELECT 'vsr', 'image_text_match')""",
)
def _(spark, folder):
    return catalog.catalog_table(spark)


@q("planned_pairs", "SELECT 'visual_genome' AS corpus, unnest(['dense_captioning', 'visual_grounding', 'vqa', 'relationship_detection']) AS task")
def _(spark, folder):
    return spark.createDataFrame(catalog.plan("visual_genome", "train"), "corpus string, task string")
