"""Text functions over captions, questions and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenweave.functions import text as T
from lumenweave.operators import curation
from lumenweave.functions.metadata import variant
from lumenweave.storage import read_tables

from .registry import Registry

R = Registry()
QUERIES, ORACLE, q = R.queries, R.oracle, R.query

_ONCE = "once AS (SELECT DISTINCT ON (record_id) * FROM records)"
#: DuckDB's expression for each formatting step.
_WHITE = r"[ \t\n\r\f\v\x1c-\x1f\x{{85}}\p{{Z}}]"
_STRIP = rf"regexp_replace(regexp_replace({{0}}, '^{_WHITE}+', ''), '{_WHITE}+$', '')"


def _sql_format(c: str) -> str:
    stripped = _STRIP.format(c)
    cap = f"upper(left({stripped}, 1)) || lower(substr({stripped}, 2))"
    return f"CASE WHEN regexp_matches({cap}, '[.?!]$') THEN {cap} ELSE {cap} || '.' END"


@q("format_text", f"SELECT doc_id, {_sql_format('text')} AS formatted FROM documents")
def _(spark, folder):
    (d,) = read_tables(spark, folder, "documents")
    return d.select("doc_id", T.format_text(F.col("text")).alias("formatted"))


@q("format_text_marked", f"SELECT question_id, '<s>' || {_sql_format('question')} || '</s>' AS formatted FROM vqa_questions")
def _(spark, folder):
    (v,) = read_tables(spark, folder, "vqa_questions")
    return v.select("question_id", T.format_text(F.col("question"), bos="<s>", eos="</s>").alias("formatted"))


@q("upper_first", "SELECT doc_id, upper(left(text, 1)) || substr(text, 2) AS raised FROM documents")
def _(spark, folder):
    (d,) = read_tables(spark, folder, "documents")
    return d.select("doc_id", T.upper_first(F.col("text")).alias("raised"))


_SPACE = r"[\t\n\v\f\r \p{Z}\x1c-\x1f\x{85}]"
#: SQL without word edges of all scripts: an article between other characters than letters, marks, digits and ties; twice, as two articles may share one of these.
_BARE = r"regexp_replace({}, '(^|[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}])(?i:a|an|the|some)($|[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}])', '\1\2', 'g')"


@q("remove_articles", f"SELECT doc_id, regexp_replace(regexp_replace({_BARE.format(_BARE.format('text'))}, '{_SPACE}+', ' ', 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS bare FROM documents")
def _(spark, folder):
    (d,) = read_tables(spark, folder, "documents")
    return d.select("doc_id", T.remove_articles(F.col("text")).alias("bare"))


@q("span_phrase", "SELECT doc_id, lower(substr(text, 4, 20)) AS phrase FROM documents WHERE text IS NOT NULL")
def _(spark, folder):
    (d,) = read_tables(spark, folder, "documents")
    return d.filter("text IS NOT NULL").select("doc_id", T.span_phrase(F.col("text"), F.lit(3), F.lit(23)).alias("phrase"))


_DENIED = ["what color", "is the", "how many"]


@q("deny_substrings", "SELECT question_id, question FROM vqa_questions WHERE NOT (lower(question) LIKE '%what color%' OR lower(question) LIKE '%is the%' OR lower(question) LIKE '%how many%')")
def _(spark, folder):
    (v,) = read_tables(spark, folder, "vqa_questions")
    return v.filter(~T.contains_any(F.col("question"), _DENIED)).select("question_id", "question")


@q(
    "image_marks",
    f"""WITH {_ONCE}, t AS (SELECT record_id, unnest(chat) AS c FROM once WHERE chat IS NOT NULL)
    SELECT record_id, count(*) AS n_turns, sum(length(replace(replace(c.text, E'\\n<image>', ''), E'<image>\\n', '')))::BIGINT AS n_chars FROM t GROUP BY record_id""",
)
def _(spark, folder):
    (r,) = read_tables(spark, folder, "records")
    turns = r.dropDuplicates(["record_id"]).select("record_id", F.explode("chat").alias("c"))
    return turns.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.length(T.without_image_mark(F.col("c.text")))).alias("n_chars"))


@q(
    "placeholder_fill",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, replace(replace('from <coords_0> to <coords_1> and <coords_0>', '<coords_0>', '[' || l_partkey || ']'), '<coords_1>', '[' || l_suppkey || ']') AS filled FROM lineitem",
)
def _(spark, folder):
    (l,) = read_tables(spark, folder, "lineitem")
    boxed = lambda c: F.concat(F.lit("["), F.col(c).cast("string"), F.lit("]"))
    filled = T.fill_placeholders(F.lit("from <coords_0> to <coords_1> and <coords_0>"), F.array(boxed("l_partkey"), boxed("l_suppkey")))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", filled.alias("filled"))


@q(
    "ocr_context",
    """SELECT o_custkey, 'OCR text:' || chr(10) || string_agg(k || ': ' || v, chr(10) ORDER BY k, v) AS context
    FROM (SELECT o_custkey, 'order ' || o_orderkey AS k, o_orderpriority AS v FROM orders) GROUP BY o_custkey""",
)
def _(spark, folder):
    (o,) = read_tables(spark, folder, "orders")
    token = F.struct(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_orderpriority").alias("value"))
    return o.groupBy("o_custkey").agg(T.ocr_context(F.collect_list(token)).alias("context"))


@q(
    "ocr_words",
    """WITH once AS (SELECT DISTINCT ON (record_id) * FROM records), m AS (SELECT record_id, json_extract(CASE WHEN json_valid(metadata) THEN metadata::JSON END, '$.ocr.ocr_info') AS l FROM once)
    SELECT record_id, array_to_string(list_filter(list_transform(l::JSON[], lambda x: json_extract_string(x, '$.word')), lambda w: w IS NOT NULL), ' ') AS words FROM m WHERE json_type(l) = 'ARRAY'""",
)
def _(spark, folder):
    """The words read from each picture, joined by spaces."""
    (r,) = read_tables(spark, folder, "records")
    read = F.try_variant_get(variant(F.col("metadata")), "$.ocr.ocr_info", "array<variant>")
    words = F.transform(read, lambda x: F.try_variant_get(x, "$.word", "string"))
    return r.dropDuplicates(["record_id"]).select("record_id", F.array_join(words, " ").alias("words")).filter("words IS NOT NULL")


_CHOICES = "(SELECT p_type, array_agg(DISTINCT p_brand ORDER BY p_brand) AS c FROM part GROUP BY p_type)"


def _choices(spark, folder):
    (p,) = read_tables(spark, folder, "part")
    return p.groupBy("p_type").agg(F.array_sort(F.collect_set("p_brand")).alias("c"))


@q("letter_choices", f"SELECT p_type, list_aggregate(list_transform(c[1:26], lambda x, i: chr((64 + i)::INTEGER) || ': ' || x || chr(10)), 'string_agg', '') || 'Answer: ' AS choices FROM {_CHOICES}")
def _(spark, folder):
    return _choices(spark, folder).select("p_type", T.letter_choices(F.col("c")).alias("choices"))


@q("answer_letter", f"SELECT p_type, chr((64 + len(c))::INTEGER) AS last_letter FROM {_CHOICES}")
def _(spark, folder):
    return _choices(spark, folder).select("p_type", T.answer_letter(F.col("c"), F.element_at("c", -1)).alias("last_letter"))


@q("format_bbox", "SELECT p_partkey, '[' || printf('%.2f', p_size / 8.0) || ',' || printf('%.2f', p_retailprice / 64) || ',' || printf('%.2f', p_size * 0.005::DOUBLE) || ',' || printf('%.2f', p_retailprice) || '].' AS box FROM part")
def _(spark, folder):
    (p,) = read_tables(spark, folder, "part")
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    return p.select("p_partkey", T.format_bbox(F.array(size / 8.0, price / 64, size * 0.005, price)).alias("box"))


@q("parse_bbox", "SELECT p_partkey, round(p_size / 4.0, 2) AS x, round(p_retailprice / 4, 4) AS h FROM part")
def _(spark, folder):
    (p,) = read_tables(spark, folder, "part")
    text = F.concat(F.lit("at ["), (F.col("p_size") / 4.0).cast("string"), F.lit(", 1, 2, "), (F.col("p_retailprice") / 4).cast("string"), F.lit("] it is"))
    box = T.parse_bbox(text)
    return p.select("p_partkey", F.round(box[0], 2).alias("x"), F.round(box[3], 4).alias("h"))


@q("parse_bins", "SELECT p_partkey, p_size::DOUBLE AS first, (p_partkey % 100)::DOUBLE AS last FROM part")
def _(spark, folder):
    (p,) = read_tables(spark, folder, "part")
    text = F.concat(F.lit("<s><bin_"), F.col("p_size").cast("string"), F.lit("><bin_7><bin_"), (F.col("p_partkey") % 100).cast("string"), F.lit("></s><pad>"))
    numbers = T.parse_bins(text)
    return p.select("p_partkey", F.get(numbers, F.lit(0)).alias("first"), F.element_at(numbers, -1).alias("last"))


@q("truncate_output", "SELECT doc_id, lower(split_part(split_part(text || '.<|endoftext|>' || text, '.<|endoftext|>', 1), '<|endoftext|>', 1)) AS cut, split_part(replace(text, '<|endoftext|>', ''), '.', 1) AS segment FROM documents")
def _(spark, folder):
    (d,) = read_tables(spark, folder, "documents")
    out = F.concat(F.col("text"), F.lit(".<|endoftext|>"), F.col("text"))
    return d.select("doc_id", T.truncate_output(out).alias("cut"), T.first_segment(F.col("text")).alias("segment"))


@q(
    "path_functions",
    r"""SELECT DISTINCT image_path, regexp_extract(image_path, '([^/]*)$', 1) AS name, regexp_replace(regexp_extract(image_path, '([^/]*)$', 1), '\.[^.]*$', '') AS stem,
    lpad(width::VARCHAR, 12, '0') || '.jpg' AS numbered, regexp_extract(regexp_replace(image_path, '\.[^.]*$', ''), '([^_]*)$', 1) AS suffix FROM images""",
)
def _(spark, folder):
    (i,) = read_tables(spark, folder, "images")
    p = F.col("image_path")
    suffix = F.substring_index(F.regexp_replace(p, r"\.[^.]*$", ""), "_", -1)
    return i.select("image_path", T.basename(p).alias("name"), T.stem(p).alias("stem"), T.numbered_image(F.col("width")).alias("numbered"), suffix.alias("suffix")).distinct()


@q("caption_cleanup", f"WITH {_ONCE} SELECT record_id, {_STRIP.format('''replace(replace(caption, '\\n', ''), chr(10), '')''')} AS clean FROM once WHERE caption IS NOT NULL")
def _(spark, folder):
    (r,) = read_tables(spark, folder, "records")
    return r.filter("caption IS NOT NULL").dropDuplicates(["record_id"]).select("record_id", T.unbroken(F.col("caption")).alias("clean"))


@q("source_label", f"WITH {_ONCE} SELECT record_id, concat_ws(' ', source, task) AS label FROM once")
def _(spark, folder):
    (r,) = read_tables(spark, folder, "records")
    return r.groupBy("record_id").agg(F.min("source").alias("source"), F.min("task").alias("task")).select("record_id", F.concat_ws(" ", "source", "task").alias("label"))


@q(
    "caption_markup",
    """SELECT doc_id, trim(substr(text, 1, 2) || '||' || substr(text, 3, 5) || ' <coords_0>||' || substr(text, 8, 3) || '||' || substr(text, 11, 4) || ' <coords_1><coords_2>||') || substr(text, 15) AS marked
    FROM documents WHERE length(text) >= 20""",
)
def _(spark, folder):
    (d,) = read_tables(spark, folder, "documents")
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    spans = F.array(span(10, 14), span(2, 7), span(10, 14))
    return d.filter(F.length("text") >= 20).select("doc_id", curation.markup(F.col("text"), spans).alias("marked"))
