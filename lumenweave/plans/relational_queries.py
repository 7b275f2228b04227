"""Filters, joins, groupings, packing, augmentation and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenweave import catalog, schema
from lumenweave.operators import augment, curation, grouping, joins, packing, traces
from lumenweave.storage import read_tables

from .registry import Registry

R = Registry()
QUERIES, ORACLE, q = R.queries, R.oracle, R.query

_ONCE = "once AS (SELECT DISTINCT ON (record_id) * FROM records)"
#: A total order of line items, whose keys repeat.
_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
_ORDER_SQL = ", ".join(_ORDER)
_LINES = f"lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER_SQL}) AS pos FROM lineitem)"


def _lines(spark, folder):
    (l,) = read_tables(spark, folder, "lineitem")
    return l.withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)))


def _records(spark, folder, *columns):
    (r,) = read_tables(spark, folder, "records")
    return r.select("record_id", *columns).dropDuplicates(["record_id"])


# ---- filters and projections


@q(
    "to_record",
    """SELECT 'vqa' AS task, caption, source, '{"question_id":' || question_id || ',"image_id":' || coalesce(image_id::VARCHAR, 'null') || ',"note":null}' AS metadata
    FROM (SELECT DISTINCT question_id, image_id, question, NULL::VARCHAR AS caption, 'vqa_v2' AS source FROM vqa_questions)""",
)
def _(spark, folder):
    (v,) = read_tables(spark, folder, "vqa_questions")
    qa = F.array(F.struct(F.col("question").alias("question"), F.lit(None).cast("string").alias("answer")))
    meta = schema.pack_metadata(question_id=F.col("question_id"), image_id=F.col("image_id"), note=F.lit(None).cast("string"))
    records = schema.to_record(v.distinct(), task=F.lit("vqa"), source=F.lit("vqa_v2"), qa_pairs=qa, metadata=meta)
    return records.select("task", "caption", "source", "metadata")


@q("rename_at_scan", "SELECT question_id AS \"questionId\", image_id AS \"imageId\", count(*) AS n FROM vqa_questions GROUP BY ALL")
def _(spark, folder):
    (v,) = read_tables(spark, folder, "vqa_questions")
    return v.withColumnsRenamed({"question_id": "questionId", "image_id": "imageId"}).groupBy("questionId", "imageId").agg(F.count(F.lit(1)).alias("n"))


@q(
    "split_filter",
    f"""WITH {_ONCE} SELECT record_id, CASE split WHEN 'restval' THEN 'train' WHEN 'val' THEN 'validation' ELSE split END AS split FROM once WHERE split IN ('train', 'restval', 'val', 'validation')""",
)
def _(spark, folder):
    r = _records(spark, folder, schema.normal_split(F.col("split")).alias("split"))
    return r.filter(F.col("split").isin("train", "validation"))


@q("coded_split", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def _(spark, folder):
    (n,) = read_tables(spark, folder, "nation")
    codes = {"train": 1, "validation": 2, "test": 3}
    return n.filter(F.col("n_regionkey") == codes["validation"]).select("n_nationkey", "n_name")


@q(
    "keep_map_filter",
    "SELECT l_orderkey, count(*) AS n FROM lineitem JOIN (SELECT p_partkey, p_size > 25 AS keep FROM part) ON l_partkey = p_partkey WHERE keep GROUP BY l_orderkey",
)
def _(spark, folder):
    l, p = read_tables(spark, folder, "lineitem", "part")
    keep = p.select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") > 25).alias("keep"))
    return joins.enforced_join(l, keep, ["l_partkey"]).filter("keep").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@q("nonempty", f"WITH {_ONCE} SELECT record_id, len(qa_pairs)::INTEGER AS n FROM once WHERE len(qa_pairs) > 0")
def _(spark, folder):
    return _records(spark, folder, "qa_pairs").filter(F.size("qa_pairs") > 0).select("record_id", F.size("qa_pairs").alias("n"))


@q("row_patch", "SELECT n_nationkey, CASE WHEN n_nationkey = 7 THEN 'patched' ELSE n_name END AS n_name FROM nation")
def _(spark, folder):
    (n,) = read_tables(spark, folder, "nation")
    return n.select("n_nationkey", F.when(F.col("n_nationkey") == 7, "patched").otherwise(F.col("n_name")).alias("n_name"))


@q("index_slice", "SELECT o_orderkey, n FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n >= 100 AND n < 500")
def _(spark, folder):
    (o,) = read_tables(spark, folder, "orders")
    return joins.numbered(o.select("o_orderkey"), "o_orderkey", "n").filter("n >= 100 AND n < 500")


@q("skip_source", f"WITH {_ONCE} SELECT source, count(*) AS n FROM once WHERE source <> 'docvqa' GROUP BY source")
def _(spark, folder):
    return _records(spark, folder, "source").filter("source <> 'docvqa'").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@q("short_or_full", "SELECT p_partkey, 'short' AS arm, p_brand AS answer FROM part UNION ALL SELECT p_partkey, 'full', p_name FROM part")
def _(spark, folder):
    """One column or another by configuration; both arms."""
    (p,) = read_tables(spark, folder, "part")
    arms = [p.select("p_partkey", F.lit("short" if short else "full").alias("arm"), F.when(F.lit(short), F.col("p_brand")).otherwise(F.col("p_name")).alias("answer")) for short in (True, False)]
    return joins.union_all(arms)


@q(
    "payload_by_task",
    f"""WITH {_ONCE} SELECT task, count(*) AS n, count(*) FILTER (task IN ('captioning', 'image_text_match')) AS with_caption FROM once WHERE task <> 'relationship_detection' GROUP BY task""",
)
def _(spark, folder):
    r = _records(spark, folder, "task", "caption", "region", "qa_pairs", "chat")
    p = r.select("task", schema.payload(F.col("task"), F.col("caption"), F.col("region"), F.col("qa_pairs"), F.col("chat")).alias("p")).filter("p IS NOT NULL")
    return p.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.startswith("p", F.lit('{"caption"')) & ~F.contains("p", F.lit('"region":'))).alias("with_caption"))


@q(
    "first_existing",
    """WITH listing AS (SELECT DISTINCT image_path FROM images WHERE image_path LIKE 'coco/train%'), i AS (SELECT DISTINCT image_id, image_path AS a FROM images),
    c AS (SELECT image_id, a, replace(a, 'coco/val', 'coco/train') AS b FROM i)
    SELECT image_id, a, CASE WHEN a IN (SELECT image_path FROM listing) THEN a WHEN b IN (SELECT image_path FROM listing) THEN b END AS found_path FROM c""",
)
def _(spark, folder):
    (i,) = read_tables(spark, folder, "images")
    listing = i.filter("image_path LIKE 'coco/train%'")
    rows = i.select("image_id", F.col("image_path").alias("a")).distinct()
    return joins.first_existing(rows, [F.col("a"), F.replace(F.col("a"), F.lit("coco/val"), F.lit("coco/train"))], listing, "image_path")


# ---- joins


@q(
    "qa_join",
    """SELECT q.question_id, q.question, a.multiple_choice_answer FROM (SELECT DISTINCT question_id, question FROM vqa_questions) q
    JOIN (SELECT DISTINCT question_id, multiple_choice_answer FROM vqa_annotations) a ON q.question_id = a.question_id""",
)
def _(spark, folder):
    """Every question that must have an answer, with it; one without would fail."""
    questions, answers = read_tables(spark, folder, "vqa_questions", "vqa_annotations")
    asked = joins.semi_join(questions.select("question_id", "question").distinct(), answers, ["question_id"])
    return joins.enforced_join(asked, answers.select("question_id", "multiple_choice_answer").distinct(), ["question_id"])


@q("questions_without_answer", "SELECT DISTINCT question_id FROM vqa_questions q WHERE NOT EXISTS (SELECT 1 FROM vqa_annotations a WHERE a.question_id = q.question_id)")
def _(spark, folder):
    questions, answers = read_tables(spark, folder, "vqa_questions", "vqa_annotations")
    return joins.missing_keys(questions, answers, ["question_id"]).distinct()


@q(
    "ocr_join",
    """WITH last AS (SELECT c_custkey, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey)
    SELECT c.c_custkey, c.c_mktsegment, last.priority FROM customer c JOIN last ON c.c_custkey = last.c_custkey""",
)
def _(spark, folder):
    c, o = read_tables(spark, folder, "customer", "orders")
    right = o.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("priority"), "o_orderkey")
    return joins.last_wins_join(c, right, ["c_custkey"], "o_orderkey").select("c_custkey", "c_mktsegment", "priority")


@q(
    "three_way_grouped_join",
    """SELECT o_orderkey, n_lines, n_parts FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) a ON o_orderkey = a.l_orderkey
    JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS n_parts FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) b ON o_orderkey = b.l_orderkey""",
)
def _(spark, folder):
    o, l = read_tables(spark, folder, "orders", "lineitem")
    a = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    b = l.filter("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_partkey").alias("n_parts"))
    return joins.three_way_grouped_join(o.select("o_orderkey"), a, b, ["o_orderkey"])


@q(
    "last_wins_join",
    f"""WITH {_LINES}, e AS (SELECT l_partkey, arg_max(l_returnflag, struct_pack(a := l_shipdate, b := l_orderkey, c := pos)) AS flag FROM lines GROUP BY l_partkey)
    SELECT p_partkey, p_brand, flag FROM part JOIN e ON p_partkey = l_partkey""",
)
def _(spark, folder):
    (p,) = read_tables(spark, folder, "part")
    right = _lines(spark, folder).select(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("flag"), F.struct("l_shipdate", "l_orderkey", "pos").alias("at"))
    return joins.last_wins_join(p.select("p_partkey", "p_brand"), right, ["p_partkey"], "at").select("p_partkey", "p_brand", "flag")


@q("semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, folder):
    c, o = read_tables(spark, folder, "customer", "orders")
    return joins.semi_join(c, o.filter("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey", "c_name")


@q("anti_join_nulls", f"WITH {_ONCE} SELECT record_id, source FROM once r WHERE NOT EXISTS (SELECT 1 FROM mix_targets t WHERE t.source = r.source)")
def _(spark, folder):
    (t,) = read_tables(spark, folder, "mix_targets")
    return joins.anti_join_keep_nulls(_records(spark, folder, "source"), t, ["source"])


@q("train_test_anti", f"WITH {_ONCE}, t AS (SELECT record_id FROM once WHERE split = 'test') SELECT record_id FROM once r WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.record_id = r.record_id)")
def _(spark, folder):
    r = _records(spark, folder, "split")
    return joins.anti_join_keep_nulls(r.select("record_id"), r.filter("split = 'test'"), ["record_id"])


@q("selected_semi", "SELECT DISTINCT image_id, url FROM images WHERE image_id IN (SELECT image_id FROM documents WHERE lang = 'en') ")
def _(spark, folder):
    i, d = read_tables(spark, folder, "images", "documents")
    return joins.semi_join(i, d.filter("lang = 'en'").select("image_id").distinct(), ["image_id"]).select("image_id", "url").distinct()


@q(
    "positional_zip",
    """SELECT a.c_custkey, b.o_orderkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) a
    JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM (SELECT min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_orderkey % (SELECT count(*) FROM customer))) b ON a.n = b.n""",
)
def _(spark, folder):
    c, o = read_tables(spark, folder, "customer", "orders")
    right = o.groupBy((F.col("o_orderkey") % c.count()).alias("k")).agg(F.min("o_orderkey").alias("o_orderkey")).select("o_orderkey")
    return joins.positional_zip(c.select("c_custkey"), right, "c_custkey", "o_orderkey")


@q(
    "array_zip",
    """WITH a AS (SELECT l_orderkey, array_agg(DISTINCT l_partkey ORDER BY l_partkey) AS x, array_agg(DISTINCT l_suppkey ORDER BY l_suppkey) AS y FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, i AS pos, x[i + 1] AS a, y[i + 1] AS b FROM a, range(0, least(len(x), len(y))::BIGINT) AS t(i)""",
)
def _(spark, folder):
    (l,) = read_tables(spark, folder, "lineitem")
    a = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("x"), F.array_sort(F.collect_set("l_suppkey")).alias("y"))
    rows = a.select("l_orderkey", F.posexplode(augment.zipped(F.col("x"), F.col("y"))).alias("pos", "z"))
    return rows.select("l_orderkey", F.col("pos").cast("long").alias("pos"), "z.a", "z.b")


@q(
    "lookup_elements",
    "SELECT o_orderkey, a.c_name || '/' || coalesce(b.c_name, '-') AS names FROM orders LEFT JOIN customer a ON o_custkey = a.c_custkey LEFT JOIN customer b ON o_custkey + 7 = b.c_custkey",
)
def _(spark, folder):
    """Ids of an array looked up in a table of any size, their order kept."""
    o, c = read_tables(spark, folder, "orders", "customer")
    listed = o.select("o_orderkey", F.array("o_custkey", F.col("o_custkey") + 7).alias("ids"))
    found = joins.lookup_in_table(listed, ["o_orderkey"], "ids", c, "c_custkey", "c_name", "names")
    return found.select("o_orderkey", F.array_join(F.transform("names", lambda n: F.coalesce(n, F.lit("-"))), "/").alias("names"))


@q("position_lookup", "SELECT p_partkey, list_position(['ECONOMY', 'STANDARD', 'PROMO'], p_type)::BIGINT AS place FROM part WHERE p_type IN ('ECONOMY', 'STANDARD', 'PROMO')")
def _(spark, folder):
    (p,) = read_tables(spark, folder, "part")
    place = F.array_position(F.array(*[F.lit(x) for x in ("ECONOMY", "STANDARD", "PROMO")]), F.col("p_type"))
    return p.select("p_partkey", place.alias("place")).filter("place > 0")


# ---- groupings


@q(
    "majority_vote",
    """WITH v AS (SELECT DISTINCT question_id, answers FROM vqa_annotations), e AS (SELECT question_id, a.answer AS answer, a.answer_id AS pos FROM (SELECT question_id, unnest(answers) AS a FROM v) WHERE a IS NOT NULL),
    c AS (SELECT question_id, answer, count(*) AS n, min(pos) AS first FROM e GROUP BY ALL)
    SELECT question_id, answer AS winner, n FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, first) AS r FROM c) WHERE r = 1""",
)
def _(spark, folder):
    (a,) = read_tables(spark, folder, "vqa_annotations")
    e = a.select("question_id", "answers").distinct().select("question_id", F.explode("answers").alias("a")).filter("a IS NOT NULL")
    return grouping.majority_vote(e.select("question_id", "a.answer", F.col("a.answer_id").alias("pos")), ["question_id"], "answer", "pos")


@q(
    "run_group",
    f"""WITH {_LINES}, m AS (SELECT *, CASE WHEN pos = 1 OR l_returnflag <> lag(l_returnflag) OVER w THEN 1 ELSE 0 END AS new FROM lines WINDOW w AS (PARTITION BY l_orderkey ORDER BY pos)),
    g AS (SELECT l_orderkey, l_returnflag, sum(new) OVER (PARTITION BY l_orderkey ORDER BY pos) AS run_id FROM m)
    SELECT l_orderkey, l_returnflag, run_id::BIGINT AS run_id, count(*) AS n FROM g GROUP BY ALL""",
)
def _(spark, folder):
    runs = grouping.run_groups(_lines(spark, folder).select("l_orderkey", "l_returnflag", "pos"), "l_returnflag", "pos", ["l_orderkey"])
    return runs.groupBy("l_orderkey", "l_returnflag", "run_id").agg(F.count(F.lit(1)).alias("n"))


@q(
    "run_group_whole",
    """WITH m AS (SELECT *, CASE WHEN o_orderpriority IS DISTINCT FROM lag(o_orderpriority) OVER (ORDER BY o_orderkey) THEN 1 ELSE 0 END AS new FROM orders)
    SELECT o_orderkey, o_orderpriority, (sum(new) OVER (ORDER BY o_orderkey))::BIGINT AS run_id FROM m""",
)
def _(spark, folder):
    """Runs over the order of the whole table."""
    (o,) = read_tables(spark, folder, "orders")
    return grouping.run_groups(o.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey")


@q("group_collect", f"WITH {_LINES} SELECT l_orderkey, string_agg(l_returnflag, '' ORDER BY pos) AS flags FROM lines GROUP BY l_orderkey")
def _(spark, folder):
    got = grouping.group_collect(_lines(spark, folder), ["l_orderkey"], "l_returnflag", "pos")
    return got.select("l_orderkey", F.array_join("items", "").alias("flags"))


@q("sorted_group", "SELECT image_id, string_agg(question_id::VARCHAR, ',' ORDER BY question_id) AS questions FROM (SELECT DISTINCT image_id, question_id FROM vqa_questions) GROUP BY image_id")
def _(spark, folder):
    (v,) = read_tables(spark, folder, "vqa_questions")
    got = grouping.group_collect(v.select("image_id", "question_id").distinct(), ["image_id"], "question_id", "question_id")
    return got.select("image_id", F.array_join("items", ",").alias("questions"))


_PHRASES = f"""{_ONCE}, p AS (SELECT DISTINCT source AS shard, image.path AS item, lower(r.phrase) AS phrase FROM (SELECT source, image, unnest(region) AS r FROM once) WHERE r.phrase IS NOT NULL)"""


def _phrases(spark, folder):
    r = _records(spark, folder, "source", "image", "region").select(F.col("source").alias("shard"), F.col("image")["path"].alias("item"), F.explode("region").alias("r"))
    return r.select("shard", "item", F.lower("r.phrase").alias("phrase")).filter("phrase IS NOT NULL")


@q("inverted_index", f"WITH {_PHRASES} SELECT phrase, count(*) AS n_items, string_agg(item, ' ' ORDER BY item) AS items FROM (SELECT DISTINCT phrase, item FROM p WHERE item IS NOT NULL) GROUP BY phrase")
def _(spark, folder):
    got = grouping.inverted_index(_phrases(spark, folder).filter("item IS NOT NULL"), "item", "phrase")
    return got.select("phrase", F.size("items").cast("long").alias("n_items"), F.array_join("items", " ").alias("items"))


@q(
    "posting_lists",
    f"""WITH {_PHRASES}, d AS (SELECT DISTINCT phrase, item FROM p WHERE item IS NOT NULL AND phrase IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY item) - 1 AS k FROM d)
    SELECT phrase, k // 4 AS chunk, string_agg(item, ' ' ORDER BY item) AS items FROM n GROUP BY phrase, k // 4""",
)
def _(spark, folder):
    """The inverted index in lists of bounded length."""
    got = packing.posting_lists(_phrases(spark, folder).filter("item IS NOT NULL AND phrase IS NOT NULL"), "phrase", "item", 4)
    return got.select("phrase", "chunk", F.array_join("items", " ").alias("items"))


@q("phrase_frequency", f"WITH {_PHRASES} SELECT phrase, count(*) AS n FROM p GROUP BY phrase")
def _(spark, folder):
    return curation.phrase_frequency(_phrases(spark, folder), "phrase", "shard", "item")


@q(
    "frequency_cap",
    f"""WITH {_PHRASES}, d AS (SELECT DISTINCT phrase, item FROM p WHERE item IS NOT NULL),
    r AS (SELECT *, count(*) OVER (PARTITION BY phrase) AS n, row_number() OVER (PARTITION BY phrase ORDER BY md5(item), item) AS k FROM d) SELECT phrase, item FROM r WHERE n >= 3 AND k <= 8""",
)
def _(spark, folder):
    return curation.frequency_cap(_phrases(spark, folder).filter("item IS NOT NULL"), "phrase", "item", order=F.md5(F.encode("item", "utf-8")))


@q("distinct_images", f"WITH {_PHRASES} SELECT count(DISTINCT item) AS n FROM p")
def _(spark, folder):
    return _phrases(spark, folder).agg(F.count_distinct("item").alias("n"))


@q(
    "missing_share",
    f"""WITH {_PHRASES}, c AS (SELECT phrase, count(DISTINCT item) AS n FROM p GROUP BY phrase) SELECT count(*) FILTER (n < 3) AS n_missing, round(100.0 * count(*) FILTER (n < 3) / count(*), 2)::DOUBLE AS percent FROM c""",
)
def _(spark, folder):
    p = _phrases(spark, folder)
    kept = p.groupBy("phrase").agg(F.count_distinct("item").alias("n")).filter("n >= 3")
    return curation.missing_share(p, kept, ["phrase"])


@q("unique_only", "SELECT image_id, url FROM images WHERE url IN (SELECT url FROM images GROUP BY url HAVING count(*) = 1)")
def _(spark, folder):
    (i,) = read_tables(spark, folder, "images")
    return grouping.unique_only(i.filter("url IS NOT NULL").select("image_id", "url"), ["url"])


@q("dominant_share", "SELECT l_orderkey, round(max(n) / sum(n), 6) AS dominant_share FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def _(spark, folder):
    (l,) = read_tables(spark, folder, "lineitem")
    return grouping.dominant_share(l, ["l_orderkey"], "l_returnflag").select("l_orderkey", F.round("dominant_share", 6).alias("dominant_share"))


@q(
    "top_bottom_k",
    f"""WITH {_PHRASES}, c AS (SELECT phrase, count(*) AS n FROM p GROUP BY phrase), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, phrase) AS a, row_number() OVER (ORDER BY n, phrase) AS b FROM c)
    SELECT 'top' AS "end", a::INTEGER AS place, phrase, n FROM r WHERE a <= 10 UNION ALL SELECT 'bottom', b::INTEGER, phrase, n FROM r WHERE b <= 10""",
)
def _(spark, folder):
    return grouping.top_and_bottom(curation.phrase_frequency(_phrases(spark, folder), "phrase", "shard", "item"), "phrase", "n", 10)


@q(
    "rank_curve",
    f"""WITH {_PHRASES}, c AS (SELECT phrase, count(*) AS n FROM p GROUP BY phrase), r AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS k FROM c) SELECT min(k) AS first_rank, count(*) AS n_items, n FROM r GROUP BY n""",
)
def _(spark, folder):
    return grouping.rank_curve(curation.phrase_frequency(_phrases(spark, folder), "phrase", "shard", "item"), "n")


@q("trainable_sum", "SELECT p_size > 25 AS trainable, count(*) AS n, sum(p_size)::BIGINT AS total FROM part GROUP BY 1")
def _(spark, folder):
    (p,) = read_tables(spark, folder, "part")
    return p.groupBy((F.col("p_size") > 25).alias("trainable")).agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("total"))


@q("longest_list", f"WITH {_ONCE} SELECT record_id, greatest(coalesce(len(qa_pairs), 0), coalesce(len(region), 0), coalesce(len(relation), 0))::INTEGER AS longest FROM once")
def _(spark, folder):
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return _records(spark, folder, "qa_pairs", "region", "relation").select("record_id", F.greatest(size("qa_pairs"), size("region"), size("relation")).alias("longest"))


@q("total_rows", "SELECT (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM orders) AS n")
def _(spark, folder):
    l, o = read_tables(spark, folder, "lineitem", "orders")
    return joins.union_all([l.select(F.lit(1).alias("x")), o.select(F.lit(1).alias("x"))]).agg(F.count("x").alias("n"))


# ---- packing and order


@q(
    "pack_chunks",
    f"""WITH {_LINES} SELECT l_orderkey, (pos - 1) // 3 AS chunk, count(*) AS n, string_agg(l_partkey::VARCHAR, ',' ORDER BY pos) AS parts FROM lines GROUP BY ALL""",
)
def _(spark, folder):
    got = packing.pack(_lines(spark, folder), ["l_orderkey"], ["pos"], 3, "l_partkey")
    return got.select("l_orderkey", "chunk", F.size("items").cast("long").alias("n"), F.array_join("items", ",").alias("parts"))


@q(
    "pack_questions",
    """WITH v AS (SELECT DISTINCT image_id, question_id FROM vqa_questions), n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY question_id) - 1 AS k FROM v)
    SELECT image_id, k // 20 AS chunk, count(*) AS n, min(question_id) AS first FROM n GROUP BY ALL""",
)
def _(spark, folder):
    (v,) = read_tables(spark, folder, "vqa_questions")
    got = packing.pack(v.select("image_id", "question_id").distinct(), ["image_id"], ["question_id"], 20, "question_id")
    return got.select("image_id", "chunk", F.size("items").cast("long").alias("n"), F.array_min("items").alias("first"))


@q(
    "pack_array_chunks",
    f"""WITH {_ONCE}, a AS (SELECT record_id, region, len(region)::BIGINT AS n FROM once WHERE len(region) > 0)
    SELECT record_id, c AS chunk, least(2, n - c * 2) AS n_items FROM a, range(0, (n + 1) // 2) AS t(c)""",
)
def _(spark, folder):
    got = packing.pack_array(_records(spark, folder, "region"), "region", 2)
    return got.select("record_id", F.col("chunk").cast("long").alias("chunk"), F.size("items").cast("long").alias("n_items"))


@q(
    "pack_by_augmentation",
    f"""WITH {_LINES}, a AS (SELECT l_orderkey, slot, l_partkey, row_number() OVER (PARTITION BY l_orderkey, slot ORDER BY pos) - 1 AS k FROM lines, range(0, 4) AS t(slot))
    SELECT l_orderkey, slot::INTEGER AS slot, k // 3 AS chunk, string_agg(l_partkey::VARCHAR, ',' ORDER BY k) AS parts FROM a GROUP BY ALL""",
)
def _(spark, folder):
    rows = _lines(spark, folder).select("l_orderkey", "l_partkey", "pos", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("slot"))
    got = packing.pack(rows, ["l_orderkey", "slot"], ["pos"], 3, "l_partkey")
    return got.select("l_orderkey", "slot", "chunk", F.array_join("items", ",").alias("parts"))


@q(
    "unpack_index",
    f"""WITH {_ONCE} SELECT record_id, i AS pos, row_number() OVER (ORDER BY record_id, i) - 1 AS "index" FROM once, range(0, coalesce(len(qa_pairs), 0)::BIGINT) AS t(i)""",
)
def _(spark, folder):
    got = packing.unpack_index(_records(spark, folder, "qa_pairs"), ["record_id"], "qa_pairs")
    return got.select("record_id", F.col("pos").cast("long").alias("pos"), F.col("index").cast("long").alias("index"))


@q("repack_first_seen", "SELECT o_custkey, min(o_orderkey) AS first_pos, count(*) AS n FROM orders GROUP BY o_custkey")
def _(spark, folder):
    (o,) = read_tables(spark, folder, "orders")
    return packing.repack(o, "o_custkey", "o_orderkey").select("o_custkey", "first_pos", F.size("positions").cast("long").alias("n"))


@q(
    "overlap_detect",
    """WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber AS a, l_linenumber + l_quantity / 20 AS b FROM lineitem), n AS (SELECT l_orderkey, b > lead(a) OVER (PARTITION BY l_orderkey ORDER BY a, b) AS hit FROM s)
    SELECT l_orderkey, bool_or(coalesce(hit, false)) AS has_overlap FROM n GROUP BY l_orderkey""",
)
def _(spark, folder):
    (l,) = read_tables(spark, folder, "lineitem")
    spans = l.select("l_orderkey", F.col("l_linenumber").cast("double").alias("a"), (F.col("l_linenumber") + F.col("l_quantity") / 20).alias("b"))
    return curation.overlaps(spans, "l_orderkey", "a", "b")


@q(
    "running_offset",
    f"""WITH {_LINES} SELECT l_orderkey, pos, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS UNBOUNDED PRECEDING) - l_quantity AS "offset" FROM lines""",
)
def _(spark, folder):
    got = curation.running_offset(_lines(spark, folder).select("l_orderkey", "pos", "l_quantity"), "l_orderkey", "pos", "l_quantity")
    return got.select("l_orderkey", F.col("pos").cast("long").alias("pos"), "offset")


_POINT = "struct<x:double,y:double,t:double>"


def _points(spark, folder):
    """``record_id, trace`` with its points: one row for each trace that has some."""
    r = _records(spark, folder, "metadata").select("record_id", F.from_json("metadata", f"struct<traces:array<array<{_POINT}>>>")["traces"].alias("t"))
    return r.select("record_id", F.posexplode("t").alias("trace", "points")).filter(F.size("points") > 0)


_TRACES = f"""{_ONCE}, j AS (SELECT record_id, json_extract(metadata, '$.traces') AS t FROM once WHERE json_valid(metadata)),
o AS (SELECT record_id, i, json_extract(t, '$[' || i || ']') AS p FROM j, range(0, CASE WHEN json_type(t) = 'ARRAY' THEN json_array_length(t)::BIGINT ELSE 0 END) AS r(i)),
pts AS (SELECT record_id, i AS trace, k AS place, json_extract(p, '$[' || k || '].x')::DOUBLE AS x, json_extract(p, '$[' || k || '].y')::DOUBLE AS y, json_extract(p, '$[' || k || '].t')::DOUBLE AS t
FROM o, range(0, CASE WHEN json_type(p) = 'ARRAY' THEN json_array_length(p)::BIGINT ELSE 0 END) AS r(k))"""


@q("trace_segments_tumbling", f"WITH {_TRACES} SELECT record_id, trace, floor(t / 0.5)::BIGINT AS segment, count(*) AS n FROM pts GROUP BY ALL")
def _(spark, folder):
    p = _points(spark, folder).select("record_id", F.col("trace").cast("long").alias("trace"), F.explode("points").alias("p"))
    return p.groupBy("record_id", "trace", traces.tumbling_segment(F.col("p.t"), 0.5).alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@q("trace_segments_exact")  # a sequential scan; tested against the definition
def _(spark, folder):
    keyed = _points(spark, folder).withColumn("key", F.concat_ws("/", F.col("record_id").cast("string"), F.col("trace").cast("string")))
    return traces.segment_trace(keyed, "key", "points", 0.4)


@q("clamp_scale", f"WITH {_TRACES} SELECT record_id, trace, place, round(least(greatest(x, 0), 1) * 640, 6) + 0.0::DOUBLE AS x, round(least(greatest(y, 0), 1) * 480, 6) + 0.0::DOUBLE AS y FROM pts")
def _(spark, folder):
    p = _points(spark, folder).select("record_id", F.col("trace").cast("long").alias("trace"), F.posexplode(traces.clamp_scale(F.col("points"), F.lit(640), F.lit(480))).alias("place", "p"))
    return p.select("record_id", "trace", F.col("place").cast("long").alias("place"), (F.round("p.x", 6) + 0.0).alias("x"), (F.round("p.y", 6) + 0.0).alias("y"))  # no negative zeros


@q("segment_midpoint", f"WITH {_TRACES}, n AS (SELECT record_id, trace, count(*) // 2 AS m FROM pts GROUP BY ALL) SELECT n.record_id, n.trace, pts.t FROM n JOIN pts ON n.record_id = pts.record_id AND n.trace = pts.trace AND place = m")
def _(spark, folder):
    return _points(spark, folder).select("record_id", F.col("trace").cast("long").alias("trace"), traces.midpoint(F.col("points"))["t"].alias("t"))


@q("topk_area", "SELECT l_orderkey, string_agg(area::VARCHAR, ',' ORDER BY area DESC) AS areas FROM (SELECT l_orderkey, (l_quantity * l_linenumber)::BIGINT AS area, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity * l_linenumber DESC) AS r FROM lineitem) WHERE r <= 3 GROUP BY l_orderkey")
def _(spark, folder):
    (l,) = read_tables(spark, folder, "lineitem")
    area = (F.col("l_quantity") * F.col("l_linenumber")).cast("long")
    ranked = l.select("l_orderkey", area.alias("area")).withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("area"))))
    kept = ranked.filter("r <= 3").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list("area"), asc=False), ",").alias("areas"))
    return kept


@q("sort_by_stem", "SELECT DISTINCT image_path, TRY_CAST(regexp_extract(image_path, '([0-9]+)[^0-9/]*$', 1) AS BIGINT) AS stem FROM images")
def _(spark, folder):
    (i,) = read_tables(spark, folder, "images")
    stem = F.regexp_extract("image_path", r"([0-9]+)[^0-9/]*$", 1).try_cast("long")
    return i.select("image_path", stem.alias("stem")).distinct().orderBy("stem", "image_path")


@q("sort_by_size", f"WITH {_PHRASES} SELECT phrase, count(DISTINCT item) AS n FROM p GROUP BY phrase")
def _(spark, folder):
    return _phrases(spark, folder).groupBy("phrase").agg(F.count_distinct("item").alias("n")).orderBy("n", "phrase")


@q("hashed_order", "SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS h, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(o_orderkey::VARCHAR)) AS place FROM orders")
def _(spark, folder):
    (o,) = read_tables(spark, folder, "orders")
    h = F.md5(F.encode(F.col("o_orderkey").cast("string"), "utf-8"))
    return o.select("o_orderkey", "o_custkey", h.alias("h")).withColumn("place", F.row_number().over(Window.partitionBy("o_custkey").orderBy("h")).cast("long")).drop("o_custkey")


@q("hash_split", "SELECT o_orderkey, CASE WHEN ('0x' || substr(md5('11:' || o_orderkey), 1, 8))::BIGINT % 1000000 < 900000 THEN 'train' ELSE 'validation' END AS new_split FROM orders")
def _(spark, folder):
    (o,) = read_tables(spark, folder, "orders")
    return curation.hash_split(o.select("o_orderkey"), "o_orderkey", portable=True)


@q("template_choice", "SELECT p_partkey, (['first', 'second', 'third'])[p_partkey % 3 + 1] AS template FROM part")
def _(spark, folder):
    (p,) = read_tables(spark, folder, "part")
    return p.select("p_partkey", F.element_at(F.array(*[F.lit(x) for x in ("first", "second", "third")]), (F.pmod("p_partkey", F.lit(3)) + 1).cast("int")).alias("template"))


# ---- sets and unions


@q("subset_union", f"WITH {_ONCE} SELECT source, task, count(*) AS n FROM once WHERE source IN ('coco', 'gqa', 'vqa_v2') AND split = 'train' GROUP BY ALL")
def _(spark, folder):
    r = _records(spark, folder, "source", "task", "split")
    load = lambda name: lambda task, split: r.filter((F.col("source") == name) & (F.col("split") == split) & (F.col("task") == task))
    loaders = {c: load(c) for c in ("coco", "gqa", "vqa_v2")}
    parts = joins.union_all([catalog.subset(loaders, c, "train") for c in loaders])
    return parts.groupBy("source", "task").agg(F.count(F.lit(1)).alias("n"))


@q("concat_splits", f"WITH {_ONCE} SELECT split, count(*) AS n FROM once WHERE split IN ('teststd', 'testdev') GROUP BY split")
def _(spark, folder):
    r = _records(spark, folder, "split")
    return joins.union_all([r.filter("split = 'teststd'"), r.filter("split = 'testdev'")]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@q("distinct_spans", "SELECT DISTINCT l_linenumber AS a, l_quantity AS b FROM lineitem")
def _(spark, folder):
    (l,) = read_tables(spark, folder, "lineitem")
    return l.select(F.col("l_linenumber").alias("a"), F.col("l_quantity").alias("b")).distinct()


@q("two_iterators", "SELECT 'pointing' AS kind, p_partkey AS k FROM part UNION ALL SELECT 'telling', s_suppkey FROM supplier")
def _(spark, folder):
    p, s = read_tables(spark, folder, "part", "supplier")
    return joins.union_all([p.select(F.lit("pointing").alias("kind"), F.col("p_partkey").alias("k")), s.select(F.lit("telling").alias("kind"), F.col("s_suppkey").alias("k"))])


@q("key_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def _(spark, folder):
    p, l = read_tables(spark, folder, "part", "lineitem")
    return joins.key_difference(p, l.filter("l_returnflag = 'R'").withColumnRenamed("l_partkey", "p_partkey"), ["p_partkey"])


# ---- row multipliers


@q("explode_captions", f"WITH {_ONCE}, c AS (SELECT record_id, string_split(caption, '. ') AS s FROM once WHERE caption IS NOT NULL) SELECT record_id, i AS pos, s[i + 1] AS sentence FROM c, range(0, len(s)::BIGINT) AS t(i)")
def _(spark, folder):
    c = _records(spark, folder, "caption").filter("caption IS NOT NULL").select("record_id", F.split("caption", r"\. ").alias("s"))
    ids = F.transform("s", lambda _, i: i)
    rows = c.select("record_id", F.inline(augment.zipped(ids, F.col("s"))))
    return rows.select("record_id", F.col("a").cast("long").alias("pos"), F.col("b").alias("sentence"))


@q(
    "explode_regions",
    f"""WITH {_ONCE} SELECT record_id, CASE WHEN split = 'test' THEN i ELSE 0 END AS part, count(*) AS n FROM once, range(0, coalesce(len(region), 0)::BIGINT) AS t(i) WHERE split IS NOT NULL GROUP BY ALL""",
)
def _(spark, folder):
    r = _records(spark, folder, "split", "region").filter("split IS NOT NULL AND size(region) > 0")
    return augment.explode_regions(r, "region", "split", ["test"]).select("record_id", F.col("part").cast("long").alias("part"), F.size("region").cast("long").alias("n"))


_MCQ = f"""{_ONCE}, m AS (SELECT record_id, qa_pairs[1].answer AS answer, json_extract_string(metadata, '$.choices[*]') AS c FROM once WHERE json_valid(metadata) AND task = 'multiple_choice_vqa'),
w AS (SELECT record_id, answer, c, list_position(c, answer)::BIGINT - 1 AS k FROM m WHERE list_contains(c, answer))"""


def _mcq(spark, folder):
    r = _records(spark, folder, "task", "qa_pairs", "metadata").filter("task = 'multiple_choice_vqa'")
    c = r.select("record_id", F.get("qa_pairs", F.lit(0))["answer"].alias("answer"), F.from_json("metadata", "struct<choices:array<string>>")["choices"].alias("c"))
    return c.filter(F.array_contains("c", F.col("answer"))).withColumn("k", F.array_position("c", F.col("answer")) - 1)


@q(
    "choice_swap",
    f"""WITH {_MCQ}, s AS (SELECT record_id, s AS slot, list_transform(c, lambda x, j: CASE WHEN j - 1 = s THEN c[k + 1] WHEN j - 1 = k THEN c[s + 1] ELSE x END) AS c FROM w, range(0, len(c)::BIGINT) AS t(s))
    SELECT record_id, slot, array_to_string(c, '|') AS choices FROM s""",
)
def _(spark, folder):
    got = augment.swap_choices(_mcq(spark, folder).select("record_id", "c", "k"), "c", "k")
    return got.select("record_id", F.col("slot").cast("long").alias("slot"), F.array_join("c", "|").alias("choices"))


@q(
    "choice_insert",
    f"""WITH {_MCQ}, o AS (SELECT record_id, answer, list_filter(c, lambda x: x <> answer) AS c FROM w)
    SELECT record_id, s AS slot, array_to_string(list_concat(list_concat(c[1:s], [answer]), c[s + 1:]), '|') AS choices FROM o, range(0, len(c)::BIGINT + 1) AS t(s)""",
)
def _(spark, folder):
    wrong = _mcq(spark, folder).select("record_id", "answer", F.expr("filter(c, x -> x <> answer)").alias("c"))
    got = augment.insert_choice(wrong, "c", "answer")
    return got.select("record_id", F.col("slot").cast("long").alias("slot"), F.array_join("c", "|").alias("choices"))


@q("transpose_augmentation", f"WITH {_LINES} SELECT l_orderkey, slot::INTEGER AS slot, string_agg((l_partkey + slot)::VARCHAR, ',' ORDER BY pos) AS items FROM lines, range(0, 3) AS t(slot) GROUP BY ALL")
def _(spark, folder):
    rows = _lines(spark, folder).select("l_orderkey", "pos", "l_partkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("slot")).withColumn("item", F.col("l_partkey") + F.col("slot"))
    return augment.transpose(rows, ["l_orderkey"], "pos", "slot", "item").select("l_orderkey", "slot", F.array_join("items", ",").alias("items"))


@q("flatten", "SELECT vec_id, 64 AS n, round((embedding[1] + embedding[64])::DOUBLE, 5) AS ends FROM embeddings")
def _(spark, folder):
    (e,) = read_tables(spark, folder, "embeddings")
    flat = F.flatten(packing.array_chunks(F.col("embedding"), 10))
    return e.select("vec_id", F.size(flat).alias("n"), F.round((F.get(flat, F.lit(0)) + F.element_at(flat, -1)).cast("double"), 5).alias("ends"))


@q("regions_from_chunks", "SELECT doc_id, round(0.1 * 640, 4)::DOUBLE AS x1, substr(text, 3, 5) AS phrase, 0 AS number FROM documents WHERE length(text) >= 20 UNION ALL SELECT doc_id, round(0.5 * 640, 4)::DOUBLE, substr(text, 11, 4), 1 FROM documents WHERE length(text) >= 20")
def _(spark, folder):
    (d,) = read_tables(spark, folder, "documents")

    def chunk(a, b, x):
        return F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(x).alias("x1"), F.lit(0.2).alias("y1"), F.lit(0.3).alias("x2"), F.lit(0.4).alias("y2"))

    regions = augment.regions_from_chunks(F.array(chunk(10, 14, 0.5), chunk(2, 7, 0.1)), F.col("text"), F.lit(640), F.lit(480))
    rows = d.filter(F.length("text") >= 20).select("doc_id", F.explode(regions).alias("r"))
    return rows.select("doc_id", F.round(F.col("r.bbox")[0], 4).alias("x1"), "r.phrase", "r.number")


@q(
    "relation_boxes",
    f"""WITH {_ONCE} SELECT record_id, count(*) AS n, count(*) FILTER (len(r.subject_bbox) = 4 AND len(r.object_bbox) = 4) AS n_whole FROM (SELECT record_id, unnest(relation) AS r FROM once) WHERE r IS NOT NULL GROUP BY record_id""",
)
def _(spark, folder):
    r = _records(spark, folder, "relation").select("record_id", F.explode("relation").alias("r")).filter("r IS NOT NULL")
    whole = F.count_if((F.size("r.subject_bbox") == 4) & (F.size("r.object_bbox") == 4))
    return r.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), whole.alias("n_whole"))
