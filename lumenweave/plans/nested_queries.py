"""Queries of problem 4: deeply nested records as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.operators import nested
from lumenweave.storage import read_tables


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    (records,) = read_tables(spark, folder, "records")
    return nested.child_nodes(records)


def p4_variants(spark: SparkSession, folder: str) -> DataFrame:
    """How many records have each structural variant."""
    (records,) = read_tables(spark, folder, "records")
    return nested.structural_variants(records).groupBy("shape").agg(F.count(F.lit(1)).alias("n_records"))


def _subtype(child: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        (records,) = read_tables(spark, folder, "records")
        return nested.subtype_table(nested.child_nodes(records, with_node=True), child)

    return query


def _variant(child: str, name: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        (records,) = read_tables(spark, folder, "records")
        return nested.variant_table(nested.child_nodes(records, with_node=True), child, name)

    return query


def p4_other(spark: SparkSession, folder: str) -> DataFrame:
    """The list elements of a state that no typed table has, with their raw values."""
    (records,) = read_tables(spark, folder, "records")
    return nested.other_table(nested.child_nodes(records, with_node=True))


def _native(child: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        (records,) = read_tables(spark, folder, "records")
        return nested.native_table(records, child)

    return query


QUERIES = {
    "p4_found": p4_found,
    "p4_variants": p4_variants,
    **{f"p4_{c}": _subtype(c) for c in nested.SUBTYPES},
    **{f"p4_{c}": _native(c) for c in nested.NATIVE},
    **{f"p4_{c}_{v}": _variant(c, v) for c, variants in nested.VARIANTS.items() for v in variants},
    "p4_other": p4_other,
}

_ONCE = "once AS (SELECT DISTINCT ON (record_id) * FROM records)"
_JSON = "m AS (SELECT record_id, CASE WHEN json_valid(metadata) THEN metadata::JSON END AS j FROM once)"


def _flat_sql(child: str, path: str) -> str:
    return f"""SELECT record_id, '{child}' AS child, i AS pos, -1::BIGINT AS sub_pos
    FROM (SELECT record_id, json_extract(j, '{path}') AS l FROM m), range(0, CASE WHEN json_type(l) = 'ARRAY' THEN json_array_length(l)::BIGINT ELSE 0 END) AS t(i)
    WHERE json_type(json_extract(l, '$[' || i || ']')) <> 'NULL'"""


def _nested_sql(child: str, path: str) -> str:
    return f"""SELECT record_id, '{child}' AS child, i AS pos, k AS sub_pos
    FROM (SELECT record_id, i, json_extract(l, '$[' || i || ']') AS e
          FROM (SELECT record_id, json_extract(j, '{path}') AS l FROM m), range(0, CASE WHEN json_type(l) = 'ARRAY' THEN json_array_length(l)::BIGINT ELSE 0 END) AS t(i)),
         range(0, CASE WHEN json_type(e) = 'ARRAY' THEN json_array_length(e)::BIGINT ELSE 0 END) AS u(k)
    WHERE json_type(json_extract(e, '$[' || k || ']')) <> 'NULL'"""


def _native_sql(child: str) -> str:
    return f"""SELECT record_id, '{child}' AS child, i AS pos, -1::BIGINT AS sub_pos
    FROM once, range(0, coalesce(len({child}), 0)) AS t(i) WHERE {child}[i + 1] IS NOT NULL"""


ORACLE = {
    "p4_found": f"WITH {_ONCE}, {_JSON} "
    + " UNION ALL ".join([_native_sql(c) for c in nested.NATIVE] + [_flat_sql(c, p) for c, p in nested.FLAT_PATHS.items()] + [_nested_sql(c, p) for c, p in nested.NESTED_PATHS.items()]),
    "p4_qa_pairs": f"WITH {_ONCE} SELECT record_id, i AS pos, qa_pairs[i + 1].question AS question, qa_pairs[i + 1].answer AS answer FROM once, range(0, coalesce(len(qa_pairs), 0)) AS t(i) WHERE qa_pairs[i + 1] IS NOT NULL",
    "p4_timed_caption": f"""WITH {_ONCE}, {_JSON}
    SELECT record_id, i AS pos, -1::BIGINT AS sub_pos, 'object' AS state, json_extract_string(e, '$.utterance') AS utterance,
           TRY_CAST(json_extract(e, '$.start_time') AS DOUBLE) AS start_time, TRY_CAST(json_extract(e, '$.end_time') AS DOUBLE) AS end_time
    FROM (SELECT record_id, i, json_extract(l, '$[' || i || ']') AS e
          FROM (SELECT record_id, json_extract(j, '$.timed_caption') AS l FROM m), range(0, CASE WHEN json_type(l) = 'ARRAY' THEN json_array_length(l)::BIGINT ELSE 0 END) AS t(i))
    WHERE json_type(e) <> 'NULL'""",
}

_STATE = "CASE json_type(e) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END"


def _elements(child: str) -> str:
    """``x``: the record, the place and the value ``e`` of every element of a metadata list."""
    if child in nested.FLAT_PATHS:
        return f"""{_ONCE}, {_JSON}, x AS (SELECT * FROM (SELECT record_id, i AS pos, -1::BIGINT AS sub_pos, json_extract(l, '$[' || i || ']') AS e
        FROM (SELECT record_id, json_extract(j, '{nested.FLAT_PATHS[child]}') AS l FROM m), range(0, CASE WHEN json_type(l) = 'ARRAY' THEN json_array_length(l)::BIGINT ELSE 0 END) AS t(i)) WHERE json_type(e) <> 'NULL')"""
    return f"""{_ONCE}, {_JSON}, x AS (SELECT * FROM (SELECT record_id, pos, k AS sub_pos, json_extract(o, '$[' || k || ']') AS e FROM (SELECT record_id, i AS pos, json_extract(l, '$[' || i || ']') AS o
        FROM (SELECT record_id, json_extract(j, '{nested.NESTED_PATHS[child]}') AS l FROM m), range(0, CASE WHEN json_type(l) = 'ARRAY' THEN json_array_length(l)::BIGINT ELSE 0 END) AS t(i)),
        range(0, CASE WHEN json_type(o) = 'ARRAY' THEN json_array_length(o)::BIGINT ELSE 0 END) AS u(k)) WHERE json_type(e) <> 'NULL')"""


def _text(path: str, name: str) -> str:
    return f"CASE WHEN json_type(e) = 'OBJECT' AND json_type(e, '{path}') <> 'NULL' THEN json_extract_string(e, '{path}') END AS {name}"


def _number(path: str, name: str) -> str:
    return f"CASE WHEN json_type(e) = 'OBJECT' THEN TRY_CAST(json_extract_string(e, '{path}') AS DOUBLE) + 0 END AS {name}"


def _or_itself(path: str, name: str) -> str:
    return f"CASE WHEN json_type(e) = 'VARCHAR' THEN json_extract_string(e, '$') WHEN json_type(e) = 'OBJECT' AND json_type(e, '{path}') <> 'NULL' THEN json_extract_string(e, '{path}') END AS {name}"


_COLUMNS = {
    "ocr_info": [_or_itself("$.word", "word"), _number("$.bounding_box.top_left_x", "top_left_x"), _number("$.bounding_box.top_left_y", "top_left_y"), _number("$.bounding_box.width", "width")],
    "timed_caption": [_text("$.utterance", "utterance"), _number("$.start_time", "start_time"), _number("$.end_time", "end_time")],
    "answers": [_or_itself("$.answer", "answer"), _text("$.answer_confidence", "confidence")],
    "traces": [_number("$.x", "x"), _number("$.y", "y"), _number("$.t", "t")],
}
_NUMBERS = "('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')"


def _fields_are(texts: list[str], numbers: list[str], path: str = "$") -> str:
    """The object has these fields and no other, of these kinds."""
    names = ", ".join(f"'{n}'" for n in sorted(texts + [n.split(".")[0] for n in numbers]))
    kinds = [f"json_type(e, '{path}.{n}') = 'VARCHAR'" for n in texts] + [f"json_type(e, '{path}.{n}') IN {_NUMBERS}" for n in numbers]
    return " AND ".join([f"json_type(e, '{path}') = 'OBJECT'", f"list_sort(json_keys(e, '{path}')) = [{names}]", *kinds])


_BOXED = f"json_type(e) = 'OBJECT' AND list_sort(json_keys(e)) = ['bounding_box', 'word'] AND json_type(e, '$.word') = 'VARCHAR' AND {_fields_are([], ['top_left_x', 'top_left_y', 'width'], '$.bounding_box')}"
_SHAPES = {
    "ocr_info": {"boxed": _BOXED, "unboxed": _fields_are(["word"], []), "string": "json_type(e) = 'VARCHAR'"},
    "timed_caption": {"spoken": _fields_are(["utterance"], ["end_time", "start_time"])},
    "answers": {"rated": _fields_are(["answer", "answer_confidence"], []), "unrated": _fields_are(["answer"], []), "string": "json_type(e) = 'VARCHAR'"},
    "traces": {"point": _fields_are([], ["t", "x", "y"])},
}
for _child, _columns in _COLUMNS.items():
    ORACLE[f"p4_{_child}"] = f"WITH {_elements(_child)} SELECT record_id, pos, sub_pos, {_STATE} AS state, {', '.join(_columns)} FROM x"
    for _name, _condition in _SHAPES[_child].items():
        _kept = [c for c in _columns if c.rsplit(" AS ", 1)[1] in nested.VARIANTS[_child][_name][2]]
        ORACLE[f"p4_{_child}_{_name}"] = f"WITH {_elements(_child)} SELECT record_id, '{_child}' AS child, pos, sub_pos, {', '.join(_kept)} FROM x WHERE {_condition}"


def _box(field: str, prefix: str) -> str:
    corners = ", ".join(f"r.{field}[{i}] AS {prefix}{c}" for i, c in enumerate(("x1", "y1", "x2", "y2"), 1))
    return f"{corners}, len(r.{field})::INTEGER AS {prefix}n_coords, CASE WHEN len(r.{field}) > 4 THEN r.{field}[5:]::VARCHAR END AS {prefix}more_coords"


_ROWS = "(SELECT record_id, i AS pos, {0}[i + 1] AS r FROM once, range(0, coalesce(len({0}), 0)) AS t(i)) WHERE r IS NOT NULL"
ORACLE["p4_region"] = f"WITH {_ONCE} SELECT record_id, pos, {_box('bbox', '')}, r.phrase AS phrase FROM {_ROWS.format('region')}"
ORACLE["p4_relation"] = f"WITH {_ONCE} SELECT record_id, pos, r.subject_name AS subject_name, {_box('subject_bbox', 'subject_')}, r.object_name AS object_name, {_box('object_bbox', 'object_')}, r.predicate AS predicate FROM {_ROWS.format('relation')}"
