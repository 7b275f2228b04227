"""Deeply nested records as flat tables with parent-child links.

Structural-variant tables. A bottom-up tree automaton gives each JSON node a
state from its kind and its children's states; the states of a record's list
nodes are its structural variant. Elements are routed by state to typed
subtype tables, which share the supertype's keys ``record_id, child, pos,
sub_pos`` and the element's ``state``. All of it is Column expressions over one
scan; no Python runs per row.

Defined cases: null lists and lists with only null elements give no rows;
metadata that does not parse, or is no object, has no lists; a field that is
not a list where one is expected gives no rows; repeated rows of a record
count once; extra columns are ignored; an empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.metadata import variant

NATIVE = ("qa_pairs", "region", "relation")
#: child -> path of its list in the metadata; the nested ones are lists of lists.
FLAT_PATHS = {"ocr_info": "$.ocr.ocr_info", "timed_caption": "$.timed_caption"}
NESTED_PATHS = {"answers": "$.answers", "traces": "$.traces"}
#: Typed columns of the subtype tables: state of the element -> column -> path in it ("" is the element itself).
SUBTYPES = {
    "ocr_info": {"object": {"word": "$.word string", "top_left_x": "$.bounding_box.top_left_x double", "top_left_y": "$.bounding_box.top_left_y double", "width": "$.bounding_box.width double"}, "string": {"word": "$ string"}},
    "timed_caption": {"object": {"utterance": "$.utterance string", "start_time": "$.start_time double", "end_time": "$.end_time double"}},
    "answers": {"object": {"answer": "$.answer string", "confidence": "$.answer_confidence string"}, "string": {"answer": "$ string"}},
    "traces": {"object": {"x": "$.x double", "y": "$.y double", "t": "$.t double"}},
}
#: Structural variants with a table of their own: child -> variant -> state, kind, and typed columns of that kind. All other states go to ``OTHER``.
VARIANTS = {
    "ocr_info": {
        "boxed": ("OBJECT<bounding_box: OBJECT<top_left_x: NUMBER, top_left_y: NUMBER, width: NUMBER>, word: STRING>", "object", ("word", "top_left_x", "top_left_y", "width")),
        "unboxed": ("OBJECT<word: STRING>", "object", ("word",)),
        "string": ("STRING", "string", ("word",)),
    },
    "timed_caption": {"spoken": ("OBJECT<end_time: NUMBER, start_time: NUMBER, utterance: STRING>", "object", ("utterance", "start_time", "end_time"))},
    "answers": {"rated": ("OBJECT<answer: STRING, answer_confidence: STRING>", "object", ("answer", "confidence")), "unrated": ("OBJECT<answer: STRING>", "object", ("answer",)), "string": ("STRING", "string", ("answer",))},
    "traces": {"point": ("OBJECT<t: NUMBER, x: NUMBER, y: NUMBER>", "object", ("x", "y", "t"))},
}
OTHER, STRUCT = "other", "struct"


def variant_state(node: Column) -> Column:
    """The state of a node with its field names, in order, and their states; numbers of all kinds have one state."""
    return F.regexp_replace(F.schema_of_variant(node), r"\b(?:BIGINT|FLOAT|DOUBLE|DECIMAL\(\d+,\d+\))(?=[,>]|$)", "NUMBER")


def subtype_of(child: str, node: Column) -> Column:
    """The table that an element of the list is routed to."""
    if child in NATIVE:
        return F.lit(STRUCT)
    state, out = variant_state(node), F.lit(OTHER)
    for name, (wanted, _, _) in VARIANTS[child].items():
        out = F.when(state == wanted, name).otherwise(out)
    return out


def node_state(node: Column) -> Column:
    """Leaf transitions of the automaton: the state of a node from its kind.

    absent, null, boolean, number, string, object, list.
    """
    kind = F.schema_of_variant(node)
    return (
        F.when(node.isNull(), "absent")
        .when(kind == "VOID", "null")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .otherwise("number")
    )


def _set_of(states: Column) -> Column:
    return F.concat(F.lit("<"), F.array_join(F.array_sort(F.array_distinct(states)), "|"), F.lit(">"))


def list_state(node: Column, depth: int) -> Column:
    """Inner transition: a list's state is ``list`` and the set of its children's states, to ``depth`` levels; an object's state has its fields and theirs."""
    items = F.try_variant_get(node, "$", "array<variant>")
    if depth > 1:
        child = lambda x: F.when(F.schema_of_variant(x).startswith("ARRAY"), list_state(x, depth - 1)).otherwise(variant_state(x))
    else:
        child = variant_state
    return F.when(items.isNotNull(), F.concat(F.lit("list"), _set_of(F.transform(items, child)))).otherwise(node_state(node))


def _accepted(state: Column) -> Column:
    """Final states of an element: it is there and is not null."""
    return ~state.isin("absent", "null")


def _node(child: str, pos: Column, sub_pos: Column, state: Column, subtype: Column, node: Column) -> Column:
    return F.struct(F.lit(child).alias("child"), pos.cast("long").alias("pos"), sub_pos.cast("long").alias("sub_pos"), state.alias("state"), subtype.alias("subtype"), node.alias("node"))


def _nothing(with_node: bool) -> Column:
    kind = "array<struct<child:string,pos:bigint,sub_pos:bigint,state:string,subtype:string,node:" + ("variant" if with_node else "int") + ">>"
    return F.array().cast(kind)


def _native(name: str, with_node: bool) -> Column:
    null = F.lit(None).cast("variant" if with_node else "int")
    nodes = F.transform(F.col(name), lambda x, i: F.when(x.isNotNull(), _node(name, i, F.lit(-1), F.lit("object"), subtype_of(name, null), null)))
    return F.filter(nodes, lambda n: n.isNotNull())


def _flat(child: str, path: str, with_node: bool) -> Column:
    items = F.try_variant_get(F.col("_v"), path, "array<variant>")
    payload = (lambda x: x) if with_node else (lambda x: F.lit(None).cast("int"))
    nodes = F.transform(items, lambda x, i: F.when(_accepted(node_state(x)), _node(child, i, F.lit(-1), node_state(x), subtype_of(child, x), payload(x))))
    return F.filter(nodes, lambda n: n.isNotNull())


def _two_levels(child: str, path: str, with_node: bool) -> Column:
    outer = F.try_variant_get(F.col("_v"), path, "array<variant>")
    payload = (lambda x: x) if with_node else (lambda x: F.lit(None).cast("int"))

    def inner(x: Column, i: Column) -> Column:
        items = F.try_variant_get(x, "$", "array<variant>")  # null unless the node's state is list
        return F.coalesce(F.transform(items, lambda y, j: F.when(_accepted(node_state(y)), _node(child, i, j, node_state(y), subtype_of(child, y), payload(y)))), _nothing(with_node))

    return F.filter(F.flatten(F.transform(outer, inner)), lambda n: n.isNotNull())


def structural_variants(records: DataFrame) -> DataFrame:
    """``record_id`` and ``shape``: the automaton's states of the record's lists, one row for each record."""
    native = [F.concat(F.lit(f"{c}:"), F.when(F.col(c).isNull(), "null").otherwise(F.concat(F.lit("list"), _set_of(F.transform(F.col(c), lambda x: F.when(x.isNull(), "null").otherwise("object")))))) for c in NATIVE]
    flat = [F.concat(F.lit(f"{c}:"), list_state(F.try_variant_get(F.col("_v"), p, "variant"), 1)) for c, p in FLAT_PATHS.items()]
    nested = [F.concat(F.lit(f"{c}:"), list_state(F.try_variant_get(F.col("_v"), p, "variant"), 2)) for c, p in NESTED_PATHS.items()]
    v = records.select("record_id", *NATIVE, variant(F.col("metadata")).alias("_v"))
    shaped = v.select("record_id", F.concat_ws(" ", F.when(F.col("_v").isNull(), "unparsed").otherwise("parsed"), *native, *flat, *nested).alias("shape"))
    return shaped.groupBy("record_id").agg(F.min("shape").alias("shape"))


def child_nodes(records: DataFrame, *, with_node: bool = False) -> DataFrame:
    """The supertype table: ``record_id, child, pos, sub_pos`` of every element of a subtype table, that is, of every non-null list element.

    ``with_node`` adds the element's ``state``, its ``subtype`` and, for metadata lists, its value as a variant.
    Repeated rows of a record are dropped before the lists are exploded, so only a
    compact array of positions and tables is shuffled for each record.
    """
    v = records.select("record_id", *NATIVE, variant(F.col("metadata")).alias("_v"))
    lists = [_native(c, with_node) for c in NATIVE]
    lists += [_flat(c, p, with_node) for c, p in FLAT_PATHS.items()]
    lists += [_two_levels(c, p, with_node) for c, p in NESTED_PATHS.items()]
    keys = ["record_id", "child", "pos", "sub_pos"]
    if with_node:
        exploded = v.select("record_id", F.inline(F.concat(*[F.coalesce(x, _nothing(True)) for x in lists])))
        return exploded.groupBy(*keys).agg(F.first("state").alias("state"), F.first("subtype").alias("subtype"), F.first(F.to_json("node")).alias("node")).withColumn("node", F.try_parse_json("node"))
    # One small array of (pos, sub_pos, number of the table) for each list; names are added after the shuffle.
    names = [*NATIVE, *FLAT_PATHS, *NESTED_PATHS]

    def compact(c: str, x: Column) -> Column:
        return F.transform(x, lambda n: F.struct(n["pos"].cast("int").alias("p"), n["sub_pos"].cast("int").alias("s"), (F.array_position(F.lit(tables_of(c)), n["subtype"]) - 1).cast("tinyint").alias("k"))).alias(c)

    packed = [compact(c, x) for c, x in zip(names, lists, strict=True)]
    once = v.select("record_id", F.struct(*packed).alias("l")).filter(" OR ".join(f"size(l.{c}) > 0" for c in names)).dropDuplicates(["record_id"])
    nothing = F.array().cast("array<struct<child:string,pos:bigint,sub_pos:bigint>>")

    def union(c: str) -> Column:
        """The common keys of the list's tables, one after the other."""
        link = lambda e: F.struct(F.lit(c).alias("child"), e["p"].cast("long").alias("pos"), e["s"].cast("long").alias("sub_pos"))
        table = lambda k: F.transform(F.filter(F.col("l")[c], lambda e: e["k"] == k), link)
        return F.coalesce(F.concat(*[table(k) for k in range(len(tables_of(c)))]), nothing)

    return once.select("record_id", F.inline(F.concat(*[union(c) for c in names])))


def tables_of(child: str) -> list[str]:
    """The subtypes of one list, each with a table."""
    return [STRUCT] if child in NATIVE else [*VARIANTS[child], OTHER]


def variant_table(nodes: DataFrame, child: str, name: str) -> DataFrame:
    """The typed rows of one structural variant of a metadata list; ``nodes`` is ``child_nodes(..., with_node=True)``."""
    _, kind, columns = VARIANTS[child][name]
    typed = [F.try_variant_get(F.col("node"), *SUBTYPES[child][kind][c].split(" ")).alias(c) for c in columns]
    return nodes.filter((F.col("child") == child) & (F.col("subtype") == name)).select("record_id", "child", "pos", "sub_pos", *typed)


def other_table(nodes: DataFrame) -> DataFrame:
    """The elements of metadata lists whose state no typed table has: their state and raw value, as JSON."""
    return nodes.filter(F.col("subtype") == OTHER).select("record_id", "child", "pos", "sub_pos", variant_state(F.col("node")).alias("state"), F.to_json("node").alias("value"))


def subtype_table(nodes: DataFrame, child: str) -> DataFrame:
    """The typed rows of one metadata list; ``nodes`` is ``child_nodes(..., with_node=True)``.

    A column that an element's state does not have is null.
    """
    columns: dict[str, Column] = {}
    for state, typed in SUBTYPES[child].items():
        for name, spec in typed.items():
            path, kind = spec.split(" ")
            value = F.when(F.col("state") == state, F.try_variant_get(F.col("node"), path, kind))
            columns[name] = F.coalesce(columns[name], value) if name in columns else value
    keys = ["record_id", "pos", "sub_pos", "state"]
    return nodes.filter(F.col("child") == child).select(*keys, *[c.alias(n) for n, c in columns.items()])


def _flat_fields(row: DataFrame) -> list[Column]:
    """The columns, boxes as columns of their own: ``x1, y1, x2, y2``, how many coordinates there are, and the text of those beyond the fourth."""
    out = []
    for f in row.schema.fields:
        if f.dataType.typeName() != "array":
            out.append(F.col(f.name))
            continue
        prefix = f.name.removesuffix("bbox")
        out += [F.get(f.name, F.lit(i)).alias(f"{prefix}{c}") for i, c in enumerate(("x1", "y1", "x2", "y2"))]
        more = F.when(F.size(f.name) > 4, F.to_json(F.slice(f.name, F.lit(5), F.size(f.name))))
        out += [F.when(F.col(f.name).isNotNull(), F.size(f.name)).alias(f"{prefix}n_coords"), more.alias(f"{prefix}more_coords")]
    return out


def native_table(records: DataFrame, child: str) -> DataFrame:
    """The typed rows of one list column: ``record_id``, ``pos`` and the element's fields, all flat."""
    once = records.select("record_id", F.posexplode(child)).filter("col IS NOT NULL").select("record_id", F.col("pos").cast("long").alias("pos"), "col.*")
    return once.select(*_flat_fields(once)).dropDuplicates(["record_id", "pos"])
