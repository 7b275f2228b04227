"""Nested records against a brute-force walk."""

from __future__ import annotations

import json

from lumenweave.operators import nested

from .conftest import SMALL


def walk(rows):
    found = set()
    for r in rows:
        for name in nested.NATIVE:
            found |= {(r["record_id"], name, i, -1) for i, x in enumerate(r[name] or []) if x is not None}
        try:
            meta = json.loads(r["metadata"]) if r["metadata"] is not None else None
        except ValueError:
            meta = None
        if not isinstance(meta, dict):
            continue
        ocr = meta.get("ocr")
        for name, items in (("ocr_info", ocr.get("ocr_info") if isinstance(ocr, dict) else None), ("timed_caption", meta.get("timed_caption"))):
            if isinstance(items, list):
                found |= {(r["record_id"], name, i, -1) for i, x in enumerate(items) if x is not None}
        for name in ("answers", "traces"):
            for i, inner in enumerate(meta.get(name) if isinstance(meta.get(name), list) else []):
                if isinstance(inner, list):
                    found |= {(r["record_id"], name, i, j) for j, x in enumerate(inner) if x is not None}
    return found


def test_table(spark):
    records = spark.read.parquet(f"{SMALL}/records.parquet")
    got = [tuple(r) for r in nested.child_nodes(records).collect()]
    assert len(got) == len(set(got))
    assert set(got) == walk([r.asDict(recursive=True) for r in records.collect()])


def test_awkward_rows(spark, records):
    metas = [
        None, "", "{", "[]", "null", '"x"', '{"answers": "x"}', '{"answers": [["a", null, {"answer": "b"}], null, "c", 3, []]}', '{"ocr": null}', '{"ocr": {"ocr_info": [null, 1, {"word": "w"}]}}', '{"ocr": []}',
        '{"traces": [[{"x": 1}], {}], "timed_caption": [null, [1]]}', '{"answers": {"a": [1]}}', '{"answers": [["' + "x" * 100_000 + '"]]}',
    ]
    rows = [{"record_id": i, "metadata": m, "qa_pairs": [None, ("q", None)] if i % 2 else None, "region": [] if i % 3 else [(None, None), None]} for i, m in enumerate(metas)]
    made = records(*rows, *rows, extra=", child string, pos int")
    got = [tuple(r) for r in nested.child_nodes(made).collect()]
    assert len(got) == len(set(got))
    assert set(got) == walk([r.asDict(recursive=True) for r in made.collect()])
    nodes = nested.child_nodes(made, with_node=True)
    assert {(r.record_id, r.child, r.pos, r.sub_pos) for r in nodes.collect()} == set(got)
    answers = {(r.record_id, r.pos, r.sub_pos): r.answer for r in nested.subtype_table(nodes, "answers").collect()}
    assert answers[7, 0, 0] == "a"
    assert answers[7, 0, 2] == "b"
    shapes = {r.record_id: r["shape"] for r in nested.structural_variants(made).collect()}
    assert len(shapes) == len(metas)
    assert "answers:list<NUMBER|STRING|VOID|list<>|list<OBJECT<answer: STRING>|STRING|VOID>>" in shapes[7]


def test_variants_have_tables(spark, records):
    box = {"top_left_x": 1, "top_left_y": 2.5, "width": 3e300}
    metas = [
        {"ocr": {"ocr_info": [{"word": "a", "bounding_box": box}, {"word": "b"}, "c", {"word": 5}, None]}}, {"answers": [[7, "x", {"answer": "y"}, {"answer_confidence": "no", "answer": "z"}, {"answer": "w", "more": [1]}], "left"]},
        {"timed_caption": ["said", {"utterance": "u", "start_time": 0, "end_time": 1.5}]}, {"traces": [[{"x": 1, "y": 0.5, "t": 2}, {"x": 1}, True]]},
    ]
    made = records(*[{"record_id": i, "metadata": json.dumps(m), "qa_pairs": [("q", "a"), None]} for i, m in enumerate(metas)] * 2)
    nodes = nested.child_nodes(made, with_node=True)
    rows = {(c, v): [tuple(r) for r in nested.variant_table(nodes, c, v).collect()] for c, variants in nested.VARIANTS.items() for v in variants}
    assert rows == {
        ("ocr_info", "boxed"): [(0, "ocr_info", 0, -1, "a", 1.0, 2.5, 3e300)], ("ocr_info", "unboxed"): [(0, "ocr_info", 1, -1, "b")], ("ocr_info", "string"): [(0, "ocr_info", 2, -1, "c")],
        ("timed_caption", "spoken"): [(2, "timed_caption", 1, -1, "u", 0.0, 1.5)], ("answers", "rated"): [(1, "answers", 0, 3, "z", "no")], ("answers", "unrated"): [(1, "answers", 0, 2, "y")],
        ("answers", "string"): [(1, "answers", 0, 1, "x")], ("traces", "point"): [(3, "traces", 0, 0, 1.0, 0.5, 2.0)],
    }
    other = {tuple(r)[:4]: json.loads(r.value) for r in nested.other_table(nodes).collect()}
    assert other == {
        (0, "ocr_info", 3, -1): {"word": 5}, (1, "answers", 0, 0): 7, (1, "answers", 0, 4): {"answer": "w", "more": [1]}, (2, "timed_caption", 0, -1): "said",
        (3, "traces", 0, 1): {"x": 1}, (3, "traces", 0, 2): True,
    }
    own = {r[:4] for table in rows.values() for r in table} | set(other) | {(i, "qa_pairs", 0, -1) for i in range(4)}
    got = [tuple(r) for r in nested.child_nodes(made).collect()]
    assert sorted(got) == sorted(own)
    assert set(got) == walk([r.asDict(recursive=True) for r in made.collect()])


def test_empty(records):
    assert nested.child_nodes(records()).count() == 0
    assert nested.structural_variants(records()).count() == 0
    assert nested.native_table(records(), "region").count() == 0
