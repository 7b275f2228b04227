"""Mixing, formatting duplicates, cross-split pictures, related splits and broken pairs, with awkward rows."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenweave.llm import broken_pairs, cross_split, format_duplicates, mixing, queries, related_splits
from lumenweave.llm.fm_index import FMIndex

from ..conftest import SMALL

# ---------------------------------------------------------------- 1


def members(spark, rows):
    return spark.createDataFrame(rows, "record_id long, pattern array<int>, size long, target_no string, n_uses string")


def targets(spark, rows):
    return spark.createDataFrame(rows, "target_no int, target_share double, max_repeats int, record_id string")


def test_mixture_keeps_shares_and_caps(spark):
    rows = [(i, [1] if i < 300 else [2] if i < 320 else [1, 2] if i < 350 else [], 1, "x", "y") for i in range(400)]
    wanted = targets(spark, [(1, 0.5, 1, "a"), (2, 0.3, 3, "b"), (3, 0.2, 2, None), (4, None, 2, None), (5, 0.1, 0, None)])
    chosen, report = mixing.mix(members(spark, rows), wanted)
    got = chosen.collect()
    assert len({(r.record_id, r.target_no) for r in got}) == len(got)
    uses = Counter()
    for r in got:
        uses[r.record_id] += r.n_uses
    assert all(uses[r.record_id] <= (1 if r.target_no == 1 else 3) for r in got)
    shares = {r.target_no: r.actual_share for r in report.collect()}
    assert shares[1] == pytest.approx(5 / 8, abs=0.01)
    assert shares[2] == pytest.approx(3 / 8, abs=0.01)
    assert shares[3] == shares[4] == shares[5] == 0
    again, _ = mixing.mix(members(spark, rows).repartition(7), wanted)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_mixture_of_unequal_sizes(spark):
    rows = [(i, [1 + i % 2], 1 + i % 7, None, None) for i in range(600)]
    _, report = mixing.mix(members(spark, rows), targets(spark, [(1, 0.25, 2, None), (2, 0.75, 1, None)]), total=1200)
    shares = {r.target_no: (r.actual_share, r.size_used) for r in report.collect()}
    assert shares[1][0] == pytest.approx(0.25, abs=0.01)
    assert sum(s for _, s in shares.values()) == pytest.approx(1200, abs=14)


def test_mixture_is_exact_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr("lumenweave.operators.ranking.ROWS_A_BUCKET", 10)
    rows = [(i, [1] if i % 3 else [2], 1, None, None) for i in range(900)]
    chosen, _ = mixing.mix(members(spark, rows), targets(spark, [(1, 0.5, 1, None), (2, 0.5, 2, None)]), total=777)
    assert sorted(Counter(r.target_no for r in chosen.collect() for _ in range(r.n_uses)).values()) == [388, 389]


def test_mixture_of_nothing(spark):
    chosen, report = mixing.mix(members(spark, []), targets(spark, [(1, 1.0, 1, None)]))
    assert chosen.count() == 0
    assert [(r.actual_share, r.n_records) for r in report.collect()] == [(0.0, 0)]
    chosen, report = mixing.mix(members(spark, [(1, [1], None, None, None), (2, None, 1, None, None), (3, [1], 0, None, None)]), targets(spark, []))
    assert (chosen.count(), report.count()) == (0, 0)


def test_records_of_several_sources_reach_the_flow(spark, records):
    """Rows of one record that name two sources: it may serve both, and the flow gives it to the one in need."""
    rows = [{"record_id": i, "source": "A", "task": "t"} for i in range(60)] + [{"record_id": i, "source": " b", "task": "T"} for i in range(30, 60)] + [{"record_id": 70, "source": "a", "task": "u"}, {"record_id": 71}]
    wanted = spark.createDataFrame([(1, "a", "t", 0.5, 1), (2, "B", "t", 0.5, 1)], "target_no int, source string, task string, target_share double, max_repeats int")
    found = queries.memberships(records(*rows, *rows[:5]), wanted)
    assert Counter(tuple(r.pattern) for r in found.collect()) == {(1,): 30, (1, 2): 30}
    chosen, report = mixing.mix(found, wanted)
    assert Counter(r.target_no for r in chosen.collect() for _ in range(r.n_uses)) == {1: 30, 2: 30}
    assert {r.target_no: r.actual_share for r in report.collect()} == {1: 0.5, 2: 0.5}


def test_flow_prefers_unused_records():
    flows = mixing.route({(1,): 10, (1, 2): 10}, [mixing.Target(1, 0.5, 3), mixing.Target(2, 0.5, 3)], {1: 10, 2: 10})
    assert all(r == 0 for _, r, _ in flows)
    assert sum(flows.values()) == 20
    assert mixing.largest_total({(1,): 10}, [mixing.Target(1, 1.0, 3)]) == 30
    assert mixing.apportion([mixing.Target(1, 1, 1), mixing.Target(2, 1, 1)], 3) == {1: 2, 2: 1}


@pytest.mark.parametrize(("name", "wanted"), [(" OCR-VQA\t", "ocr_vqa"), ("Text Vqa", "text_vqa"), (None, None), ("", "")])
def test_spelling(spark, name, wanted):
    assert spark.range(1).select(mixing.spelled(F.lit(name).cast("string"))).first()[0] == wanted


# ---------------------------------------------------------------- 2


def copies_of(made, **options):
    return {tuple(r) for r in format_duplicates.copies(format_duplicates.collapse(format_duplicates.canonical_keys(made), **options)[0]).collect()}


def test_formatting_copies(spark, records):
    box = [1.0, 2.0]
    rows = [
        {"record_id": 5, "task": "t", "caption": "A red  cat.", "metadata": '{"a": 1, "b": [1, {"c": null}]}'},
        {"record_id": 3, "task": "t", "caption": "«a RED\tcat»", "metadata": '{"b":[1,{"c":null}],"a":1}'},
        {"record_id": 3, "task": "t", "caption": "«a RED\tcat»", "metadata": '{"b":[1,{"c":null}],"a":1}'},
        {"record_id": 6, "task": "u", "caption": "a red cat", "metadata": '{"a": 1, "b": [1, {"c": null}]}'},
        {"record_id": 7, "task": "t", "caption": "a red cat", "metadata": '{"a": 1, "b": [1, {"c": 1}]}'},
        {"record_id": 8, "task": "t", "caption": "a red cat", "metadata": '{"a": 1'},
        {"record_id": 9, "task": "t", "caption": "a red cat", "metadata": None},
        {"record_id": 10, "task": None, "region": [(box, "x"), None, (None, None)], "metadata": "{}"},
        {"record_id": 11, "task": None, "region": [(None, ""), (box, "X!")], "caption": " \n", "metadata": " { } "},
        {"record_id": 12, "task": None, "region": [(None, ""), (box, "X!"), (box, "x")], "metadata": "{}"},
        {"record_id": 13, "task": None, "caption": " ", "region": [None], "metadata": "{}"},
        {"record_id": 14, "task": None, "caption": "​", "region": None, "metadata": "{}"},
        {"record_id": 15, "task": "t", "caption": "word " * 50_000, "metadata": "{}"},
        {"record_id": 16, "task": "t", "caption": "WORD, " * 50_000, "metadata": "{}"},
        {"record_id": 17, "task": "t", "caption": "a red cat", "image": ("p", None), "metadata": '{"a": 1, "b": [1, {"c": null}]}'},
        {"record_id": 18, "task": "t", "caption": "Straße", "metadata": "{}"},
        {"record_id": 19, "task": "t", "caption": "STRASSE", "metadata": "{}"},
    ]
    made = records(*rows, extra=", h1 long, kept_id string")
    wanted = {(3, 5), (10, 11), (15, 16), (18, 19)}
    assert copies_of(made) == wanted
    assert copies_of(made, hot_rows=1, hot_share=0.0) == wanted  # every repeated key is hot
    for options in ({}, {"hot_rows": 1, "hot_share": 0.0}):
        _, groups = format_duplicates.collapse(format_duplicates.canonical_keys(made), **options)
        assert {tuple(r) for r in groups.collect()} == {(3, 2), (10, 2), (15, 2), (18, 2)}
    assert copies_of(records()) == set()


def test_a_third_of_the_rows_are_copies(spark, records):
    rows = [{"record_id": i, "task": "t", "caption": "same" if i % 3 == 0 else f"text {i}", "metadata": "{}"} for i in range(300)]
    assert copies_of(records(*rows), hot_rows=20) == {(0, i) for i in range(3, 300, 3)}


def test_hot_copies_spread_over_salts(spark, records, monkeypatch):
    monkeypatch.setattr(format_duplicates, "_ROWS_A_SALT", 10)
    rows = [{"record_id": i, "task": "t", "caption": "same" if i % 3 == 0 else f"text {i // 2}", "metadata": "{}"} for i in range(600)]
    keys = format_duplicates.canonical_keys(records(*rows, *rows[:30]))
    members, groups = format_duplicates.collapse(keys, hot_rows=20)
    assert {r.kept_id: r.n_copies for r in groups.collect()}[0] == 200
    assert members.count() == members.distinct().count()
    salts = format_duplicates._salted(keys.withColumn("n", F.lit(200))).groupBy("salt").count().collect()
    assert len(salts) == 20
    assert max(r["count"] for r in salts) < 70


@pytest.mark.parametrize(("a", "b", "same"), [("5 < 3", "5 > 3", False), ("C++", "C", False), ("$5", "5", False), ("a\u200bb", "AB!", True), ("-3", "3", True)])
def test_what_counts_as_formatting(spark, a, b, same):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(*[format_duplicates.canonical_text(F.col(c)) for c in "ab"]).first()
    assert (got[0] == got[1]) == same

# ---------------------------------------------------------------- 3


def test_index_finds_every_occurrence():
    rng = random.Random(1)
    for letters in (3, 2, 120):
        text = np.array([rng.randint(1, letters) for _ in range(2_000)] + [1] * 200, np.uint8)
        index = FMIndex(text, depth=6)
        for n in (1, 2, 5, 6):
            patterns = np.array([[rng.randint(1, letters + 1) for _ in range(n)] for _ in range(60)] + [[1] * n], np.uint8)
            q, at = index.locate(*index.search(patterns))
            found = defaultdict(set)
            for a, b in zip(q.tolist(), at.tolist(), strict=True):
                found[a].add(b)
            for i, p in enumerate(patterns):
                assert found[i] == {k for k in range(len(text) - n + 1) if (text[k : k + n] == p).all()}


def test_search_within_equals_brute_force():
    rng = np.random.default_rng(2)
    texts, asked = rng.integers(1, 5, (300, 16)).astype(np.uint8), rng.integers(0, 3, (60, 16, 4)).astype(np.int16)
    index = FMIndex(np.hstack([texts, np.full((300, 1), 5, np.uint8)]).ravel(), 17)
    shares = np.arange(16) // 4 * 2 + 2
    q, low, high = index.search_within(index.ending_in(5, 4, 6), 4, 6, asked, shares, 0)
    own, found = index.locate(q, low, high)
    cost = asked[:, np.arange(16)[None, :], texts - 1][:, :, ::-1].cumsum(2)
    assert set(zip(own.tolist(), found.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero((cost <= shares).all(2))), strict=True))
    assert len(own) > 20


def near_pictures(rng, n):
    base = rng.integers(10, 245, (n, 64))
    noisy = base + rng.integers(-8, 9, (n, 64))
    shifted = base + 6
    spotted = base.copy()
    for row in spotted:
        row[rng.choice(64, 3, replace=False)] += rng.choice([-50, 50], 3)
    far = base + rng.integers(-30, 31, (n, 64))
    return base, {"noisy": noisy, "shifted": shifted, "spotted": spotted, "far": far, "same": base}


def test_near_thumbnails(spark, records):
    rng = np.random.default_rng(3)
    base, kinds = near_pictures(rng, 40)
    rows, i = [], 0
    for k, made in {"base": base, **kinds}.items():
        for picture in np.clip(made, 0, 255).astype(np.uint8):
            rows.append({"record_id": i, "split": "train" if k == "base" else "val", "image": (None, bytearray(picture.tobytes())), "metadata": "{}"})
            i += 1
    rows += [{"record_id": i, "split": None, "image": (None, bytearray(64)), "metadata": "{}"}, {"record_id": i + 1, "split": "test", "image": (None, bytearray(7)), "metadata": None}, rows[0]]
    made = records(*rows, extra=", key string, side int")
    got = {tuple(r) for r in cross_split.found_pairs(cross_split.overlaps(cross_split.sides(made), shard_texts=100)).collect()}
    pixels = {r["record_id"]: np.frombuffer(r["image"][1], np.uint8).astype(int) for r in rows[:240]}
    brute = {(a, b) for a in range(40) for b in range(40, 240) if np.abs(pixels[a] - pixels[b]).sum() <= 384}
    assert got == brute
    assert len(brute) > 150


@pytest.mark.parametrize("shard_texts", [40, 40_000])
def test_connected_patches(spark, records, shard_texts):
    rng = np.random.default_rng(7)
    rows, pixels = [], []
    for i in range(150):
        base = np.clip(rng.normal(128, (44, 26, 17)[i % 3], (8, 8)), 40, 215).astype(np.uint8)
        h, w, by = ((4, 4, 24), (2, 8, 24), (3, 4, 32))[i // 3 % 3]
        y, x, near = rng.integers(0, 9 - h), rng.integers(0, 9 - w), base.copy()
        near[y : y + h, x : x + w] += np.uint8(by)
        for split, picture in (("train", base), ("val", near)):
            rows.append({"record_id": len(rows), "split": split, "image": (None, bytearray(picture.tobytes())), "metadata": "{}"})
            pixels.append(picture.ravel().astype(int))
    got = {tuple(r) for r in cross_split.found_pairs(cross_split.overlaps(cross_split.sides(records(*rows)), shard_texts=shard_texts)).collect()}
    assert got == {(min(a, b), max(a, b)) for a in range(0, 300, 2) for b in range(1, 300, 2) if np.abs(pixels[a] - pixels[b]).sum() <= 384}
    assert len(got) >= 150


def test_almost_empty_pages_are_met_in_blocks(spark, records):
    """White pages that differ in some places: all agree in many spans, and only pairs within the limit come out of the search."""
    rng = np.random.default_rng(11)
    rows, pixels = [], []
    for i in range(240):
        page = np.full(64, 250, np.uint8)
        page[rng.choice(64, 14, replace=False)] = rng.integers(20, 120, 14)
        near = page.copy()
        near[rng.integers(0, 64)] -= 20
        for split, picture in (("train", page), ("val", near if i % 4 == 0 else np.roll(page, 7))):
            rows.append({"record_id": len(rows), "split": split, "image": (None, bytearray(picture.tobytes())), "metadata": "{}"})
            pixels.append(picture.astype(int))
    base = cross_split.sides(records(*rows))
    ordered = cross_split._ordered(cross_split._texts(base, "bytes"), 20, 384)
    sizes = [r["count"] for r in ordered.filter("side = 0").groupBy("shard").count().collect()]
    assert ordered.filter(F.octet_length("text") == 64).count() > 0
    assert max(sizes) < 100  # of 240 texts of each block, most of which end alike
    wanted = {(min(a, b), max(a, b)) for a in range(0, 480, 2) for b in range(1, 480, 2) if np.abs(pixels[a] - pixels[b]).sum() <= 384}
    assert {tuple(r) for r in cross_split.found_pairs(cross_split.overlaps(base, shard_texts=20)).collect()} == wanted
    assert len(wanted) >= 60


def test_training_texts_visit_few_shards(spark, records):
    """What is shuffled and searched for a training text must hardly grow with the number of shards; pairs are found all the same."""
    rng = np.random.default_rng(13)
    pictures = np.clip(rng.normal(128, 44, (6_400, 64)), 0, 255).astype(np.uint8)
    pictures = np.concatenate([pictures, np.clip(pictures[:200].astype(int) + rng.integers(-9, 10, (200, 64)), 0, 255).astype(np.uint8)])
    base = cross_split.sides(records(*[{"record_id": i, "split": "val" if i < 6_400 else "train", "image": (None, bytearray(p.tobytes())), "metadata": "{}"} for i, p in enumerate(pictures)]))
    ordered = cross_split._ordered(cross_split._texts(base, "bytes"), 100, 384)
    assert ordered.filter("side = 1").count() < 200 * 64  # of 512 shards
    got = {tuple(r) for r in cross_split.found_pairs(cross_split.overlaps(base, shard_texts=1_600)).collect()}
    near = np.abs(pictures[6_400:, None].astype(np.int16) - pictures[None, :6_400]).sum(2) <= 384
    assert got == {(int(b), int(a) + 6_400) for a, b in zip(*np.nonzero(near), strict=True)}
    assert len(got) >= 190


def test_spans_of_a_pair_are_merged(spark):
    apart = np.array([[3], [0], [96], [127]])
    words = [cross_split._span(k, apart) for k in (0, 0, 6, 14)]
    df = spark.createDataFrame([(int(a[0]), int(b[0])) for a, b in words], "low long, high long").agg(F.bit_or("low").alias("low"), F.bit_or("high").alias("high"))
    row = df.select((cross_split._covered("low") + cross_split._covered("high")).alias("c"), (cross_split._distance("low") + cross_split._distance("high")).alias("d")).first()
    # Blocks 0-3, 6-9 and 14, 15, 0, 1; where two spans say different things of a block, OR takes both.
    assert row.c == 10
    assert row.d == (3 | 96) + (0 | 127) + 96 + 127 + 226 + 3 + 0
    over = cross_split._span(2, np.array([[128], [1]]))
    assert (int(over[0][0]) >> 16) & 255 == 0


def test_same_keys(spark, records):
    def row(i, split, path, coco=None):
        return {"record_id": i, "split": split, "image": (path, None), "metadata": json.dumps({"coco_id": coco})}

    rows = [
        row(9, "train", "coco/a/000000000001.jpg"), row(2, "val", "x/coco/1.jpg"), row(2, "val", "x/coco/1.jpg"), row(3, "restval", "visual_genome/7.jpg", 1), row(4, None, "coco/1.jpg"),
        row(5, "test", "visual_genome/7.jpg"), row(6, "train", None), row(7, "test", "nowhere/1.jpg"), row(8, "testdev", "coco/11.jpg"), row(10, "other", "coco/1.jpg"),
    ]
    rows += [{"record_id": 11, "split": "train", "image": ("visual_genome/8.jpg", None), "metadata": '{"coco\\u005fid": 1}'}, {"record_id": 12, "split": "train", "metadata": '{"image_path": "coco/1.png"}'}]
    rows += [{"record_id": 13, "split": "train", "image": ("coco/2.jpg", None), "metadata": '{"coco_id": 1'}, {"record_id": 14, "split": "train", "image": ("coco/1.jpg", None)}]
    got = {tuple(r) for r in cross_split.found_pairs(cross_split.overlaps(cross_split.sides(records(*rows)))).collect()}
    assert got == {(2, 9), (2, 3), (2, 11), (2, 12), (2, 14)}
    assert cross_split.overlaps(cross_split.sides(records())).count() == 0
    assert cross_split.overlaps(cross_split.sides(records(*[r for r in rows if r["split"] == "train"]))).count() == 0


def test_report(spark):
    rows = queries.p3_report(spark, SMALL).collect()
    found = queries.p3_found(spark, SMALL)
    assert sum(r.n_pairs for r in rows) == found.count()
    assert found.distinct().count() == found.count()


def test_report_counts_pairs_by_key_and_picture_once(spark, records):
    rng = random.Random(4)
    pictures = [bytearray([v] * 64) for v in (10, 12, 90)]
    rows = [
        {"record_id": i, "split": rng.choice(["train", "val", "test", None]), "source": rng.choice(["COCO", "coco ", None]), "image": (rng.choice([None, "coco/1.jpg", "coco/2.jpg"]), rng.choice([None, *pictures])), "metadata": "{}"}
        for i in range(120)
    ]
    base = cross_split.sides(records(*rows, *rows[:9]))
    pairs = cross_split.overlaps(base).collect()
    split = {r["record_id"]: (r["split"], (r["source"] or "").strip().lower() or None) for r in rows}
    wanted = Counter(split[p.eval_record] for p in pairs)
    people = Counter(split[e] for e in {p.eval_record for p in pairs})
    got = {(r.split, r.source): (r.n_records, r.n_pairs) for r in cross_split.report(base, mixing.spelled(F.col("source"))).collect()}
    assert got == {k: (people[k], n) for k, n in wanted.items()}


# ---------------------------------------------------------------- 5


def brute_components(edges):
    forest = related_splits.UnionFind()
    for a, b in edges:
        forest.union(a, b)
    return {x: forest.find(x) for x in list(forest.parent)}


def test_components_of_any_size(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(400):03d}", f"n{rng.randrange(400):03d}") for _ in range(250)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(80)] + [("n000", f"h{i}") for i in range(100)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges, "a string, b string").repartition(8)
    wanted = brute_components(edges)
    assert dict(map(tuple, related_splits.components(df).collect())) == wanted
    for hot in ({}, {"hot_rows": 2, "hot_share": 0.0}):
        contracted = dict(map(tuple, related_splits.components(df, max_forest=40, **hot).collect()))
        assert contracted == {k: v for k, v in wanted.items() if k in contracted}
        assert set(wanted) - set(contracted) <= {k for k, v in wanted.items() if list(wanted.values()).count(v) == 1}
    assert related_splits.components(df.limit(0)).count() == 0


def test_one_component_is_no_single_task(spark, monkeypatch):
    """A component of all values: no forest holds more edges than it may."""
    largest = []
    forests = related_splits._forests

    def counted(edges):
        largest.append(max((r["count"] for r in edges.groupBy(F.spark_partition_id()).count().collect()), default=0))
        return forests(edges)

    df = spark.createDataFrame([("a", f"v{i:04d}") for i in range(2_000)], "a string, b string").repartition(40)
    monkeypatch.setattr(related_splits, "_forests", counted)
    got = related_splits.components(df, max_forest=150, hot_rows=100)
    assert got.filter("root = 'a'").count() == 2_001
    assert max(largest) <= 200


def test_related_records(spark, records):
    def row(i, path=None, **meta):
        return {"record_id": i, "image": (path, None), "metadata": json.dumps(meta)}

    rows = [
        row(1, "ocr_vqa/1.jpg", author_name="Ann  Lee"), row(2, "ocr_vqa/2.jpg", author_name=" ann lee"), row(3, "ocr_vqa/2.jpg"), row(4, "coco/9.jpg", annotator_id=7), row(5, "coco/8.jpg", annotator_id="7"),
        row(6, "coco/5.jpg", author_name=" ", annotator_id=None), row(7, None, ucsf_document_id="d"), row(8, None, ucsf_document_id="d"), row(9), row(10, "coco/5.jpg"), row(10, "coco/5.jpg"), {"record_id": 11, "metadata": "{"},
        row(12, None, author_name="7"), row(13, "grit/3.jpg", ucsf_document_id=""), row(14, "coco/" + "x" * 2_000 + "77.jpg"), row(15, "coco/77.jpg", author_name="z" * 3_000), row(16, None, author_name="Z" * 3_000),
        row(17, "coco/90.jpg", author_name="one"), row(17, "coco/91.jpg", author_name="two"), row(18, "grit/90.jpg", author_name="One"), row(19, "grit/91.jpg", author_name="TWO"), row(20, "coco/91.jpg"),
    ]
    made = records(*rows, extra=", root string, name string, picture string")
    linked = queries.linking_values(made)
    grouped = related_splits.group_records(linked)
    got = {r.record_id: r.group_id for r in related_splits.named_groups(grouped).collect()}
    hot = {"hot_rows": 2, "hot_share": 0.0}
    assert {r.record_id: r.group_id for r in related_splits.named_groups(related_splits.group_records(linked, **hot), **hot).collect()} == got
    ocr, nine, five = "ocrvqa/000000000001", "coco/000000000008", "coco/000000000005"
    assert got == {1: ocr, 2: ocr, 3: ocr, 4: nine, 5: nine, 6: five, 10: five, 7: None, 8: None} | dict.fromkeys((14, 15, 16), "coco/000000000077") | dict.fromkeys((17, 18, 19, 20), "coco/000000000090")
    wanted = spark.createDataFrame([("train", 0.6), ("test", 0.4), ("none", 0.0), (None, 0.1)], "split string, target_share double")
    assigned = related_splits.assign_splits(grouped, wanted).collect()
    assert sorted(r.record_id for r in assigned) == list(range(1, 21))
    by_root = defaultdict(set)
    for r in assigned:
        by_root[r.root].add(r.new_split)
    assert all(len(s) == 1 for s in by_root.values())
    assert {s for x in by_root.values() for s in x} == {"train", "test"}
    empty = related_splits.group_records(queries.linking_values(records()))
    assert related_splits.assign_splits(empty, wanted).count() == 0


def test_greedy_reaches_the_targets():
    rng = random.Random(1)
    for sizes in ([(1, 10_000), (50, 20), (3_000, 1)], [(5, 3)], [(rng.randint(1, 90), rng.randint(1, 300)) for _ in range(30)]):
        sizes = sorted(dict(sizes).items())
        targets = [("a", 0.8), ("b", 0.1), ("c", 0.1)]
        quotas = related_splits.greedy_quotas(sizes, targets)
        total = sum(s * n for s, n in sizes)
        got = Counter()
        for s, n in sizes:
            assert sum(k for _, k in quotas[s]) == n
            for name, k in quotas[s]:
                got[name] += s * k
        assert all(abs(got[name] - share * total) <= max(s for s, _ in sizes) for name, share in targets)
        gap, one_by_one = {name: total * share for name, share in targets}, Counter()
        for s, n in reversed(sizes):
            for _ in range(n):
                name = max(gap, key=gap.get)
                gap[name] -= s
                one_by_one[name, s] += 1
        assert one_by_one == Counter({(name, s): k for s in quotas for name, k in quotas[s]})


# ---------------------------------------------------------------- 6

COMMON = [("en", w) for w in "the a an of and to in is it on with that for are this at as by from there he looks".split()] + [("de", w) for w in "der die das und ist ein eine im nicht auf dem bild".split()] + [("es", w) for w in "el la los un una de en y es se no hay al lado".split()] + [("fr", w) for w in "le la les un une de des et est pas dans n est".split()]


@pytest.mark.parametrize(
    ("question", "answer", "wanted"),
    [
        ("What is it?", None, "empty"), ("What is it?", "", "empty"), ("What is it?", "  \t", "empty"), ("What is it?", "...", "empty"), (None, "a cat", "unended"), ("", "", "empty"),
        ("What is it?", "what is it", "copy"), ("What is it?", "Q: What is it?\nA:", "copy"), ("<image>\nWhat is it?", "Question: What is it?", "copy"), ("What is it?", "What is it? What is it?", "copy"), ("What is it?", "- What Is It", "copy"),
        ("What is it?", "It is what it is.", None), ("Where is the dog?", "I'm sorry, but I can’t help with that", "refusal"), ("Where is it?", "AS AN ASSISTANT, I AM UNABLE TO ANSWER THIS.", "refusal"), ("Where?", "He looks sorry that the dog is broken.", None),
        ("What is on the sign?", 'The notice reads "we cannot help".', None), ("Is the lock broken?", "The door can't be opened because the lock is broken.", None), ("What is it?", "unanswerable", None), ("Qué hay en la mesa?", "Lo siento, no puedo responder a eso.", "refusal"),
        ("Where is the dog in the picture?", "Der Hund ist auf dem Bild und die Katze nicht.", "other_language"), ("¿Qué hay al lado de la mesa?", "There is a dog on the table and it is in the garden.", "other_language"),
        ("What is on the board?", 'The board says "der die das und" to the left.', None), ("Where is the dog?", "写真には白い犬が写っています。", "other_language"), ("駅には何がありますか？", "写真には白い犬が写っています。", None), ("駅には何がありますか？", "写真には白い犬が写って", "unended"),
        ("What is it?", "I cannot see a dog in this picture.", None), ("Can we pass?", "No, we cannot pass because the road is closed.", None), ("What is it?", "I can't view images.", "refusal"), ("What is it?", "I cannot see the picture, so I can't help.", "refusal"),
        ("What is it?", "In the garden there is a", "hint"), ("What is it?", "a cat next to the", "hint"), ("What is it?", "a cat next to the dog", "unended"), ("What is it?", "The sign says \"fr", "hint"), ("What is it?", "We see the...", "truncated"), ("What is it?", "The dog, ", "truncated"),
        ("What is it?", "yes", None), ("How many are there?", "12", None), ("What is it?", "It is a cat!", None), ("What is it?", "x" * 100_000, None), ("What is it?", "It is a cat and " * 5_000, "hint"), ("What is it?", "The dog (about 3 years old", "hint"),
    ],
)
def test_defects(question, answer, wanted):
    assert broken_pairs.defect_of(question, answer, broken_pairs.Languages(COMMON)) == wanted


def test_signals():
    assert broken_pairs.continues("The cat", "The cat.") == (False, True)
    assert broken_pairs.continues("The cat", "The cat sat.") == (True, False)
    assert broken_pairs.continues("The cat", "The cat,") == (False, False)
    assert [broken_pairs.is_name(t) for t in ("New York", "Vincent van Gogh", "Main Street", "The table", "van Gogh")] == [True, True, True, False, False]


def test_neighbours_across_partitions(spark):
    rng = random.Random(2)
    texts = {"ab" * rng.randint(4, 12) + rng.choice(["", ".", " c", "d"]) for _ in range(300)} | {f"text {i}" for i in range(60)} | {f"the {rng.choice('ab')} {'x' * rng.randint(1, 5)}{i}{rng.choice(['.', '', ''])}" for i in range(400)}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    known = [broken_pairs._Known(t) for t in sorted(texts)]
    wanted = {k.text: found for i, k in enumerate(known) if (found := broken_pairs.signals_of(known, i))}
    assert len(wanted) > 100
    for parts in (2, 13, 60):
        got = broken_pairs.neighbours(df, parts=parts).collect()
        assert len(got) == len({r.text for r in got})
        assert {r.text: tuple(r)[1:] for r in got} == wanted
    assert broken_pairs.neighbours(df.limit(0), parts=3).count() == 0


def defects(records, answers, common, **options):
    rows = [{"record_id": i, "split": "train", "qa_pairs": [("What can be seen in the picture?", a)]} for i, a in enumerate(answers)]
    found = {r.record_id: r.defect for r in broken_pairs.defective_pairs(records(*rows), common, **options).collect()}
    return {a: found.get(i) for i, a in enumerate(answers)}


def test_neighbours_decide_on_sentences(spark, records):
    common = spark.createDataFrame(COMMON, "lang string, word string")
    cut = ["The table looks old because", "The table looks ol", "In the garden there", "An old horse looks for"]
    whole = ["The table looks old because it is wet.", "The table looks new.", "In the garden there are trees.", "An old horse eats grass.", "New York", "New York is big.", "Vincent van Gogh", "Vincent van Gogh painted it.", "Main Street", "a red cup on a mat", "a red cup.", "a red cup in a box", "The cat sat on a mat", "yes"]
    for options in ({}, {"hot_rows": 1, "hot_share": 0.0}):
        got = defects(records, [*cut, *whole], common, **options)
        assert [got[a] for a in cut] == ["truncated"] * 4
        assert [a for a in whole if got[a]] == []
    # Without whole ones beside them only a hanging word, and a word that another one completes, tell.
    assert [defects(records, cut[:3], common)[a] for a in cut[:3]] == ["truncated", "truncated", None]


def test_length_limits_decide(spark, records):
    common = spark.createDataFrame(COMMON, "lang string, word string")
    ended = [f"my word{i} is {'y' * 30} here." for i in range(40)]
    cut = [f"my word{i} is {'y' * 30} here."[:24] for i in range(10, 40)]
    got = defects(records, [*ended, *cut, "my word7 then is", "my cat a b c d e f g h ij"], common)
    assert all(got[a] == "truncated" for a in cut)
    few = defects(records, [*ended[:12], *cut[:2]], common)
    assert all(few[a] is None for a in ended[:12])


def test_cut_inside_a_word(spark, records):
    answers = {
        "a man riding a hor": "truncated", "a man riding a horse": None, "a hor": "truncated", "a horse": None, "red ca": "truncated", "red car": None, "red carpet": None, "car": None, "old car on a road": None,
        "near a wat": "truncated", "near a waterfall": None, "in the": "truncated", "in them": None, "big park": None, "big parking-lot": None, "park": None, "gree": None, "green": None, "bus 1": None, "bus 12": None,
    }
    rows = [{"record_id": i, "split": "train", "qa_pairs": [("What can be seen in the picture?", a)]} for i, a in enumerate(answers)]
    common = spark.createDataFrame(COMMON, "lang string, word string")
    got = {r.record_id: r.defect for r in broken_pairs.defective_pairs(records(*rows), common).collect()}
    assert {a: got.get(i) for i, a in enumerate(answers)} == answers


def test_length_limits(spark):
    rows = [("x" * (i % 60 + 10),) for i in range(600)] + [("y" * 33,)] * 100 + [("z" * 40 + ".",)] * 300
    assert [r.n_chars for r in broken_pairs.length_limits(spark.createDataFrame(rows, "text string")).collect()] == [33]


def test_pairs(spark, records):
    rows = [
        {"record_id": 1, "split": "test", "qa_pairs": [("q?", None), None, ("q?", "")]},
        {"record_id": 2, "split": None, "qa_pairs": [("q?", None)]},
        {"record_id": 3, "split": "train", "chat": [("human", "What is it?"), ("gpt", ""), ("gpt", ""), ("human", "x"), None, ("gpt", "")]},
        {"record_id": 3, "split": "train", "chat": [("human", "What is it?"), ("gpt", ""), ("gpt", ""), ("human", "x"), None, ("gpt", "")]},
        {"record_id": 4, "split": "train", "chat": [("gpt", "")], "qa_pairs": []},
    ]
    common = spark.createDataFrame([*COMMON, (None, None)], "lang string, word string")
    made = records(*rows, extra=", answer string, text string, defect string")
    got = {tuple(r) for r in broken_pairs.defective_pairs(made, common).collect()}
    assert got == {(1, "qa_pairs", 2, "empty"), (2, "qa_pairs", 0, "empty"), (3, "chat", 1, "empty")}
    assert broken_pairs.defective_pairs(records(), common.limit(0)).count() == 0
