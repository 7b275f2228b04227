"""Column functions and operators against their definitions, with the awkward cases."""

from __future__ import annotations

import json
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenweave import catalog, schema, sources, streaming
from lumenweave.functions import arrays as A
from lumenweave.functions import boxes as B
from lumenweave.functions import text as T
from lumenweave.functions.metadata import fields, picture_key, variant
from lumenweave.operators import augment, curation, grouping, joins, metrics, packing, ranking, sequence, traces, validate
from lumenweave.plans import evaluators, loaders, standard

from .conftest import SMALL


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def column(spark, values, kind, make):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(make(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [("\t a cat\n", "A cat."), ("IS IT?", "Is it?"), ("done.", "Done."), ("wow?!", "Wow?!"), ("", "."), ("x" * 20_000, "X" + "x" * 19_999 + "."), (None, None)],
)
def test_format_text(spark, text, wanted):
    assert column(spark, [text], "string", T.format_text) == [wanted]


def test_format_text_marks(spark):
    assert column(spark, ["a", "a.</s>"], "string", lambda c: T.format_text(c, punctuated=False, bos="<s>", eos="</s>")) == ["<s>A</s>", "<s>A.</s>"]


def test_remove_articles(spark):
    texts = ["The cat and a dog", "an apple\nthe   pear", "théa some été", "", None, "banana", "L'a the", "x\x1fa\xa0b", "a the an some", "\u3000A\u2003b", "the_a the-a"]
    wanted = ["cat and dog", "apple pear", "théa été", "", None, "banana", "L'", "x b", "", "b", "the_a -"]
    assert column(spark, texts, "string", T.remove_articles) == wanted


def test_format_bbox(spark):
    assert one(spark, T.format_bbox(F.array(*[F.lit(v) for v in (0.125, 0.005, 1.0, 1234.5)]))) == "[0.12,0.01,1.00,1234.50]."


@pytest.mark.parametrize(("text", "wanted"), [("[1, 2,3,4]", [1, 2, 3, 4]), ("1,2,3,4", None), ("[1,2,3]", None), ("[1,2,3,4,5]", None), ("[1,2,x,4]", None), (None, None)])
def test_parse_bbox(spark, text, wanted):
    assert column(spark, [text], "string", T.parse_bbox) == [wanted]


def test_letters(spark):
    choices = F.array(*[F.lit(x) for x in "pqr"])
    assert one(spark, T.letter_choices(choices)) == "A: p\nB: q\nC: r\nAnswer: "
    assert one(spark, T.answer_letter(choices, F.lit("q"))) == "B"
    assert one(spark, T.answer_letter(choices, F.lit("z"))) is None


def test_ocr_context(spark):
    rows = [([("b", "2"), ("a", "1")],), ([],), (None,)]
    df = spark.createDataFrame(rows, "t array<struct<key:string,value:string>>")
    assert [r[0] for r in df.select(T.ocr_context(F.col("t"))).collect()] == ["OCR text:\na: 1\nb: 2", "", ""]


@pytest.mark.parametrize(
    ("path", "coco", "wanted"),
    [
        ("coco/val2014/COCO_val2014_000000000042.jpg", None, "coco/000000000042"), ("/storage/coco/images/7.JPG", None, "coco/000000000007"),
        ("visual_genome/VG_100K_2/99.jpg", None, "vg/000000000099"), ("visual_genome/VG_100K/5.jpg", "12", "coco/000000000012"), (None, "12", "coco/000000000012"),
        ("ocr_vqa/images/cover.png", None, None), (None, None, None), ("elsewhere/1.jpg", None, None), ("text_vqa/x/t00012.jpg", None, "textvqa/000000000012"),
        ("docvqa/documents/page3.v2.png", None, "docvqa/000000000002"), ("grit/00935/000802075.jpg", None, "grit/000000802075"), ("coco/1234567890123.jpg", None, "coco/1234567890123"),
    ],
)
def test_picture_key(spark, path, coco, wanted):
    assert one(spark, picture_key(F.lit(path).cast("string"), F.lit(coco).cast("string"))) == wanted


@pytest.mark.parametrize(("text", "ok"), [('{"a":1}', True), ('{"a":1}{"b":2}', False), ('{"a":1} x', False), ("{", False), ("", False), (None, False), ('{"a":{"b":[1,{"c":null}]}}', True)])
def test_parsing(spark, text, ok):
    df = spark.createDataFrame([(text,)], "m string")
    assert (df.select(F.to_json(variant(F.col("m")))).first()[0] is not None) is ok
    assert df.select(fields(F.col("m"), "a")["parsed"]).first()[0] is ok


def test_iou(spark):
    box = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, B.iou(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert one(spark, B.iou(box(0, 0, 2, 2), box(0, 0, 2, 2))) == 1
    assert one(spark, B.iou(box(0, 0, 1, 1), box(5, 5, 6, 6))) == 0
    assert one(spark, B.iou(box(0, 0, 4, 4), box(1, 1, 2, 2))) == pytest.approx(1 / 16)
    assert one(spark, B.iou(box(1, 1, 1, 1), box(1, 1, 1, 1))) is None


def test_box_conversions(spark):
    box = F.array(*[F.lit(float(x)) for x in (1, 2, 3, 4)])
    for a, b in (("xywh", "xyxy"), ("xyxy", "xywh"), ("xywh", "xywha")):
        there = B.convert(box, a, b)
        assert one(spark, F.slice(B.convert(there, b, a) if (b, a) != ("xywha", "xywh") else B.convert(there, "xywha", "xywh"), 1, 4)) == [1, 2, 3, 4]
    with pytest.raises(ValueError, match="no conversion"):
        B.convert(box, "xywh", "polar")
    with pytest.raises(Exception, match="not finite"):
        one(spark, B.clip(F.array(*[F.lit(float("nan"))] * 4), F.lit(1), F.lit(1)))


def test_clamp(spark):
    assert one(spark, B.clamp_xywh(F.array(*[F.lit(float(x)) for x in (-3, -1, 50, 5)]), F.lit(20), F.lit(30))) == [0, 0, 20, 5]


@pytest.mark.parametrize(("side", "patch", "wanted"), [(336, 14, 601), (224, 32, 57)])
def test_image_tokens(spark, side, patch, wanted):
    tokens = one(spark, A.image_tokens(F.lit(side // patch), F.lit(side // patch)))
    assert len(tokens) == wanted
    assert tokens[-1] == A.EOS_TOKEN
    assert tokens.count(A.IMAGE_TOKEN) == (side // patch) ** 2


def test_image_tokens_not_square(spark):
    assert one(spark, A.image_tokens(F.lit(2), F.lit(3))) == [4118, -200, -200, -200, 10494, -200, -200, -200, 4118]


def test_patchify(spark):
    patches = one(spark, A.patchify(F.array(*[F.lit(i) for i in range(32)]), 4, 4, 2, channels=2))
    assert patches[0] == [0, 16, 1, 17, 4, 20, 5, 21]
    with pytest.raises(ValueError, match="multiple"):
        A.patchify(F.array(), 5, 4, 2)
    with pytest.raises(Exception, match="multiple"):
        one(spark, A.number_of_patches(F.lit(5), F.lit(4), 2))


def test_score_filters(spark):
    scores = F.array(*[F.lit(float(x)) for x in (1, 3, 3, 2)])
    low = float("-inf")
    assert one(spark, A.top_k_filter(scores, 1)) == [low, 3, 3, low]
    assert one(spark, A.top_k_filter(scores, 9)) == [1, 3, 3, 2]
    assert one(spark, A.argmax(scores)) == 1
    assert one(spark, A.nucleus_filter(scores, 0.5))[0] == low
    assert one(spark, A.nucleus_filter(scores, 1.0)) == [1, 3, 3, 2]
    assert sum(one(spark, A.softmax(scores))) == pytest.approx(1)
    assert one(spark, A.repetition_penalty(F.array(F.lit(-2.0), F.lit(2.0)), F.array(F.lit(0), F.lit(1)), 2.0)) == [-4, 1]


def test_padding(spark):
    rows = spark.createDataFrame([(1, [1, 2]), (1, [3]), (1, None), (2, [4])], "b int, input_ids array<int>")
    for side, short in (("right", [3, 0]), ("left", [0, 3])):
        got = [r.input_ids for r in sequence.collate(rows, "b", ["input_ids"], side=side).collect()]
        assert sorted(got) == sorted([[1, 2], short, [4]])


def test_majority_vote(spark):
    rows = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "a", 2), (1, "b", 3), (2, None, 0), (3, "x", 5)], "k int, v string, p int")
    got = {r.k: (r.winner, r.n) for r in grouping.majority_vote(rows, ["k"], "v", "p").collect()}
    assert got == {1: ("b", 2), 2: (None, 1), 3: ("x", 1)}


def test_runs(spark):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(["a", "a", "b", "a", None, None])], "p int, k string")
    assert [r.run_id for r in grouping.run_groups(rows, "k", "p").orderBy("p").collect()] == [1, 1, 2, 3, 4, 4]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sizes=st.lists(st.integers(0, 9), min_size=1, max_size=6), most=st.integers(1, 4))
def test_packing_keeps_everything(spark, sizes, most):
    rows = [(k, list(range(n))) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "k int, a array<int>")
    chunks = packing.pack_array(df, "a", most).collect()
    assert all(len(c["items"]) <= most for c in chunks)
    back: dict = {}
    for c in sorted(chunks, key=lambda c: (c.k, c.chunk)):
        back.setdefault(c.k, []).extend(c["items"])
    assert back == {k: a for k, a in rows if a}
    flat = packing.unpack(df, "a")
    packed = packing.pack(flat, ["k"], ["pos"], most, "item").collect()
    assert sum(len(c["items"]) for c in packed) == sum(sizes)
    index = sorted(r["index"] for r in packing.unpack_index(df, ["k"], "a").collect())
    assert index == list(range(sum(sizes)))


def test_choices(spark):
    df = spark.createDataFrame([(1, ["w", "x", "y"], 1)], "k int, c array<string>, i int")
    got = {r.slot: r.c for r in augment.swap_choices(df, "c", "i").collect()}
    assert got == {0: ["x", "w", "y"], 1: ["w", "x", "y"], 2: ["w", "y", "x"]}
    df = spark.createDataFrame([(1, ["w", "x"], "r"), (2, [], "r")], "k int, c array<string>, a string")
    got = {(r.k, r.slot): r.c for r in augment.insert_choice(df, "c", "a").collect()}
    assert got == {(1, 0): ["r", "w", "x"], (1, 1): ["w", "r", "x"], (1, 2): ["w", "x", "r"], (2, 0): ["r"]}


def test_zipped(spark):
    df = spark.createDataFrame([([1, 2, 3], ["a"]), ([], ["a"])], "a array<int>, b array<string>")
    assert [[tuple(z) for z in r[0]] for r in df.select(augment.zipped(F.col("a"), F.col("b"))).collect()] == [[(1, "a")], []]


def test_joins(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "k int, v string, p int")
    assert [(r.k, r.v) for r in joins.last_wins_join(left, right, ["k"], "p").collect()] == [(1, "b")]
    assert sorted(r.k or 0 for r in joins.anti_join_keep_nulls(left, right, ["k"]).collect()) == [0, 2]
    assert joins.anti_join_keep_nulls(left, right.limit(0), ["k"]).count() == 3
    with pytest.raises(Exception, match="no match"):
        joins.enforced_join(left.filter("k = 2"), right, ["k"]).collect()
    with pytest.raises(ValueError, match="rows on the left"):
        joins.positional_zip(left, right, "k", "p")
    same = spark.createDataFrame([(10, "b"), (20, "a")], "q int, w string")
    numbers = spark.createDataFrame([(5,), (3,)], "n int")
    assert sorted((r.n, r.w) for r in joins.positional_zip(numbers, same, "n", "q").collect()) == [(3, "b"), (5, "a")]


def test_first_existing(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "x", "b"), (3, "x", "y")], "k int, p string, q string")
    listing = spark.createDataFrame([("a",), ("b",)], "f string")
    got = {r.k: r.found_path for r in joins.first_existing(df, [F.col("p"), F.col("q")], listing, "f").collect()}
    assert got == {1: "a", 2: "b", 3: None}
    with pytest.raises(Exception, match="no candidate"):
        joins.first_existing(df, [F.col("p"), F.col("q")], listing, "f", required=True).collect()


def test_unique_only(spark):
    df = spark.createDataFrame([("u", 1), ("u", 2), ("v", 3), (None, 4)], "url string, k int")
    assert sorted(r.k for r in grouping.unique_only(df, ["url"]).collect()) == [3, 4]


def test_frequency_cap(spark):
    rows = [(f"n{n}", i) for n in (2, 3, 8, 9) for i in range(n)]
    df = spark.createDataFrame(rows + rows, "k string, i int")
    got = {r.k: r["count"] for r in curation.frequency_cap(df, "k", "i").groupBy("k").count().collect()}
    assert got == {"n3": 3, "n8": 8, "n9": 8}
    again = curation.frequency_cap(df.repartition(7), "k", "i")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, curation.frequency_cap(df, "k", "i").collect()))


def test_overlaps(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (2, 0, 5), (2, 0, 5), (3, 0, 6), (3, 5, 9)], "k int, a int, b int")
    assert {r.k: r.has_overlap for r in curation.overlaps(df, "k", "a", "b").collect()} == {1: False, 2: False, 3: True}


@pytest.mark.parametrize(
    ("times", "wanted"),
    [([], []), ([5.0], [[0]]), ([0.0, 0.3], [[0, 1]]), ([0.0, 0.4, 0.5, 0.9, 1.0], [[0, 1], [2], [3, 4]]), ([0.0, 0.1, 0.5], [[0, 1]]), ([0.0, 2.0, 2.1, 2.2], [[0], [1], [2]])],
)
def test_segments(times, wanted):
    assert traces.segment_times(times, 0.4) == wanted


def test_segment_trace(spark):
    df = spark.createDataFrame([(1, [(0.0,), (0.1,), (0.5,)]), (2, []), (3, None)], "k int, p array<struct<t:double>>")
    assert sorted(map(tuple, traces.segment_trace(df, "k", "p", 0.4).collect())) == [(1, 0, 0), (1, 0, 1)]


@pytest.mark.parametrize(("n", "wanted"), [(0, 0.0), (1, 0.3), (2, 0.6), (3, 0.9), (4, 1.0), (10, 1.0)])
def test_soft_vote(spark, n, wanted):
    answers = F.array(*[F.lit("a" if i < n else "b") for i in range(10)])
    assert one(spark, metrics.soft_vote(answers, F.lit("a"))) == pytest.approx(wanted)


def test_binary_metrics(spark):
    df = spark.createDataFrame([(0, 1), (0, 0)], "p int, y int")
    m = metrics.binary_metrics(metrics.confusion(df, "p", "y")).first()
    assert (m.precision, m.recall, m.f1, m.accuracy, m.yes_share) == (None, 0.0, 0.0, 0.5, 0.0)
    assert metrics.binary_metrics(metrics.confusion(df.limit(0), "p", "y")).first().accuracy is None
    assert column(spark, ["no", "no.", "No", None], "string", lambda c: metrics.encode_label(c, "no")) == [0, 1, 1, 1]
    assert column(spark, ["no", "no.", " No "], "string", lambda c: metrics.encode_label(c, "no", normalized=True)) == [0, 0, 0]


def test_mean_of_means(spark):
    df = spark.createDataFrame([(1, 2.0, 5), (1, 4.0, -100), (2, 9.0, -100)], "s int, l double, y int")
    assert metrics.mean_of_means(df, "s", "l", "y").first()[0] == 1.0


def test_validate(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, [1.0, -2.0, 3.0, 4.0]), (3, [1.0]), (4, None)], "k int, b array<double>")
    rules = {"box": validate.valid_box(F.col("b"))}
    assert sorted(r.k for r in validate.validate(df, rules, "quarantine").collect()) == [2, 3, 4]
    assert [r.broken_rules for r in validate.validate(df, rules, "flag").orderBy("k").collect()] == [[], ["box"], ["box"], ["box"]]
    with pytest.raises(Exception, match="broken: box"):
        validate.validate(df, rules).collect()
    with pytest.raises(ValueError, match="no mode"):
        validate.validate(df, rules, "x")


def test_catalog(spark):
    assert catalog.plan("pretrain", "train") == [("llava_pretrain", "captioning")]
    assert catalog.plan("instruction_tuning", "test") == []
    assert ("vsr", "image_text_match") in catalog.plan("image_text_match", "train")
    for bad in (("nothing", "train"), ("coco", "dev")):
        with pytest.raises(ValueError, match="no "):
            catalog.plan(*bad)
    assert catalog.catalog_table(spark).filter("in_pretraining").count() == 1


def test_settings_reach_the_loaders(spark):
    """Every corpus of the catalog has a loader, and sizes come from the settings."""
    questions = spark.createDataFrame([(i, 7, "a?", i) for i in range(5)], "question_id long, image_id long, question string, pos long")
    answers = spark.createDataFrame([(i, "t", "o", [("x",)] * 10) for i in range(5)], "question_id long, question_type string, answer_type string, answers array<struct<answer:string>>")
    chat = spark.createDataFrame([("1", "i", [("human", "say"), ("gpt", "cap")], 0), ("2", "j", [("human", "say")], 1)], "id string, image string, conversations array<struct<role:string,text:string>>, pos long")
    made = {"vqa_v2": {"questions": questions, "answers": answers}, "llava_pretrain": {"annotations": chat, "details": chat.select("id", "image", F.lit("u").alias("url"), "pos")}}
    found = standard.standard_loaders(lambda corpus, split: made[corpus], "d", catalog.Settings(annotations_per_image=2), mode="skip")
    assert found.keys() == catalog.CORPORA.keys()
    assert sorted(len(r.qa_pairs) for r in catalog.subset(found, "vqa_v2", "train").collect()) == [1, 2, 2]
    assert catalog.subset(found, "vqa_v2", "test").count() == 5
    assert [r.caption for r in catalog.subset(found, "pretrain", "train").collect()] == ["cap"]
    with pytest.raises(ValueError, match="no split"):
        found["vqa_v2"]("vqa", "dev")
    fetched = standard.with_arguments(loaders.llava_pretrain, lambda task, split: {**made["llava_pretrain"], "path": loaders.in_folder(split), "mode": "skip"})
    assert fetched("captioning", "train").first().image.path == "train/i"


def test_resize_pixels(spark):
    df = spark.createDataFrame([([1.0, 3.0, 5.0, 7.0], 2, 2), ([2.0] * 12, 3, 4), ([1.0], 3, 3), (None, 2, 2)], "p array<double>, h int, w int")
    got = [r[0] for r in df.select(A.resize_pixels(F.col("p"), F.col("h"), F.col("w"), F.lit(1), F.lit(2))).collect()]
    assert got[0] == pytest.approx([3.0, 5.0])
    assert got[1] == pytest.approx([2.0, 2.0])
    assert got[2:] == [None, None]


def test_markup(spark):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((6, 9), (2, 5), (6, 9))])
    assert one(spark, curation.markup(F.lit("A cat dog!"), spans)) == "A ||cat <coords_0>|| ||dog <coords_1><coords_2>||!"


def test_rank_in_group(spark):
    rows = [("hot" if i % 3 else "cold", i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, i int")
    for n in (900, 100_000):
        ranked = ranking.rank_in_group(df, ["g"], "i", seed=5, rows=n).collect()
        for g in ("hot", "cold"):
            assert sorted(r["rank"] for r in ranked if r.g == g) == list(range(sum(1 for x, _ in rows if x == g)))
    assert ranking.rank_in_group(df.limit(0), ["g"], "i", seed=5, rows=0).count() == 0


def test_ranks_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)], "g string, i int")
    ranks = [sorted(map(tuple, ranking.rank_in_group(df.repartition(n), ["g"], "i", seed=5, rows=50).collect())) for n in (1, 4, 16)]
    assert ranks[0] == ranks[1] == ranks[2]


@pytest.mark.parametrize("rows_a_bucket", [20_000, 30])
def test_numbers_of_hot_groups(spark, monkeypatch, rows_a_bucket):
    monkeypatch.setattr(ranking, "ROWS_A_BUCKET", rows_a_bucket)
    rows = [("hot" if i % 3 else None if i % 2 else "cold", (i * 7) % 500, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, i int")
    got = ranking.number_in_group(df.repartition(5), ["g"], ["o", "i"], "n").collect()
    for g in ("hot", "cold", None):
        ordered = sorted((o, i) for x, o, i in rows if x == g)
        assert {(r.o, r.i): r.n for r in got if r.g == g} == {k: n for n, k in enumerate(ordered, 1)}
    total = {r.i: r.t for r in ranking.running_total(df, ["i"], "o", "t").collect()}
    assert total == {i: sum(o for _, o, j in rows if j < i) for _, _, i in rows}
    assert ranking.number_in_group(df.limit(0), ["g"], ["o"], "n").count() == 0
    assert ranking.running_total(df.limit(0), ["i"], "o", "t").count() == 0


def test_byte_tokens(spark):
    texts = ["", "aé日🤦", None, "x" * 5_000]
    assert column(spark, texts, "string", lambda c: sequence.byte_text(sequence.byte_tokens(c))) == texts
    assert column(spark, ["é"], "string", sequence.byte_tokens) == [[b + 1 for b in "é".encode()]]


def test_pictures(spark, tmp_path):
    row = bytes([0, 0, 255, 0, 255, 0, 0, 0])  # two pixels, padded to four bytes
    body = row + bytes([0, 0, 255, 0, 0, 255, 0, 0])
    head = b"BM" + (54 + len(body)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + (2).to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(4) + len(body).to_bytes(4, "little") + bytes(16)
    (tmp_path / "p.bmp").write_bytes(head + info + body)
    (tmp_path / "q.bmp").write_bytes(b"no picture")
    got = sources.read_pictures(spark, f"file://{tmp_path}")
    share = sources.dominant_color_share(F.col("pixels"), 3).alias("share")
    assert [(r.width, r.height, r.share) for r in got.select("width", "height", share).collect()] == [(2, 2, 0.75)]
    assert got.filter(sources.keep_picture(F.col("width"), F.col("height"), share, least_side=1)).count() == 1
    assert got.filter(sources.keep_picture(F.col("width"), F.col("height"), share, least_side=2)).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    (tmp_path / "root.json").write_text(json.dumps({"questions": [{"q": "x"}, {"q": "y"}]}))
    (tmp_path / "map.json").write_text(json.dumps({"k1": {"v": 1}, "k2": {"v": 2}}))
    (tmp_path / "ids.txt").write_text(" 3 \n\n1\n")
    at = lambda n: f"file://{tmp_path}/{n}"
    assert sorted(r.a for r in sources.read_json_document(spark, at("list.json"), "a int").collect()) == [1, 2]
    assert [(r.pos, r.q) for r in sources.read_json_array(spark, at("root.json"), "questions", "struct<q:string>").orderBy("pos").collect()] == [(0, "x"), (1, "y")]
    assert sorted((r.key, r.v) for r in sources.read_json_map(spark, at("map.json"), "struct<v:int>").collect()) == [("k1", 1), ("k2", 2)]
    assert sorted(r.line for r in sources.read_lines(spark, at("ids.txt")).collect()) == ["1", "3"]
    folder = tmp_path / "shard"
    folder.mkdir()
    for n in ("p1.jpg", "p2.jpg"):
        (folder / n).write_bytes(b"x")
    (folder / "p1.json").write_text('{"caption": "c"}')
    assert [(r.stem, r.caption, r.shard) for r in sources.read_with_sidecars(spark, f"file://{folder}", "caption string").collect()] == [("p1", "c", "shard")]
    sources.write_once(spark.range(2), at("once"))
    sources.write_once(spark.range(5), at("once"))
    assert spark.read.parquet(at("once")).count() == 2
    sources.write_submission(spark.createDataFrame([(1, "a")], "q int, p string"), at("sub"), "q", "p")
    assert [tuple(r) for r in sources.read_json_lines(spark, at("sub"), "question_id int, answer string").collect()] == [(1, "a")]
    (tmp_path / "once" / "bad.parquet").write_bytes(b"not parquet")
    assert sources.read_parquet(spark, at("once"), ignore_corrupt=True, schema="id long").count() == 2


def test_sidecar_source(spark, tmp_path):
    from lumenweave.sources.sidecars import SidecarSource

    for shard, names in (("s1", ("a", "b")), ("s2", ("c",)), ("empty", ())):
        (tmp_path / shard).mkdir()
        for n in names:
            (tmp_path / shard / f"{n}.jpg").write_bytes(b"x")
    (tmp_path / "s1" / "a.json").write_text('{"k": 1}')
    spark.dataSource.register(SidecarSource)
    got = spark.read.format("sidecars").load(f"file://{tmp_path}")
    assert sorted((r.shard, r.stem, r.note) for r in got.collect()) == [("s1", "a", '{"k": 1}'), ("s1", "b", None), ("s2", "c", None)]


def test_without_overlaps(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (2, 1, 2)], "k int, a int, b int")
    assert curation.without_overlaps(df, "k", "a", "b").count() == 3
    with pytest.raises(Exception, match="overlapping spans of 3"):
        curation.without_overlaps(df.union(spark.createDataFrame([(3, 0, 6), (3, 5, 9)], df.schema)), "k", "a", "b").collect()


def test_shared_folder_is_required_on_a_cluster():
    from lumenweave import storage

    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value or default

        def set(self, key, value):
            self.value = value

    class Context:
        def __init__(self, master):
            self.master = master

        def getConf(self):
            return Conf(None)

    class Session:
        def __init__(self, master, folder):
            self.conf, self.sparkContext = Conf(folder), Context(master)

    assert storage.shared_folder(Session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert storage.shared_folder(Session("local[2]", None)).startswith("file:///")
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        storage.shared_folder(Session("spark://host:7077", None))


def test_dominant_color(spark):
    df = spark.createDataFrame([(bytearray([1, 1, 2, 2, 1, 1]),)], "b binary")
    assert df.select(sources.dominant_color_share(F.col("b"), 2)).first()[0] == pytest.approx(2 / 3)


def test_loaders(spark):
    path = loaders.in_folder("d", ".jpg")
    questions = spark.createDataFrame([(1, 7, "a?", 0), (2, 7, "b?", 1), (3, 8, "c?", 2)], "question_id long, image_id long, question string, pos long")
    answers = spark.createDataFrame([(i, "t", "o", [("x",)] * 4 + [("y",)] * 6) for i in (1, 2, 3)], "question_id long, question_type string, answer_type string, answers array<struct<answer:string>>")
    got = loaders.vqa_v2(questions, answers, path, most=1).collect()
    assert len(got) == 3
    assert got[0].qa_pairs[0].answer == "y"
    assert loaders.vqa_v2(questions, answers, path).count() == 2
    again = questions.withColumn("pos", F.when(F.col("question_id") == 3, 1).otherwise(F.col("question_id") * 2 - 2))
    assert sorted(len(r.qa_pairs) for r in loaders.vqa_v2(again, answers, path).collect()) == [1, 1, 1]  # pictures 7, 8, 7
    nine = answers.withColumn("answers", F.when(F.col("question_id") == 2, F.slice("answers", 1, 9)).otherwise(F.col("answers")))
    with pytest.raises(Exception, match="ten_answers"):
        loaders.vqa_v2(questions, nine, path).collect()
    assert sorted(len(r.qa_pairs) for r in loaders.vqa_v2(questions, nine, path, mode="skip").collect()) == [1, 1]
    with pytest.raises(Exception, match="no match"):
        loaders.vqa_v2(questions, answers.limit(1), path).collect()
    aok = spark.createDataFrame([(5, "q1", "w?", ["a", "b"], 1, ["r"]), (6, "q2", "v?", ["a", "b"], None, None)], "image_id long, question_id string, question string, choices array<string>, correct_choice_idx int, rationales array<string>")
    rows = loaders.aok_vqa(aok, path).collect()
    got = {(json.loads(r.metadata)["question_id"], tuple(json.loads(r.metadata)["choices"])): r.qa_pairs[0].answer for r in rows}
    assert got == {("q1", ("b", "a")): "b", ("q1", ("a", "b")): "b", ("q2", ("a", "b")): None}
    images = spark.createDataFrame([(1, None, 100, 100, [(0, 0, 10, 10, "s"), (0, 0, 200, 200, "l")]), (2, 9, 50, 50, [(-5, 0, 80, 10, "w")])], "image_id long, coco_id long, width int, height int, regions array<struct<x:int,y:int,width:int,height:int,phrase:string>>")
    held = spark.createDataFrame([(9,)], "coco_id long")
    train = loaders.visual_genome_regions(images, held, "train", path).collect()
    assert [[g.phrase for g in r.region] for r in train] == [["s"]]
    valid = loaders.visual_genome_regions(images, held, "validation", path).collect()
    assert [list(g.bbox) for r in valid for g in r.region] == [[0, 0, 50, 10]]
    pictures = spark.createDataFrame([("p.jpg", "A cat dog", 100, 50, 100, 50, [[6.0, 9.0, 0.1, 0.2, 0.3, 0.4], [2.0, 5.0, 0.5, 0.5, 0.6, 0.6]], "u")], "path string, caption string, width int, height int, original_width int, original_height int, noun_chunks array<array<double>>, url string")
    g = loaders.grit(pictures).first()
    assert g.caption == "A ||cat <coords_0>|| ||dog <coords_1>||"
    assert [r.phrase for r in g.region] == ["cat", "dog"]
    chat = spark.createDataFrame([("1", "i.jpg", [("human", "hi"), ("gpt", "ho")])], "id string, image string, conversations array<struct<`from`:string,value:string>>")
    assert [t.role for t in loaders.llava_instruct(chat, path).first().chat] == ["human", "gpt"]
    w7 = spark.createDataFrame([(1, "train", "f.jpg", 10, 10, [("q?", "r", ["w", "x"])])], "image_id long, split string, filename string, width int, height int, qa_pairs array<struct<question:string,answer:string,multiple_choices:array<string>>>")
    assert loaders.visual7w(w7, "train", path).count() == 3
    boxes = spark.createDataFrame([("r", 1, 1, 2, 2), ("w", 0, 0, 99, 5), ("x", 3, 3, 1, 1)], "box_id string, x int, y int, width int, height int")
    pointed = loaders.visual7w(w7, "train", path, boxes=boxes).collect()
    assert len(pointed) == 3
    assert {g.phrase for g in pointed[0].region} == {"r", "w", "x"}
    narrated = spark.createDataFrame([(1, "c", 10, 10, [[(0.5, 0.5, 0.0), (2.0, 0.5, 0.1), (0.1, 0.1, 0.9)], []])], "image_id long, caption string, width int, height int, traces array<array<struct<x:double,y:double,t:double>>>")
    assert json.loads(loaders.localized_narratives(narrated, path).first().metadata)["traces_downsampled"] == [[{"x": 10.0, "y": 5.0, "t": 0.1}], []]
    # Two narratives of one picture with one caption keep their own traces.
    twins = spark.createDataFrame([(1, "c", 10, 10, [[(0.1 * k, 0.5, 0.3 * k) for k in range(n)]]) for n in (1, 9)], narrated.schema)
    assert sorted(len(json.loads(r.metadata)["traces_downsampled"][0]) for r in loaders.localized_narratives(twins, path).collect()) == [1, len(traces.segment_times([0.3 * k for k in range(9)], 0.4))]
    with pytest.raises(Exception, match="spans_apart"):
        loaders.grit(pictures.withColumn("noun_chunks", F.concat("noun_chunks", F.array(F.array(*[F.lit(float(v)) for v in (3, 7, 0, 0, 1, 1)]))))).collect()


def test_more_loaders(spark):
    path = loaders.in_folder("d")
    books = spark.createDataFrame([("1", "u1", 1, ["q1", "q2"], ["a1", "a2"], "t", "n", "g"), ("2", "u2", 1, ["q"], ["a"], "t", "n", "g"), ("3", "u2", 1, ["q"], ["a"], "t", "n", "g")], "id string, image_url string, split int, questions array<string>, answers array<string>, title string, author_name string, genre string")
    keep = spark.createDataFrame([("u1", True)], "image_url string, keep boolean")
    assert [len(r.qa_pairs) for r in loaders.ocr_vqa(books, keep, "train", path).collect()] == [2]
    docs = spark.createDataFrame([("i", 1, "what?", ["x", "y", "y"], 1, "d", "p", 0), ("i", 2, "why?", None, 1, "d", "p", 1)], "image string, question_id long, question string, answers array<string>, doc_id long, ucsf_document_id string, ucsf_document_page_no string, pos long")
    assert [(p.question, p.answer) for p in loaders.docvqa(docs, path).first().qa_pairs] == [("What?", "y"), ("Why?", None)]
    coco = spark.createDataFrame([(1, "restval", [10, 11], ["c1", "c2"]), (2, "test", [12], ["c3"])], "cocoid long, split string, sentids array<long>, sentences array<string>")
    assert sorted(r.caption for r in loaders.coco(coco, "train", loaders.coco_path("c")).collect()) == ["c1", "c2"]
    images = spark.createDataFrame([("i1", "p1", 5, 5)], "image_id string, image_path string, width int, height int")
    regions = spark.createDataFrame([("a", "i1", 0.0, 0.0, 2.0, 2.0, 0), ("b", "i1", 1.0, 1.0, 1.0, 1.0, 1), ("c", "i1", 1.0, 1.0, 1.0, 1.0, 2)], "annotation_id string, image_id string, x double, y double, w double, h double, pos long")
    said = spark.createDataFrame([("a", "first", 0), ("a", "last", 1), ("b", "only", 2)], "annotation_id string, sentence string, pos long")
    train = loaders.refcoco(images, regions, said, "train", path).collect()
    assert [[g.phrase for g in r.region] for r in train] == [["last", "only"]]
    assert loaders.refcoco(images, regions, said, "test", path).count() == 2
    notes = spark.createDataFrame([("1", "i", [("human", "<image>\nSay"), ("gpt", "cap")], 0)], "id string, image string, conversations array<struct<role:string,text:string>>, pos long")
    details = spark.createDataFrame([("1", "i", "u", 0)], "id string, image string, url string, pos long")
    assert loaders.llava_pretrain(notes, details, path).first().caption == "cap"
    with pytest.raises(Exception, match="differs"):
        loaders.llava_pretrain(notes, details.withColumn("image", F.lit("j")), path).collect()
    pope = spark.createDataFrame([(1, "i.jpg", "Is it?", "yes")], "question_id long, image string, text string, label string")
    assert loaders.pope(pope, "random", path).first().qa_pairs[0].answer is None
    gqa = spark.createDataFrame([("q2", "i", "b?", "y", "yes it is", True), ("q1", "i", "a?", "n", "no", False)], "question_id string, image_id string, question string, answer string, full_answer string, is_balanced boolean")
    assert [p.answer for p in loaders.gqa(gqa, path, short=False).first().qa_pairs] == ["no", "yes it is"]
    assert loaders.gqa(gqa, path, balanced=True).count() == 1
    rel = spark.createDataFrame([(1, None, 9, 9, [("on", (["a"], 0, 0, 1, 1), (["b"], 1, 1, 2, 2))])], "image_id long, coco_id long, width int, height int, relationships array<struct<predicate:string,subject:struct<names:array<string>,x:int,y:int,w:int,h:int>,object:struct<names:array<string>,x:int,y:int,w:int,h:int>>>")
    held = spark.createDataFrame([(9,)], "coco_id long")
    assert loaders.visual_genome_relations(rel, held, "train", path).first().relation[0].predicate == "on"
    caps = spark.createDataFrame([("i", "c", 1)], "image_id string, caption_str string, caption_id long")
    ocr = spark.createDataFrame([("i", ["old"], 0), ("i", ["new"], 1)], "image_id string, ocr_info array<string>, pos long")
    assert json.loads(loaders.text_caps(caps, ocr, path).first().metadata)["ocr"] == ["new"]
    quest = spark.createDataFrame([("i", 1, "q", ["a"] * 10, 0)], "image_id string, question_id long, question string, answers array<string>, pos long")
    assert loaders.text_vqa(quest, ocr, path).first().qa_pairs[0].answer == "a"


def test_runs_over_the_whole_table(spark, monkeypatch):
    monkeypatch.setattr("lumenweave.operators.ranking.ROWS_A_BUCKET", 7)
    rng = random.Random(3)
    keys = [rng.choice(["a", "b", None]) for _ in range(200)] + ["c"] * 60
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, pos long").repartition(5)
    run, wanted = 0, []
    for i, k in enumerate(keys):
        run += i == 0 or k != keys[i - 1]
        wanted.append((i, run))
    assert sorted((r.pos, r.run_id) for r in grouping.run_groups(df, "k", "pos").collect()) == wanted
    assert grouping.run_groups(df.limit(0), "k", "pos").count() == 0


def test_hot_keys_are_packed_alike(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else f"k{i % 7}", i) for i in range(300)], "k string, pos long")
    plain = {(r.k, r.chunk): r["items"] for r in packing.pack(df, ["k"], ["pos"], 5, "pos").collect()}
    hot = {(r.k, r.chunk): r["items"] for r in packing.pack(df, ["k"], ["pos"], 5, "pos", rows_a_key=40).collect()}
    assert plain == hot
    assert packing.pack(df.limit(0), ["k"], ["pos"], 5, "pos").count() == 0


def test_hot_join(spark):
    left = spark.createDataFrame([("h", i) for i in range(50)] + [("a", 1), ("b", 2), (None, 3)], "k string, v long")
    right = spark.createDataFrame([("h", "H"), ("a", "A")], "k string, w string")
    hot = joins.hot_keys(left.groupBy("k").count(), "count", 53, hot_rows=20)
    assert [r.k for r in hot.collect()] == ["h"]
    for how in ("inner", "left"):
        assert sorted(map(str, joins.hot_join(left, right, ["k"], hot, how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_first_existing_keeps_equal_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "z")], "n int, name string").withColumn("m", F.create_map(F.lit("k"), F.col("n")))
    listing = spark.createDataFrame([("x/a",), ("y/a",)], "path string")
    got = joins.first_existing(df, [F.concat(F.lit("w/"), F.col("name")), F.concat(F.lit("y/"), F.col("name")), F.concat(F.lit("x/"), F.col("name"))], listing, "path")
    assert sorted((r.n, r.found_path or "") for r in got.collect()) == [(1, "y/a"), (1, "y/a"), (2, "")]
    assert got.columns == ["n", "name", "m", "found_path"]


def test_evaluators(spark):
    truth = spark.createDataFrame([(1, "Yes"), (2, "no"), (3, "x")], "question_id int, answer string")
    said = spark.createDataFrame([(1, "YES.<|endoftext|>junk"), (2, "yes<|endoftext|>")], "question_id int, prediction string")
    assert evaluators.evaluate_exact(truth, said).first().accuracy == pytest.approx(33.33)
    boxes = spark.createDataFrame([(1, [0.0, 0.0, 50.0, 50.0], 100, 100), (2, [0.0, 0.0, 50.0, 50.0], 100, 100)], "region_id int, box array<double>, width int, height int")
    said = spark.createDataFrame([(1, "[0.00,0.00,0.50,0.50].<|endoftext|>"), (2, "nothing.<|endoftext|>")], "region_id int, prediction string")
    assert evaluators.evaluate_boxes(boxes, said).first().accuracy == 50.0
    refs = spark.createDataFrame([(1, "a cat on a mat"), (1, "dogs")], "image_id int, reference string")
    said = spark.createDataFrame([(1, "A cat on a hat.<|endoftext|>")], "image_id int, prediction string")
    assert evaluators.evaluate_captions(refs, said).first().precision == pytest.approx(0.75)
    assert one(spark, evaluators.prompt_vqa(F.lit("what?"), ocr_words=F.array(F.lit("a"), F.lit("b")))).endswith("OCR text:\na b\nQuestion: What?\nAnswer: ")


def test_turns(spark, records):
    made = records(
        {"record_id": 1, "task": "vqa", "qa_pairs": [("what?", "a cat"), ("why?", None)], "source": "docvqa", "metadata": "{}"},
        {"record_id": 2, "task": "image_text_match", "caption": "x", "metadata": '{"label": 0}'},
        {"record_id": 3, "task": "multiple_choice_vqa", "qa_pairs": [("which?", "b")], "metadata": '{"choices": ["a", "b"]}'},
    )
    got = {r.record_id: [(t.text, t.is_target) for t in r.turns] for r in sequence.turns_of(made).collect()}
    assert got[1][1:] == [("\nQuestion: what?\nAnswer: ", False), ("a cat.<|endoftext|>", True), ("\nQuestion: why?\nAnswer: ", False)]
    assert got[2][-1] == ("False.<|endoftext|>", True)
    assert got[3][-2:] == [("B: B\nAnswer: ", False), ("B.<|endoftext|>", True)]
    with pytest.raises(Exception, match="no template"):
        sequence.turns_of(records({"record_id": 1, "task": "object_detection", "metadata": "{}"})).collect()


class Letters:
    def encode(self, text):
        return [ord(c) for c in text]


def test_tokenizer_can_be_given(spark, records):
    made = sequence.turns_of(records({"record_id": 2, "task": "captioning", "caption": "x", "metadata": "{}"}))
    row = sequence.tokenized(made, "turns", Letters()).first()
    assert "".join(map(chr, row.input_ids)).endswith("X.<|endoftext|>")
    assert row.labels[0] == -100
    assert row.labels[-1] == ord(">")


def test_to_record(spark):
    made = schema.to_record(spark.range(1), task=F.lit("vqa"))
    assert made.columns == schema.RECORD.names
    with pytest.raises(ValueError, match="no such"):
        schema.to_record(spark.range(1), nothing=F.lit(1))


def test_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    query = streaming.windowed_counts(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    got = sorted(map(tuple, spark.sql("SELECT * FROM windows").collect()))
    assert got == sorted(map(tuple, streaming.windowed_counts(events, "ts", "event_type").collect()))


def test_plans(spark):
    """No Python runs where expressions do, and filters reach the scan."""
    from lumenweave.plans import relational_queries as q

    plan = q.QUERIES["semi_join"](spark, SMALL)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in plan
    for name in ("majority_vote", "frequency_cap", "choice_swap", "pack_chunks"):
        assert "EvalPython" not in q.QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()


def test_seeds_shares(spark):
    counts = {r.new_split: r["count"] for r in curation.hash_split(spark.range(20_000), "id").groupBy("new_split").count().collect()}
    assert 0.88 < counts["train"] / 20_000 < 0.92
    random.seed(0)
