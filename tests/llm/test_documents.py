"""Encoding, packing and text quality, with awkward texts."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenweave.llm import bpe, queries, sequence_packing, text_quality

from ..conftest import SMALL

FILE = f"{queries.TOKENIZERS}/byte_bpe_50k.json"
AWKWARD = [
    "", None, " ", "\n\n \t", "a" * 3000, "aaaa aaa aa", "<|endoftext|> x", "\x1c\x1d a\x1e\x1fb \x85 c d e", "🤦🏽‍♀️ 한국어 العربية", "ab" * 5000, "x​ y", "\x00\x01\x02", "don't we'll I'VE 123 ４５ ½", "  two  spaces   three\r\n", "a", "naïve café", "日本語の文章。",
]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.PairVocabulary(FILE)


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def lists(encoder, texts):
    ids, offsets = encoder(texts)
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def test_awkward_texts(vocabulary, reference):
    encoder = bpe.TextEncoder(vocabulary)
    assert lists(encoder, AWKWARD) == [reference(t) for t in AWKWARD]
    assert lists(encoder, AWKWARD) == [reference(t) for t in AWKWARD]  # all pieces known by now
    assert lists(encoder, []) == []
    assert lists(encoder, [None, ""]) == [[], []]


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'aAeth0.")), max_size=60), max_size=5))
def test_any_text(vocabulary, reference, texts):
    assert lists(bpe.TextEncoder(vocabulary), texts) == [reference(t) for t in texts]


def test_a_full_store_starts_anew(vocabulary, reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    encoder = bpe.TextEncoder(vocabulary)
    for text in ("one two three four five", "six seven", "one two"):
        assert lists(encoder, [text]) == [reference(text)]


def test_ids_of_a_table(spark, reference):
    rows = [(i % 7, t, "x") for i, t in enumerate(AWKWARD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_texts(df, "doc_id", "text", FILE).collect())
    assert got == sorted((k, reference(t)) for k, t, _ in rows)
    assert bpe.encode_texts(df.limit(0), "doc_id", "text", FILE).count() == 0
    counts = sorted((r.doc_id, r.n_tokens) for r in bpe.count_tokens(df, "doc_id", "text", FILE).collect())
    assert counts == sorted((k, len(reference(t))) for k, t, _ in rows)


def test_documents(spark, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r.ids for r in queries.p7_ids(spark, SMALL).collect()}
    assert got == {k: reference(t) for k, t in texts.items()}


# ---------------------------------------------------------------- 8


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 300), st.data())
def test_packing_keeps_every_item(capacity, data):
    counts = data.draw(st.dictionaries(st.integers(1, capacity), st.integers(0, 40), max_size=25))
    packed = sequence_packing.pack_counts(counts, capacity)
    got = Counter()
    for c in packed:
        assert sum(c.lengths) <= capacity
        assert c.count > 0
        for length in c.lengths:
            got[length] += c.count
    assert got == Counter({k: n for k, n in counts.items() if n})
    assert sum(c.count for c in packed) >= sequence_packing.lower_bound(counts, capacity)


@pytest.mark.parametrize("capacity", [128, 1024, 5000])
def test_packing_is_tight(capacity):
    rng = np.random.default_rng(0)
    counts = Counter(np.clip(rng.lognormal(4.5, 1, 20_000).astype(int), 1, capacity).tolist())
    n = sum(c.count for c in sequence_packing.pack_counts(counts, capacity))
    assert n <= 1.01 * sequence_packing.lower_bound(counts, capacity) + 1


def test_characters_are_counted_by_kind():
    lines = ["aé1 \t.«x»", "漢字、かな！", "a\u0301 😀 𝔸𝟙 │█\ufffd", "\u00a0\u3000\x85", "$+<~`|^=", "\u2028x"]
    patterns = {"letters": r"[\p{L}\p{M}]", "digits": r"\p{N}", "spaces": r"[\s\p{Z}]", "blocks": r"[\x{2500}-\x{25FF}\x{FFFD}\x{0080}-\x{009F}]", "special": r"[\pP\pS\pN\s]", "ascii_letters": "[A-Za-z]"}
    got = text_quality.count_characters(pa.array(lines), np.array([len(x) for x in lines]))
    for name, pattern in patterns.items():
        assert got[name].tolist() == pc.count_substring_regex(pa.array(lines), pattern).to_pylist(), name
    assert got["plain"].tolist() == [sum(c in text_quality._PLAIN for c in x) for x in lines]
    assert text_quality.count_characters(pa.array([], pa.string()), np.zeros(0, int))["letters"].tolist() == []


def test_best_pattern_equals_brute_force():
    rng = np.random.default_rng(1)
    for steps in (1, 5, 9):
        gain = np.where(rng.random(steps + 1) < 0.2, -np.inf, rng.normal(size=steps + 1))
        brute = max((sum(gain[list(p)]) for n in range(1, 5) for p in itertools.combinations_with_replacement(range(1, steps + 1), n) if sum(p) == steps), default=-np.inf)
        best, pattern = sequence_packing.best_pattern(gain, steps, 4)
        assert best == pytest.approx(brute)
        assert best == -np.inf or (sum(pattern) == steps and sum(gain[list(pattern)]) == pytest.approx(best))


def test_patterns_fit_the_counts():
    rng = np.random.default_rng(4)
    patterns = [(9, 1), (5, 5), (4, 3, 3), (2, 2, 2, 2, 2), (6, 4)]
    totals = np.zeros(11)
    for p in patterns:
        n = rng.integers(50, 400)
        for s in p:
            totals[s] += n
    fitted = sequence_packing.fit_patterns(totals)
    assert all(sum(p) == 10 and x > 0 for p, x in fitted.items())
    assert np.abs(sum(x * np.bincount(p, minlength=11) for p, x in fitted.items()) - totals).max() < 1
    assert sequence_packing.fit_patterns(np.zeros(5)) == {}


def test_most_items_come_from_patterns():
    """Six and more lengths in a sequence: what is left for best fit is a minority."""
    rng = np.random.default_rng(0)
    counts = Counter(np.clip(rng.lognormal(4.8, 1, 60_000).astype(int), 1, 1023).tolist())
    held, best_fit = [], sequence_packing._best_fit
    try:
        sequence_packing._best_fit = lambda filled, left, capacity: held.append(sum(left.values())) or best_fit(filled, left, capacity)
        packed = sequence_packing.pack_counts(counts, 1024)
    finally:
        sequence_packing._best_fit = best_fit
    assert held[0] < 0.25 * sum(counts.values())
    assert sum(c.count for c in packed) <= 1.01 * sequence_packing.lower_bound(counts, 1024)


def test_sequences_of_a_table(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 5, 64, 100, 128, 129, 300, 256]), "x") for i in range(400)] + [(900, 100_000, "x")]
    sizes = spark.createDataFrame(rows, "doc_id long, n_tokens long, stage_name string")
    budgets = spark.createDataFrame([("a", 128), ("b", 1000), ("c", None), ("d", 0)], "stage_name string, capacity_tokens int")
    packed = sequence_packing.pack(sizes, budgets)
    got = packed.toPandas()
    for stage, capacity in (("a", 128), ("b", 1000)):
        own = got[got.stage_name == stage]
        assert own.groupby("doc_id").n_tokens.sum().to_dict() == {k: n for k, n, _ in rows}
        used = own[own.sequence_id.notna()].sort_values(["sequence_id", "offset"])
        assert used.groupby("sequence_id").n_tokens.sum().max() <= capacity
        following = used.groupby("sequence_id").offset.shift(-1)
        assert ((used.offset + used.n_tokens)[following.notna()] <= following[following.notna()]).all()
        pieces = own.groupby("doc_id").size()
        assert all(n == 1 for k, n in pieces.items() if dict((r[0], r[1]) for r in rows)[k] <= capacity)
    assert set(got.stage_name) == {"a", "b"}
    again = sequence_packing.pack(sizes.repartition(9), budgets)
    assert sorted(map(str, again.collect())) == sorted(map(str, packed.collect()))
    report = {r.stage_name: r for r in sequence_packing.report(packed, budgets).collect()}
    assert report["a"].used_share > 0.95
    assert report["c"].n_sequences == 0
    assert sequence_packing.pack(sizes.limit(0), budgets).count() == 0
    assert sequence_packing.pack(sizes, budgets.limit(0)).count() == 0


# ---------------------------------------------------------------- 9

PROSE = "The cat sat on the mat and looked at the dog in the garden. It was a very warm day for them."
TEXTS = [
    (None, None), ("", None), (" \n\t", None), (PROSE, None), (PROSE.upper(), None), ("the cat sat on the mat and then the dog came to the garden", None), ("写真には白い犬が写っています。", None), ("- a cat\n- a dog\n- a red bird", "list"),
    ("1. one thing\n2. another thing", "list"), ("a cat\na red dog\nthe old bird on a tree\na mouse", "list"), ("cat, dog, red bird, mouse, horse", "list"), ("| a | b |\n| --- | --- |\n| 1 | 2 |", "table"), ("name\tx\ty\ncat\t1\t2", "table"), ("name,x,y,z\ncat,1,2,3\ndog,4,5,6", "table"),
    ("name   x    y\ncat    1    2\ndog    3    4", "table"), ("QmFzZTY0" * 30, "junk"), ("de ad be ef 00 11 22 33 44 55", "junk"), ("<div id='a'><p></p></div><div id='b'></div>", "junk"), ("@#$%^&*!!@#$%^&*", "junk"), ("buy now " * 40, "junk"), ("�▒□▒�□", "junk"),
    ("function f(){var a=[1,2];return a.map(x=>x*3);}", "junk"), (PROSE + "\n- a cat\n- a dog", None), ("Things seen.\n" + "- a cat on a mat\n" * 3 + "- one dog\n- two birds and a mouse", "list"), ("word " * 60_000, "junk"), ((PROSE + " ") * 1, None), ("Hello", None),
]


def test_kinds():
    common = "the a an of and to in is it on with that for are this at as was very them".split()
    got = text_quality.Measure(common)(pa.array([t for t, _ in TEXTS], pa.string()))
    assert [(t and t[:40], k) for (t, _), k in zip(TEXTS, got["kind"], strict=True)] == [(t and t[:40], k) for t, k in TEXTS]
    assert all((r is None) == (k is None) for r, k in zip(got["kind_rule"], got["kind"], strict=True))


def repeated_by_definition(codes):
    """Items of stretches that repeat four times with any period."""
    out = np.zeros(len(codes), bool)
    for period in range(1, len(codes)):
        run = 0
        for i in range(period, len(codes) + 1):
            if i < len(codes) and codes[i] == codes[i - period]:
                run += 1
                continue
            if run >= max(3 * period, 8):
                out[i - run - period : i] = True
            run = 0
    return out


def test_repetition_of_any_period():
    rng = np.random.default_rng(5)
    docs = [np.concatenate([rng.integers(0, letters, rng.integers(0, 90)), np.tile(rng.integers(0, letters, period), 6)[: int(period * times)], rng.integers(0, letters, 30)]) for period, times, letters in [(65, 4, 50), (64, 4.5, 9), (100, 3.9, 50), (128, 4, 3), (129, 5, 50), (200, 4.2, 2), (300, 3, 50), (3, 6, 9)]]
    docs.append(np.tile(np.concatenate([np.tile(rng.integers(0, 40, 70), 2), [41]]), 5))
    got = text_quality._repeated_words(np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs]))
    assert got.tolist() == np.concatenate([repeated_by_definition(d) for d in docs]).tolist()
    assert got.any()
    assert not got.all()


def test_repeated_passages_are_junk():
    rng = np.random.default_rng(6)
    said = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(n))
    kana = "".join(chr(0x3042 + c) for c in rng.integers(0, 60, 90))
    texts = [(said(65) + ". ") * 8, (said(150) + ".\n") * 6, (said(700) + ". ") * 5, "写真には白い犬が写っています。" * 12, kana * 5, said(400) + ".", (said(100) + ". ") * 2, "".join(chr(0x3042 + c) for c in rng.integers(0, 60, 400)) + "。"]
    got = text_quality.Measure(["the"])(pa.array(texts, pa.string()))
    assert got["kind_rule"] == ["repetition"] * 5 + [None] * 3


def test_statistics():
    got = text_quality.Measure(["the"])(pa.array(["The cat.\n# ... x\nthe cat", None, "the " * 60], pa.string()))
    assert got["word_count"] == [7, 0, 60]
    assert got["line_count"] == [3, 0, 1]
    assert got["punctuated_line_share"][0] == pytest.approx(1 / 3)
    assert got["symbol_ratio"][0] == pytest.approx(2 / 7)
    assert got["common_word_count"] == [2, 0, 60]
    assert got["failures"][1] == []
    assert {"word_count", "symbol_ratio"} <= set(got["failures"][0])
    assert got["mean_word_length"][2] == 3


def test_measured_table(spark):
    df = spark.createDataFrame([(i % 5, t, "x") for i, (t, _) in enumerate(TEXTS)], "doc_id long, text string, kind string")
    words = spark.createDataFrame([("en", "the"), ("en", None)], "lang string, word string")
    assert text_quality.measure(df, "doc_id", "text", words).count() == len(TEXTS)
    assert text_quality.measure(df.limit(0), "doc_id", "text", words.limit(0)).count() == 0


def test_batches_do_not_matter(spark, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    measured = text_quality.Measure(["the", "a", "of"])
    whole = measured(pa.array(texts, pa.string()))
    single = [measured(pa.array([t], pa.string())) for t in texts]
    assert whole["kind"] == [s["kind"][0] for s in single]
    assert whole["word_count"] == [s["word_count"][0] for s in single]
