"""Pictures of evaluation records that occur, exactly or almost, in training records.

Distinct pictures of the evaluation side are cut into shards, and each shard is
put into compressed full-text indexes; the distinct pictures of the training side
are streamed through backward search. A thumbnail's 64 places stand in a ring of
eight groups of eight, in a seeded order, and from every group on the 16 places that
follow are a text. If two thumbnails differ by at most ``limit`` in all, there is a
group from which on every run of m groups differs by at most m/8 of it (else the
ring could be cut into runs that together exceed it).

A group's symbols are eight sums of its levels, each with other signs (a Hadamard
matrix), in steps of equal numbers of evaluation texts. Two groups that differ by d
have no sum that differs by more than d, so search follows the steps within the share
of a group, and no pair is missed. Sums are worth more than levels here: they vary
almost three times as much as a level, each may use the share by itself, and the
steps get finer the more texts there are. The steps of the last group are looked up;
wide ranges are searched on, narrow ones are compared by their levels at once.

A match is a span of four blocks of four places with the distance of each. The spans
of a pair are merged: where they cover the whole ring, its distance is known and
decides; where what they cover exceeds the limit, the pair is dropped; only what is
left is compared by all levels.

A training text only visits shards that hold last groups within its share: rows are
routed by the same sums, so nothing is broadcast and no side is repeated as a whole.
If many evaluation texts end alike, as of almost empty pages, they are hot: they are
dealt to several shards and meet the training texts in blocks, and their texts go on
round the whole ring, so that a match is a maximal one and only pairs within the
limit come out, however many texts agree in one span.

Equal picture keys meet in a join. Copies of one thumbnail or key are one text;
record pairs come last, by membership, in equi-joins whose skewed partitions Spark
splits. The report is made from links and counts of members, without record pairs.

Defined cases: null splits are on neither side; records without a key and
without bytes of 64 levels match nothing; repeated rows of a record count once;
empty tables and empty sides give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.metadata import fields, picture_key
from lumenweave.llm.fm_index import FMIndex
from lumenweave.storage import write_table

TRAINING = ("train", "restval")
EVALUATION = ("validation", "val", "test", "teststd", "testdev")
POSITIONS, BLOCK, LENGTH = 64, 4, 16
BLOCKS = POSITIONS // BLOCK
#: Places of a group; a text begins at each group of the ring. Groups, and blocks of a group.
GROUP = 8
GROUPS, STEP = POSITIONS // GROUP, GROUP // BLOCK
#: Signs of a group's eight sums, the rows of a Hadamard matrix.
_SIGNS = np.array([[1 - 2 * ((i & j).bit_count() % 2) for j in range(GROUP)] for i in range(GROUP)], np.int16)
#: Most steps of a sum: its sixteenths among the evaluation texts. Sums are counted in bins of ``BIN`` from ``LEAST`` on.
FINE, BIN, LEAST, BINS = 16, 8, -1024, 384
#: Texts in a range that are compared at once instead of being searched on, and training texts and pairs held at once.
NARROW, TEXTS_AT_ONCE, PAIRS_AT_ONCE = 256, 4_096, 131_072
_MARK = FINE + 1  # code of the end of a text
_ROUTED = pa.schema([("shard", pa.int32()), ("side", pa.int8()), ("kind", pa.int8()), ("text_id", pa.int64()), ("text", pa.binary())])
_MATCH = pa.schema([("train_id", pa.int64()), ("eval_id", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def _starts() -> np.ndarray:
    """For every group of the ring, all positions from it on; the group itself comes last, as search goes backwards."""
    ring = np.random.default_rng(1).permutation(POSITIONS)
    return np.stack([ring[(np.arange(POSITIONS)[::-1] + GROUP * g) % POSITIONS] for g in range(GROUPS)])


def _shares(limit: int) -> np.ndarray:
    """The largest summed difference after each place of the ring, from a text's end."""
    return limit * (np.arange(POSITIONS) // GROUP + 1) // GROUPS


def sides(records: DataFrame) -> DataFrame:
    """``record_id, side, split, source, key, bytes``: side 0 is evaluation, side 1 is training."""
    # Only a text that may name the field is parsed; a field's name could also be written with escapes.
    named = F.contains("metadata", F.lit("coco_id")) | F.contains("metadata", F.lit("\\u"))
    j = fields(F.when(F.col("image")["path"].isNull() | named, F.col("metadata")), "image_path", "coco_id")
    r = records.filter(F.col("split").isin(*TRAINING, *EVALUATION)).select("record_id", "split", "source", F.col("image")["path"].alias("path"), F.col("image")["bytes"].alias("bytes"), j.alias("j"))
    side = F.when(F.col("split").isin(*TRAINING), 1).otherwise(0).cast("tinyint")
    levels = F.when(F.octet_length("bytes") == POSITIONS, F.col("bytes"))
    return r.select("record_id", side.alias("side"), "split", "source", picture_key(F.coalesce("path", F.col("j.image_path")), F.col("j.coco_id")).alias("key"), levels.alias("bytes"))


def _texts(base: DataFrame, column: str) -> DataFrame:
    return base.filter(F.col(column).isNotNull()).groupBy("side", column).agg(F.min("record_id").alias("text_id"))


def _sums(levels: np.ndarray) -> np.ndarray:
    """The signed sums of each group of places. None of them differs by more than the group's places do in all."""
    return (levels.reshape(-1, GROUP).astype(np.int16) @ _SIGNS).reshape(levels.shape)


def _edges(thumbs: DataFrame) -> np.ndarray:
    """``group of the ring, sum, edge``: where the evaluation texts' sums are cut into sixteenths. They decide the cost of a search only, not what it finds."""
    place = _starts()[0].reshape(GROUPS, GROUP)[::-1].ravel()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = (_sums(_levels(batch)[:, place]) - LEAST) // BIN + np.arange(POSITIONS) * BINS
            value, n = np.unique(bins, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int32)), pa.array(n.astype(np.int64))], names=["bin", "n"])

    counts = np.zeros(POSITIONS * BINS, np.int64)
    for r in thumbs.filter("side = 0").select("bytes").mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[r.bin] = r.n
    below = counts.reshape(POSITIONS, BINS).cumsum(1)
    cuts = np.stack([np.searchsorted(b, b[-1] * np.arange(1, FINE) / FINE) for b in below])
    return ((cuts + 1) * BIN + LEAST).astype(np.int16).reshape(GROUPS, GROUP, FINE - 1)


def _coarser(edges: np.ndarray, letters: int) -> np.ndarray:
    return edges[FINE // letters - 1 :: FINE // letters] if letters > 1 else edges[:0]


def _spread(bits: int, sums: int) -> list[int]:
    """Steps of each sum, powers of two of up to ``FINE``, the later sums first; ``bits`` in all."""
    most = FINE.bit_length() - 1
    bits = min(bits, most * sums)
    return [1 << (bits // sums + (i >= sums - bits % sums)) for i in range(sums)]


def _among(number: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's numbers, gone on with every letter from its ``low`` to its ``high``."""
    n = (high - low + 1)[row]
    first = np.cumsum(n) - n
    letter = np.arange(n.sum()) + np.repeat(low[row] + number * letters - first, n)
    return letter, np.repeat(row, n)


def _buckets(sums: np.ndarray, reach: int, letters: list[int], edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, bucket)``: the steps of the sums of a text's last group that are within ``reach``, 0 for the text's own."""
    row, bucket = np.arange(len(sums)), np.zeros(len(sums), np.int64)
    for j, n in enumerate(letters):
        if n > 1:
            own = _coarser(edges[j], n)
            low, high = (np.searchsorted(own, sums[:, j] + by, side="right") for by in (-reach, reach))
            bucket, row = _among(bucket, row, low, high, n)
    return row, bucket


def _levels(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bytes").to_pylist()), np.uint8).reshape(-1, POSITIONS)


def _counter(letters: list[int], edges: np.ndarray):
    """How many evaluation texts of a batch end in each bucket of each group."""
    starts = _starts()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = _levels(batch)
            for g in range(GROUPS):
                _, bucket = _buckets(_sums(levels[:, starts[g, -GROUP:]]), 0, letters, edges[g])
                value, n = np.unique(bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), g, np.int32)), pa.array(value), pa.array(n.astype(np.int64))], names=["block", "bucket", "n"])

    return count


def _router(shards: int, parts: int, letters: list[int], limit: int, edges: np.ndarray, hot: dict[tuple[int, int], tuple[int, int]]):
    """``parts``: shards for the texts of one group, by the sums of their last places. ``hot``: group and bucket -> first shard and k, which has k * k shards."""
    starts, reach = _starts(), int(_shares(limit)[0])
    buckets = int(np.prod(letters))

    def rows_of(shard: np.ndarray, side: np.ndarray, g: int, ids: np.ndarray, text: np.ndarray) -> pa.RecordBatch:
        flat = pa.py_buffer(np.ascontiguousarray(text).tobytes())
        offsets = pa.py_buffer(np.arange(0, text.shape[1] * (len(ids) + 1), text.shape[1], dtype=np.int32).tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(shard.astype(np.int32)), pa.array(side), pa.array(np.full(len(ids), STEP * g, np.int8)), pa.array(ids), pa.Array.from_buffers(pa.binary(), len(ids), [None, offsets, flat])], schema=_ROUTED
        )

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            side, ids = batch.column("side").to_numpy(), batch.column("text_id").to_numpy()
            levels = _levels(batch)
            for g in range(GROUPS):
                text = levels[:, starts[g]]
                sums = _sums(text[:, -GROUP:])
                found = [(np.flatnonzero(side == s), r) for s, r in ((0, 0), (1, reach))]
                found = [(of[at], bucket) for of, r in found for at, bucket in [_buckets(sums[of], r, letters, edges[g])]]
                row, bucket = (np.concatenate(x) for x in zip(*found, strict=True))
                for (block, value), (first, k) in hot.items() if hot else ():
                    if block != g:
                        continue
                    met = bucket == value
                    at, own = row[met], ids[row[met]] % k
                    row, bucket = row[~met], bucket[~met]
                    if len(at):
                        # Evaluation texts take a row of the square of shards, training texts a column: each two meet once.
                        every = np.arange(k)[None, :]
                        shard = first + np.where(side[at, None] == 0, own[:, None] * k + every, every * k + own[:, None])
                        again = np.repeat(at, k)
                        yield rows_of(shard.ravel(), side[again], g, ids[again], text[again])
                shard = (g * parts + bucket * parts // buckets) % shards
                # A text goes to a shard once, even if several of its variants lie there.
                one = np.unique(row * shards + shard)
                row, shard = one // shards, one % shards
                if len(row):
                    yield rows_of(shard, side[row], g, ids[row], text[row, -LENGTH:])

    return route


def _differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The summed difference of groups of eight levels, each group in one word."""
    x, y = a.view(np.uint8), b.view(np.uint8)
    d = (np.maximum(x, y) - np.minimum(x, y)).view(np.uint64)
    low = np.uint64(0x00FF00FF00FF00FF)
    pairs = (d & low) + (d >> np.uint64(8) & low)
    return (pairs * np.uint64(0x0001000100010001) >> np.uint64(48)).astype(np.int32)


class _Texts:
    """The index of the evaluation texts of one shard that begin at one group of the ring. All have one length.

    Of each group its sums are the symbols, in as many steps as ``letters`` says. Those of a text's last group are looked up,
    in the same order as the backward search would take them.
    """

    def __init__(self, kind: int, ids: np.ndarray, texts: list[bytes], limit: int, letters: list[int], edges: np.ndarray) -> None:
        self.shares, self.ids, self.length, self.letters = _shares(limit)[: len(texts[0])], ids, len(texts[0]), letters
        levels = np.frombuffer(b"".join(texts), np.uint8).reshape(-1, self.length)
        sums = _sums(levels)
        codes = np.full((len(texts), self.length + 1), _MARK, np.uint8)
        # Edges by place from the text's end, where its group comes first.
        self.edges = []
        for k in range(self.length):
            j = GROUP - 1 - k % GROUP
            self.edges.append(_coarser(edges[(kind // STEP + k // GROUP) % GROUPS, j], letters[j]))
            codes[:, self.length - 1 - k] = 1 + np.searchsorted(self.edges[k], sums[:, self.length - 1 - k], side="right")
        self.index = FMIndex(codes.ravel(), self.length + 1)
        ends = codes[:, self.length - GROUP : self.length].astype(np.int64)[:, ::-1] - 1
        self.first, self.last = ends.min(0), ends.max(0)
        self.low, self.high = self.index.ending_among(_MARK, [np.arange(a, b + 1) + 1 for a, b in zip(self.first, self.last, strict=True)])
        sizes = self.last - self.first + 1
        some = (self.low < self.high).reshape(sizes[0], -1).any(0)
        self.filled = [some.reshape(int(np.prod(sizes[1 : k + 1])), -1).any(1) for k in range(1, GROUP)]
        self.levels, self.words = levels, self._words(levels)

    def _words(self, levels: np.ndarray) -> np.ndarray:
        """The groups from the text's end on, one word a text."""
        return np.ascontiguousarray(np.ascontiguousarray(levels).view(np.uint64).T[::-1])

    def _ranges(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text, low, high)`` of what may agree in the last group: every sum is within the share by itself, and the steps of the last one are one range."""
        steps = []
        for k in range(GROUP):
            low, high = (np.searchsorted(self.edges[k], sums[:, self.length - 1 - k] + by, side="right") for by in (-self.shares[0], self.shares[0]))
            steps.append((np.maximum(low, self.first[k]) - self.first[k], np.minimum(high, self.last[k]) - self.first[k]))
        q = np.flatnonzero(np.all([low <= high for low, high in steps], 0))
        number = np.zeros(len(q), np.int64)
        for k in range(1, GROUP):
            if self.last[k] > self.first[k]:
                number, q = _among(number, q, *steps[k], self.last[k] - self.first[k] + 1)
                some = self.filled[k - 1][number]
                number, q = number[some], q[some]
        rest = len(self.filled[-1])
        low, high = self.low[steps[0][0][q] * rest + number], self.high[steps[0][1][q] * rest + number]
        some = low < high
        return q[some], low[some], high[some]

    def find(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(text, evaluation id, distances of the blocks from the text's end on)`` of all matches."""
        levels = np.frombuffer(b"".join(texts), np.uint8).reshape(-1, self.length)
        sums = _sums(levels)
        bounds = [np.concatenate([[-9_999], e, [9_999]]).astype(np.int16) for e in self.edges]

        def cost(k: int, q: np.ndarray, letter: int) -> np.ndarray:
            own = sums[q, self.length - 1 - k]
            return np.maximum(np.maximum(bounds[k][letter] - own, own - bounds[k][letter + 1] + 1), 0)

        q, low, high = self._ranges(sums)
        begun = (q, low, high, np.zeros(len(q), np.int32))
        q, low, high = self.index.search_on(begun, range(GROUP, self.length), cost, lambda k: len(self.edges[k]) + 1, self.shares, NARROW, GROUP)
        asked = self._words(levels)
        cuts = np.flatnonzero(np.diff(np.cumsum(high - low) // PAIRS_AT_ONCE)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(q)], strict=True):
            own, text = self.index.locate(q[a:b], low[a:b], high[a:b])
            spent = np.zeros(len(own), np.int32)
            for g in range(self.length // GROUP):
                spent = spent + _differences(asked[g][own], self.words[g][text])
                near = np.flatnonzero(spent <= self.shares[GROUP * g])
                own, text, spent = own[near], text[near], spent[near]
            if len(own):
                apart = np.abs(levels[own].astype(np.int16) - self.levels[text]).reshape(len(own), -1, BLOCK).sum(2)
                yield own, self.ids[text], apart.T[::-1].astype(np.int64)


class _Shard:
    """The evaluation texts of one shard, in an index for each group that they begin at, built when its first training text arrives."""

    def __init__(self, *options) -> None:
        self.options, self.ids, self.texts, self.built = options, {}, {}, {}

    def add(self, kind: int, ids: np.ndarray, texts: list[bytes]) -> None:
        self.ids.setdefault(kind, []).append(ids)
        self.texts.setdefault(kind, []).extend(texts)

    def find(self, kind: int, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if kind in self.ids:
            self.built[kind] = _Texts(kind, np.concatenate(self.ids.pop(kind)), self.texts.pop(kind), *self.options)
        if kind in self.built:
            yield from self.built[kind].find(texts)


def _span(kind: int, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A match's blocks in two words of eight bytes: bit 7 says that a block is covered, the others are its distance.

    Equal blocks have equal bytes, so spans of a pair are merged by OR. A distance above 127 is not kept; all levels decide then.
    """
    words = np.zeros((2, apart.shape[1]), np.uint64)
    for m, d in enumerate(apart):
        block = (kind + m) % BLOCKS
        words[block // 8] |= np.where(d < 128, d | 128, 0).astype(np.uint64) << np.uint64(8 * (block % 8))
    return words[0].view(np.int64), words[1].view(np.int64)


def _covered(word: str) -> Column:
    return F.bit_count(F.col(word).bitwiseAND(F.lit(-0x7F7F7F7F7F7F7F80)))


def _distance(word: str) -> Column:
    total = F.lit(0).cast("long")
    for i in range(8):
        total = total + F.shiftrightunsigned(word, 8 * i).bitwiseAND(F.lit(127))
    return total


def _searcher(limit: int, letters: list[int], edges: np.ndarray):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, current = _Shard(limit, letters, edges), -1
        for batch in batches:
            number, side, kind, ids = (batch.column(c).to_numpy() for c in ("shard", "side", "kind", "text_id"))
            cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(side) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(number)], strict=True):
                if a == b:
                    continue
                if number[a] != current:
                    shard, current = _Shard(limit, letters, edges), number[a]
                texts = batch.column("text").slice(a, b - a).to_pylist()
                if side[a] == 0:
                    shard.add(int(kind[a]), ids[a:b], texts)
                    continue
                for i in range(0, b - a, TEXTS_AT_ONCE):
                    for q, found, apart in shard.find(int(kind[a]), texts[i : i + TEXTS_AT_ONCE]):
                        low, high = _span(int(kind[a]), apart)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a + i : b][q]), pa.array(found), pa.array(low), pa.array(high)], schema=_MATCH)

    return search


def _exact(limit: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, POSITIONS).astype(np.int16) for c in ("a", "b"))
            yield batch.filter(pa.array(np.abs(a - b).sum(1) <= limit)).select(["train_id", "eval_id"])

    return check


def _ordered(thumbs: DataFrame, shard_texts: int, limit: int, edges: np.ndarray | None = None) -> DataFrame:
    """The texts of all groups, each shard's together, its evaluation side first."""
    edges = _edges(thumbs) if edges is None else edges
    n = thumbs.filter("side = 0").count()
    # A power of two, so that a shard's border is a step of one sum. Of few texts, groups share a shard.
    parts = 1 << (max(1, -(-n // shard_texts)) - 1).bit_length()
    shards = GROUPS * parts if parts > 1 else min(GROUPS, max(1, -(-4 * n * GROUPS // shard_texts)))
    letters, hot = _spread((16 * parts - 1).bit_length() if parts > 1 else 0, GROUP), {}
    if parts > 1:
        counted = thumbs.filter("side = 0").select("bytes").mapInArrow(_counter(letters, edges), "block int, bucket long, n long").groupBy("block", "bucket").agg(F.sum("n").alias("n"))
        # Fewer than half as many as there are shards: each has more texts than two shards.
        for r in counted.filter(F.col("n") > 2 * shard_texts).orderBy("block", "bucket").collect():
            k = -(-r.n // shard_texts)
            hot[r.block, r.bucket] = (shards + sum(m * m for _, m in hot.values()), k)
    whole = shards + sum(k * k for _, k in hot.values())
    routed = thumbs.mapInArrow(_router(shards, parts, letters, limit, edges, hot), "shard int, side tinyint, kind tinyint, text_id long, text binary")
    return routed.repartitionById(min(whole, 100_000), F.col("shard")).sortWithinPartitions("shard", "side", "kind")


def linked_texts(base: DataFrame, *, limit: int = 6 * POSITIONS, shard_texts: int = 60_000) -> DataFrame:
    """``train_id, eval_id``: the smallest records of all pairs of thumbnails within the limit.

    ``limit``: largest sum of grey level differences. ``shard_texts``: texts that a shard may have of one group.
    """
    thumbs = write_table(_texts(base, "bytes"), "thumbnails")
    edges = _edges(thumbs)
    # More steps the more texts, so that a cell has about eight over all steps of the last sum, which are looked up as one range.
    letters = [*_spread((thumbs.filter("side = 0").count() // 8).bit_length(), GROUP - 1), FINE]
    found = write_table(_ordered(thumbs, shard_texts, limit, edges).mapInArrow(_searcher(limit, letters, edges), "train_id long, eval_id long, low long, high long"), "matches")
    merged = found.groupBy("train_id", "eval_id").agg(F.bit_or("low").alias("low"), F.bit_or("high").alias("high"))
    known = merged.select("train_id", "eval_id", (_covered("low") + _covered("high")).alias("covered"), (_distance("low") + _distance("high")).alias("apart"))
    possible = write_table(known.filter(F.col("apart") <= limit), "possible")
    rest = possible.filter(F.col("covered") < BLOCKS)
    levels = lambda side, a, b: thumbs.filter(F.col("side") == side).select(F.col("text_id").alias(a), F.col("bytes").alias(b))
    paired = rest.join(levels(1, "train_id", "a"), "train_id").join(levels(0, "eval_id", "b"), "eval_id")
    near = paired.select("train_id", "eval_id", "a", "b").mapInArrow(_exact(limit), "train_id long, eval_id long")
    return possible.filter(F.col("covered") == BLOCKS).select("train_id", "eval_id").unionByName(near)


def _members(base: DataFrame, links: DataFrame, side: int, name: str) -> DataFrame:
    """``name`` of the thumbnail and ``record_id`` of its records, for thumbnails that have a link."""
    own = base.filter((F.col("side") == side) & F.col("bytes").isNotNull()).select("bytes", "record_id")
    first = own.groupBy("bytes").agg(F.min("record_id").alias(name)).join(links.select(name).distinct(), name, "left_semi")
    return own.join(first, "bytes").select(name, F.col("record_id").alias(f"record_{side}"))


def overlaps(base: DataFrame, **options: int) -> DataFrame:
    """``train_record, eval_record``: every pair of records that share a picture, once."""
    links = write_table(linked_texts(base, **options), "near")
    near = links.join(_members(base, links, 1, "train_id"), "train_id").join(_members(base, links, 0, "eval_id"), "eval_id")
    keyed = lambda side, name: base.filter((F.col("side") == side) & F.col("key").isNotNull()).select("key", F.col("record_id").alias(name))
    same = keyed(1, "train_record").join(keyed(0, "eval_record"), "key")
    pairs = near.select(F.col("record_1").alias("train_record"), F.col("record_0").alias("eval_record"))
    return pairs.unionByName(same.select("train_record", "eval_record")).distinct()


def found_pairs(pairs: DataFrame) -> DataFrame:
    a, b = F.col("train_record"), F.col("eval_record")
    return pairs.select(F.least(a, b).alias("record_a"), F.greatest(a, b).alias("record_b"))


def report(base: DataFrame, source: Column, **options: int) -> DataFrame:
    """``split, source, n_records, n_pairs``: evaluation records with a picture of the training side, and their pairs.

    A record's pairs are those by its key and those by its thumbnail without those by both: members are counted by
    key, by thumbnail and by both, and no pair of records is made.
    """
    links = write_table(linked_texts(base, **options), "near")
    first = base.filter("bytes IS NOT NULL").groupBy("side", "bytes").agg(F.min("record_id").alias("text_id"))
    once = base.withColumn("source", source).dropDuplicates(["record_id"]).select("record_id", "side", "split", "source", "key", "bytes")
    counted = once.join(first, ["side", "bytes"], "left").groupBy("side", "split", "source", "key", "text_id").agg(F.count(F.lit(1)).alias("n"))
    kinds = write_table(counted, "kinds")
    train, evaluation = kinds.filter("side = 1"), kinds.filter("side = 0")
    by_key = train.filter("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("by_key"))
    of_text = train.filter("text_id IS NOT NULL").groupBy(F.col("text_id").alias("train_id")).agg(F.sum("n").alias("m"))
    by_text = links.join(of_text, "train_id").groupBy(F.col("eval_id").alias("text_id")).agg(F.sum("m").alias("by_text"))
    of_both = train.filter("text_id IS NOT NULL AND key IS NOT NULL").groupBy(F.col("text_id").alias("train_id"), "key").agg(F.sum("n").alias("m"))
    asked = evaluation.filter("key IS NOT NULL AND text_id IS NOT NULL").select("key", F.col("text_id").alias("eval_id")).distinct()
    by_both = links.join(asked, "eval_id").join(of_both, ["train_id", "key"]).groupBy("key", F.col("eval_id").alias("text_id")).agg(F.sum("m").alias("by_both"))
    joined = evaluation.join(by_key, "key", "left").join(by_text, "text_id", "left").join(by_both, ["key", "text_id"], "left").na.fill(0, ["by_key", "by_text", "by_both"])
    pairs = F.col("by_key") + F.col("by_text") - F.col("by_both")
    return joined.withColumn("pairs", pairs).filter("pairs > 0").groupBy("split", "source").agg(F.sum("n").alias("n_records"), F.sum(F.col("n") * F.col("pairs")).alias("n_pairs"))
