"""Encoding with a public byte-level BPE vocabulary through a pair occurrence index.

Within a partition the distinct pieces of all texts lie in one array of symbols
with links to their neighbours. An index maps every pair that has a merge to all
its positions. The active merges are applied in ascending rank, each to all its
positions at once; the pairs that a merge makes enter the index under their own
ranks, which are always higher. Texts are then put together from their pieces.

Defined cases: null and empty texts have no ids, an empty list; white space and
text that looks like a special token are encoded as ordinary text; long texts
are encoded whole; repeated and extra rows stay; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: How byte-level BPE splits text before merging. Fixed value of the vocabulary.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Python's \s also takes the separators 1c to 1f, which the vocabulary's splitter does not.
_PATTERN = PIECES.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
#: Characters of text that are encoded together, and distinct pieces kept before the store starts anew: bounds on memory only.
CHUNK_CHARS, KEPT_PIECES = 4_000_000, 1_000_000


def _printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: printable Latin-1 as itself, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + k)] = b
    return out


class PairVocabulary:
    """The merges of a vocabulary as sorted arrays; about 1 MB, of fixed size, so it can be sent to every task."""

    def __init__(self, file: str | Path) -> None:
        model = json.loads(Path(file).read_text(encoding="utf-8"))["model"]
        vocabulary, to_byte = model["vocab"], _printable_bytes()
        self.byte_ids = np.zeros(256, np.int64)
        for symbol, b in to_byte.items():
            self.byte_ids[b] = vocabulary[symbol]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        keys = (self.left << 20) | self.right
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, -1 without one."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], -1)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, ends)``: the ids of all pieces one after another, and where each piece's ids end."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        n, ends = len(ids), np.cumsum(lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[lengths > 0] - 1] = -1
        before[(ends - lengths)[lengths > 0]] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(positions: np.ndarray) -> None:
            rank = self.ranks(ids[positions], ids[after[positions]])
            positions, rank = positions[rank >= 0], rank[rank >= 0]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            positions, rank = positions[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, group in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(group)

        enter(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            groups = index.pop(r)
            at = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
            a, b = self.left[r], self.right[r]
            at = at[alive[at] & (ids[at] == a) & (after[at] >= 0)]
            at = at[ids[after[at]] == b]
            if a == b and len(at) > 1:  # in a run of the same symbol every other pair merges, from the left
                chained = np.concatenate([[False], at[1:] == after[at[:-1]]])
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            ids[at], alive[gone], after[at] = self.merged[r], False, beyond
            followed = beyond >= 0
            before[beyond[followed]] = at[followed]
            previous = before[at]
            enter(np.unique(np.concatenate([previous[previous >= 0], at[followed]])))
        kept = np.cumsum(alive)
        return ids[alive].astype(np.int32), np.where(ends > 0, kept[np.maximum(ends - 1, 0)], 0)


class _Numbered(dict):
    """Numbers pieces as they are first met."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class TextEncoder:
    """Encodes texts, keeping the ids of pieces already met."""

    def __init__(self, vocabulary: PairVocabulary) -> None:
        self.vocabulary = vocabulary
        self.split = regex.compile(_PATTERN).findall
        self._restart()

    def _restart(self) -> None:
        self.pieces, self.ids, self.starts = _Numbered(), np.empty(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)`` of the texts, as of a list array."""
        if len(self.pieces) > KEPT_PIECES:
            self._restart()
        known, number = len(self.pieces), self.pieces.__getitem__
        numbers = [np.fromiter(map(number, self.split(t)), np.int64) if t else np.empty(0, np.int64) for t in texts]
        new = list(self.pieces)[known:]
        if new:
            ids, ends = self.vocabulary.encode([p.encode() for p in new])
            self.starts = np.concatenate([self.starts, self.starts[-1] + ends])
            self.ids = np.concatenate([self.ids, ids])
        all_pieces = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
        sizes = self.starts[all_pieces + 1] - self.starts[all_pieces]
        ends = np.cumsum(sizes)
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
        ids = self.ids[np.repeat(self.starts[all_pieces], sizes) + within]
        piece_counts = np.cumsum([0, *map(len, numbers)])
        offsets = np.concatenate([[0], ends])[piece_counts]
        return ids, offsets


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    for batch in batches:
        texts, a, chars = batch.column(1).to_pylist(), 0, 0
        for b, text in enumerate(texts):
            chars += len(text or "")
            if chars > CHUNK_CHARS:
                yield batch.column(0).slice(a, b + 1 - a), texts[a : b + 1]
                a, chars = b + 1, 0
        if a < len(texts):
            yield batch.column(0).slice(a), texts[a:]


def spread(df: DataFrame) -> DataFrame:
    """Rows over at least as many tasks as there are cores; files cut into enough parts are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def encode_texts(df: DataFrame, id_column: str, text_column: str, vocabulary_file: str) -> DataFrame:
    """``id_column, ids``: the ids of every row's text, null and empty ones included."""
    vocabulary = df.sparkSession.sparkContext.broadcast(PairVocabulary(vocabulary_file))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(vocabulary.value)
        for keys, texts in _chunks(batches):
            ids, offsets = encoder(texts)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([keys, lists], names=[id_column, "ids"])

    kind = df.schema[id_column].dataType.simpleString()
    return spread(df.select(id_column, text_column)).mapInArrow(encode, f"`{id_column}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, id_column: str, text_column: str, vocabulary_file: str) -> DataFrame:
    """``id_column, n_tokens`` of every row's text; 0 for null and empty ones."""
    vocabulary = df.sparkSession.sparkContext.broadcast(PairVocabulary(vocabulary_file))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(vocabulary.value)
        for keys, texts in _chunks(batches):
            _, offsets = encoder(texts)
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(offsets).astype(np.int64))], names=[id_column, "n_tokens"])

    kind = df.schema[id_column].dataType.simpleString()
    return spread(df.select(id_column, text_column)).mapInArrow(count, f"`{id_column}` {kind}, n_tokens long")
