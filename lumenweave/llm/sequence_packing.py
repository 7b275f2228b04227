"""Texts of varying length packed into sequences of fixed capacity.

Pattern packing by non-negative least squares. The lengths are counted on a grid of
at most ``GRID`` steps; how often each pattern of up to ``MOST_LENGTHS`` lengths that
fill a sequence is used is fitted to the counts by non-negative least squares and
rounded down. Patterns are not listed: the one that improves the fit most is found
among all of them by a table of best sums. What is left over goes, longest first,
into the sequence with the least sufficient room. All of this works on counts by
length, so its size depends on the capacity alone. Texts then take the places of
their length in the order of a seeded hash, by exact rank.

A text longer than the capacity fills whole sequences; only its rest is packed.

Defined cases: a text without tokens lies in no sequence and comes out with a
null ``sequence_id``; null, zero and negative capacities give no sequences; two
stages are packed apart; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.operators.ranking import rank_in_group

GRID, MOST_LENGTHS = 256, 8
#: Capacities above this would need larger tables of counts than a driver should hold.
MOST_CAPACITY = 4_000_000


def best_pattern(gain: np.ndarray, steps: int, most: int = MOST_LENGTHS) -> tuple[float, tuple[int, ...]]:
    """The pattern of up to ``most`` lengths that add up to ``steps`` with the largest sum of gains, and that sum.

    ``gain`` has a place for each length from 0; lengths that can't be used have minus infinity.
    """
    total, length = np.arange(steps + 1)[:, None], np.arange(1, steps + 1)[None, :]
    before = np.where(total >= length, total - length, steps + 1)
    value = np.full(steps + 2, -np.inf)
    value[0] = 0.0
    choices, best, at = [], -np.inf, 0
    for j in range(most):
        sums = value[before] + gain[None, 1:]
        choice = sums.argmax(1)
        choices.append(choice)
        value = np.append(sums[np.arange(steps + 1), choice], -np.inf)
        if value[steps] > best:
            best, at = float(value[steps]), j
    pattern, rest = [], steps
    for j in range(at, -1, -1) if best > -np.inf else ():
        pattern.append(int(choices[j][rest]) + 1)
        rest -= pattern[-1]
    return best, tuple(sorted(pattern, reverse=True))


def fit_patterns(totals: np.ndarray, most: int = MOST_LENGTHS) -> dict[tuple[int, ...], float]:
    """How often each pattern is used: non-negative least squares of the counts of each length, by active sets.

    All patterns take part: the one with the steepest gradient enters, until none improves the fit.
    """
    steps = len(totals) - 1
    usable = totals > 0
    patterns: list[tuple[int, ...]] = []
    columns, x = np.zeros((steps + 1, 0)), np.zeros(0)
    left, last = totals.astype(float), np.inf
    tolerance = 0.05  # of an item; repeats are rounded down to whole ones
    while (left**2).sum() < last * (1 - 1e-12):
        last = (left**2).sum()
        gain, pattern = best_pattern(np.where(usable, left, -np.inf), steps, most)
        if gain <= tolerance or pattern in patterns:
            break
        patterns.append(pattern)
        columns = np.hstack([columns, np.bincount(pattern, minlength=steps + 1)[:, None]])
        x = np.append(x, 0.0)
        while True:
            gram = columns.T @ columns
            try:
                s = np.linalg.solve(gram, columns.T @ totals)
            except np.linalg.LinAlgError:
                s = np.linalg.lstsq(columns, totals, rcond=None)[0]
            if not len(s) or s.min() > 0:
                x = s
                break
            bad = s <= 0
            x = x + (x[bad] / np.maximum(x[bad] - s[bad], 1e-300)).min() * (s - x)
            kept = x > 1e-12
            patterns, columns, x = [p for p, k in zip(patterns, kept, strict=True) if k], columns[:, kept], x[kept]
        left = totals - columns @ x
    return dict(zip(patterns, x.tolist(), strict=True))


@dataclass
class Container:
    """``count`` sequences that hold the same lengths."""

    lengths: tuple[int, ...]
    count: int


def _take(stock: dict[int, list[list[int]]], step: int, n: int) -> list[list[int]]:
    """``n`` items of a grid step as runs of one length, the longest first."""
    runs, out = stock[step], []
    while n:
        length, left = runs[-1]
        k = min(n, left)
        out.append([length, k])
        n -= k
        if k == left:
            runs.pop()
        else:
            runs[-1][1] -= k
    return out


def pack_counts(counts: dict[int, int], capacity: int, *, grid: int = GRID) -> list[Container]:
    """Sequences for ``counts`` items of each length from 1 to the capacity."""
    width = -(-capacity // grid)
    steps = capacity // width
    at = lambda length: -(-length // width)  # noqa: E731 - rounded up, so what fits the grid fits the capacity
    stock: dict[int, list[list[int]]] = defaultdict(list)
    totals = np.zeros(steps + 1)
    for length in sorted(counts):
        if counts[length] and at(length) <= steps:
            stock[at(length)].append([length, counts[length]])
            totals[at(length)] += counts[length]
    left = Counter({k: n for k, n in counts.items() if n})
    filled: list[Container] = []
    _reserve(stock, totals, sum((at(k) * width - k) * n for k, n in counts.items()))
    for p, repeats in sorted(fit_patterns(totals).items(), key=lambda x: (-x[1], x[0])):
        free = Counter(p)
        n = min([int(repeats + 1e-6), *[int(totals[s]) // k for s, k in free.items()]])
        if n <= 0:
            continue
        slots = []
        for s in p:
            totals[s] -= n
            slots.append(_take(stock, s, n))
        filled += _zip_runs(slots)
    for c in filled:
        for length in c.lengths:
            left[length] -= c.count
    return _best_fit(filled, {k: n for k, n in left.items() if n}, capacity)


def _reserve(stock: dict[int, list[list[int]]], totals: np.ndarray, free: int) -> None:
    """Keeps the shortest items for the room that rounding up to the grid leaves: as many of their tokens as ``free``."""
    for step in np.flatnonzero(totals):
        held = sum(length * n for length, n in stock[step])
        if held > free:
            break
        free -= held
        stock[step].clear()
        totals[step] = 0


def _zip_runs(slots: list[list[list[int]]]) -> list[Container]:
    out, at = [], [0] * len(slots)
    slots = [[run[:] for run in s] for s in slots]
    while at[0] < len(slots[0]):
        heads = [s[i] for s, i in zip(slots, at, strict=True)]
        n = min(h[1] for h in heads)
        out.append(Container(tuple(h[0] for h in heads), n))
        for k, h in enumerate(heads):
            h[1] -= n
            at[k] += h[1] == 0
    return out


def _best_fit(filled: list[Container], left: dict[int, int], capacity: int) -> list[Container]:
    """Items that are left, longest first, each into the sequence with the least sufficient room."""
    room: dict[int, list[Container]] = defaultdict(list)
    done: list[Container] = []

    def put(c: Container) -> None:
        free = capacity - sum(c.lengths)
        (room[free] if free else done).append(c)

    for c in filled:
        put(c)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            fits = min((s for s, cs in room.items() if s >= length and cs), default=None)
            if fits is None:
                k = min(capacity // length, n)
                put(Container((length,) * k, n // k))
                n -= n // k * k
                continue
            c = room[fits].pop()
            k = min(n, c.count)
            put(Container((*c.lengths, length), k))
            if c.count > k:
                room[fits].append(Container(c.lengths, c.count - k))
            n -= k
    return [*done, *[c for cs in room.values() for c in cs]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing needs fewer sequences than this."""
    return -(-sum(k * n for k, n in counts.items()) // capacity)


def _places(packed: list[Container]) -> tuple[dict[int, list[tuple[int, int, int]]], list[int]]:
    """For each length, ``(items before, container, offset in it)`` of its runs of places; and each container's first sequence."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    before: Counter[int] = Counter()
    first, total = [], 0
    for k, c in enumerate(packed):
        first.append(total)
        total += c.count
        offset = 0
        for length in c.lengths:
            runs[length].append((before[length], k, offset))
            before[length] += c.count
            offset += length
    return runs, first


_PLACED = "stage_no int, doc_id long, piece int, start long, n_tokens long, sequence_no long, offset long"


def pack(sizes: DataFrame, budgets: DataFrame, *, seed: int = 41) -> DataFrame:
    """``stage_name, sequence_id, doc_id, piece, start, n_tokens, offset``: which tokens of which text lie where.

    ``sizes``: ``doc_id, n_tokens``, one row for each text, cheap to read several times. ``budgets``: the fixed table
    ``stage_name, capacity_tokens``. ``start`` counts tokens in the text, ``offset`` in the sequence.
    """
    spark = sizes.sparkSession
    stages = [(k, r.stage_name, int(r.capacity_tokens)) for k, r in enumerate(budgets.collect()) if r.capacity_tokens and r.capacity_tokens > 0]
    if any(c > MOST_CAPACITY for _, _, c in stages):
        raise ValueError(f"a capacity is above {MOST_CAPACITY}")
    one = [F.struct(F.lit(k).alias("stage_no"), F.lit(name).alias("stage_name"), F.lit(c).cast("long").alias("capacity")) for k, name, c in stages]
    of_stages = F.array(*one) if one else F.array().cast("array<struct<stage_no:int,stage_name:string,capacity:bigint>>")
    by_stage = sizes.select("doc_id", "n_tokens", F.inline(of_stages))
    whole = F.expr("n_tokens div capacity")
    rest = by_stage.filter("n_tokens % capacity > 0").select("stage_no", "doc_id", whole.cast("int").alias("piece"), (whole * F.col("capacity")).alias("start"), (F.col("n_tokens") % F.col("capacity")).alias("n_tokens"))
    counted = rest.groupBy("stage_no", "n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each length
    tables: dict[int, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    firsts: dict[int, np.ndarray] = {}
    n_rest = 0
    for k, _, capacity in stages:
        counts = {int(r.n_tokens): int(r.n) for r in counted if r.stage_no == k}
        n_rest += sum(counts.values())
        runs, first = _places(pack_counts(counts, capacity))
        tables[k] = {length: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for length, r in runs.items()}
        firsts[k] = np.array(first, np.int64)
    sent = spark.sparkContext.broadcast((tables, firsts))  # bounded by the capacities

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, firsts = sent.value
        for batch in batches:
            stage, length, rank = (batch.column(c).to_numpy() for c in ("stage_no", "n_tokens", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.lexsort((length, stage))
            cuts = np.flatnonzero((np.diff(stage[order]) != 0) | (np.diff(length[order]) != 0)) + 1
            for rows in np.split(order, cuts):
                if len(rows):
                    before, container, at = tables[int(stage[rows[0]])][int(length[rows[0]])]
                    run = np.searchsorted(before, rank[rows], side="right") - 1
                    sequence[rows] = firsts[int(stage[rows[0]])][container[run]] + rank[rows] - before[run]
                    offset[rows] = at[run]
            columns = [batch.column(c) for c in ("stage_no", "doc_id", "piece", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=["stage_no", "doc_id", "piece", "start", "n_tokens", "sequence_no", "offset"])

    ranked = rank_in_group(rest, ["stage_no", "n_tokens"], "doc_id", seed=seed, rows=n_rest)
    placed = ranked.select("stage_no", "doc_id", "piece", "start", "n_tokens", "rank").mapInArrow(place, _PLACED)
    names = F.array(*[F.lit(name) for _, name, _ in stages]).cast("array<string>")
    numbers = F.array(*[F.lit(k) for k, _, _ in stages]).cast("array<int>")
    stage_name = F.get(names, F.array_position(numbers, F.col("stage_no")).cast("int") - 1).alias("stage_name")
    packed = placed.select(stage_name, F.concat(F.lit("s"), F.col("sequence_no").cast("string")).alias("sequence_id"), "doc_id", "piece", "start", "n_tokens", "offset")
    full = by_stage.filter("n_tokens >= capacity").select("stage_name", "doc_id", "capacity", F.explode(F.sequence(F.lit(1), whole.cast("int"))).alias("k"))
    full = full.select(
        "stage_name", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("-"), (F.col("k") - 1).cast("string")).alias("sequence_id"), "doc_id",
        (F.col("k") - 1).alias("piece"), ((F.col("k") - 1) * F.col("capacity")).alias("start"), F.col("capacity").alias("n_tokens"), F.lit(0).cast("long").alias("offset"),
    )
    nowhere = by_stage.filter("n_tokens = 0").select("stage_name", F.lit(None).cast("string").alias("sequence_id"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), "n_tokens", F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full).unionByName(nowhere)


def report(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """``stage_name, capacity_tokens, n_sequences, n_tokens, used_share`` of every stage."""
    in_sequences = packed.filter("sequence_id IS NOT NULL")
    each = in_sequences.groupBy("stage_name", "sequence_id").agg(F.sum("n_tokens").alias("n_tokens"))
    total = each.groupBy("stage_name").agg(F.count(F.lit(1)).alias("n_sequences"), F.sum("n_tokens").alias("n_tokens"))
    joined = budgets.select("stage_name", "capacity_tokens").join(total, "stage_name", "left").na.fill(0, ["n_sequences", "n_tokens"])
    return joined.withColumn("used_share", F.try_divide("n_tokens", F.col("n_sequences") * F.col("capacity_tokens")))
