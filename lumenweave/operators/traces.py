"""Mouse traces: clamping, scaling and segmentation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp_scale(points: Column, width: Column, height: Column) -> Column:
    """Points with coordinates in [0, 1], clamped to it and scaled to pixels."""
    inside = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return F.transform(points, lambda p: F.struct((inside(p["x"]) * width).alias("x"), (inside(p["y"]) * height).alias("y"), p["t"].alias("t")))


def tumbling_segment(t: Column, window: float) -> Column:
    """The number of the fixed window that holds the time."""
    return F.floor(t / window)


def segment_starts(times: np.ndarray, window: float) -> tuple[list[int], int]:
    """``(first place of each segment, places used)`` of an ordered trace.

    A single point, or a trace that ends before the first window does, is one
    segment. Else windows are scanned one after another from the one after the
    first point's: a window takes the points up to its end, a segment always
    takes the point it starts with, and a point left when the scan ends alone
    at the end is dropped.
    """
    n = len(times)
    if n == 0:
        return [], 0
    if n == 1 or times[-1] < window:
        return [0], n
    starts, step = [0], int(times[0] // window) + 1
    late = times > step * window
    at = 1 + int(late[1:].argmax()) if late[1:].any() else n
    while at < n:
        starts.append(at)
        step += 1
        # The first place after the next window's end, looked for in stretches that double.
        at, width, end = at + 1, 16, step * window
        while at < n:
            late = times[at : at + width] > end
            if late.any():
                at += int(late.argmax())
                break
            at, width = at + width, width * 2
    used = n - 1 if starts[-1] == n - 1 else n
    return starts[:-1] if used < n else starts, used


def segment_times(times: list[float], window: float) -> list[list[int]]:
    """The places of each segment; see ``segment_starts``."""
    starts, used = segment_starts(np.asarray(times, float), window)
    return [list(range(a, b)) for a, b in zip(starts, [*starts[1:], used], strict=True)] if starts else []


def segment_trace(df: DataFrame, key: str, points: str, window: float) -> DataFrame:
    """``key, segment, place``: the segment of each point of an ordered array of points with a time ``t``.

    Arrow batches of whole traces go to Python; one trace is one row, so its size is that of its array.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("t")
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            valid, starts, counts, used = lists.is_valid().to_numpy(zero_copy_only=False), [], [], []
            for i in range(len(lists)):
                own, n = segment_starts(flat[offsets[i] : offsets[i + 1]], window) if valid[i] else ([], 0)
                starts += own
                counts.append(len(own))
                used.append(n if own else 0)
            counts, used, starts = np.array(counts, np.int64), np.array(used, np.int64), np.array(starts, np.int64)
            before = np.cumsum(used) - used  # points of the traces before each one
            new = np.zeros(int(used.sum()) + 1, np.int64)
            new[starts + np.repeat(before, counts)] = 1
            row = np.repeat(np.arange(len(lists)), used)
            segment = np.cumsum(new[:-1]) - 1 - np.repeat(np.cumsum(counts) - counts, used)
            if len(row):
                columns = [batch.column("k").take(pa.array(row)), pa.array(segment.astype(np.int32)), pa.array((np.arange(len(row)) - before[row]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "segment", "place"])

    times = df.select(F.col(key).alias("k"), F.transform(points, lambda p: p["t"].cast("double")).alias("t"))
    return times.mapInArrow(run, f"`{key}` {kind}, segment int, place int")


def middle_places(times: Column, window: float) -> Column:
    """For each trace of an array of arrays of times, the places of its segments' middle points, the later one of two."""

    @F.pandas_udf("array<array<int>>")
    def middles(batch: pd.Series) -> pd.Series:
        def one(trace: np.ndarray | None) -> list[int]:
            starts, used = segment_starts(np.asarray([] if trace is None else trace, float), window)
            return [a + (b - a) // 2 for a, b in zip(starts, [*starts[1:], used], strict=True)] if starts else []

        return pd.Series([None if traces is None else [one(t) for t in traces] for traces in batch])

    return middles(times)


def midpoint(segment: Column) -> Column:
    """The middle element of a segment, the later one of two."""
    return F.get(segment, F.floor(F.size(segment) / 2).cast("int"))
