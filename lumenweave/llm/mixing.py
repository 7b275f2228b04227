"""Mixtures of sources at target shares, with capped repetition.

Records are counted by membership pattern, the set of targets they may serve.
A min-cost flow routes each pattern's capacity to the targets' quotas: the r-th
use of a record costs r - 1, so the costs are convex and no record is used a
second time while an unused one could serve. The flow runs over patterns, never
over records; records are then selected by a seeded hash, exactly, by ranking
only the hash buckets in which a cut falls.

Defined cases: a target without records gets none and is reported with share 0;
records that serve no target, or whose size is null or not positive, are not
used; repeated rows of a record count once; targets whose share or cap is null
or not positive get nothing; empty tables give an empty mixture and a report of
zeros.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.operators.ranking import buckets_for, with_bucket
from lumenweave.storage import write_table

#: A pattern is a set of targets; more distinct ones than this can't be routed on the driver.
MAX_PATTERNS = 100_000


@dataclass
class Target:
    name: int
    share: float
    max_repeats: int


class _Flow:
    """Successive shortest paths with potentials over integer capacities and costs."""

    def __init__(self, nodes: int) -> None:
        self.graph: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int) -> int:
        k = len(self.to)
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.graph[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return k

    def run(self, source: int, sink: int) -> int:
        potential, total = [0] * len(self.graph), 0
        while True:
            best, by = {source: 0}, {}
            queue, done = [(0, source)], set()
            while queue:
                d, a = heapq.heappop(queue)
                if a in done:
                    continue
                done.add(a)
                for k in self.graph[a]:
                    b = self.to[k]
                    if self.room[k] and b not in done:
                        n = d + self.cost[k] + potential[a] - potential[b]
                        if n < best.get(b, math.inf):
                            best[b], by[b] = n, k
                            heapq.heappush(queue, (n, b))
            if sink not in by:
                return total
            far = best[sink]
            for a in range(len(potential)):
                potential[a] += min(best.get(a, far), far)
            path, a = [], sink
            while a != source:
                path.append(by[a])
                a = self.to[by[a] ^ 1]
            amount = min(self.room[k] for k in path)
            for k in path:
                self.room[k] -= amount
                self.room[k ^ 1] += amount
            total += amount


def route(patterns: dict[tuple[int, ...], int], targets: list[Target], quotas: dict[int, int]) -> dict[tuple[tuple[int, ...], int, int], int]:
    """``(pattern, repetition, target) -> amount``; amounts never exceed a pattern's capacity at any repetition."""
    caps = {t.name: t.max_repeats for t in targets}
    levels = {p: max((caps[t] for t in p), default=0) for p in patterns}
    nodes: dict[object, int] = {"source": 0, "sink": 1}
    for p in patterns:
        for r in range(levels[p]):
            nodes[(p, r)] = len(nodes)
    for t in targets:
        nodes[t.name] = len(nodes)
    flow, used = _Flow(len(nodes)), {}
    for p, size in patterns.items():
        for r in range(levels[p]):
            flow.edge(0, nodes[(p, r)], size, r)
            for t in p:
                if r < caps[t]:
                    used[(p, r, t)] = flow.edge(nodes[(p, r)], nodes[t], size, 0)
    for t in targets:
        flow.edge(nodes[t.name], 1, quotas.get(t.name, 0), 0)
    flow.run(0, 1)
    return {key: flow.room[k ^ 1] for key, k in used.items() if flow.room[k ^ 1]}


def feasible(patterns: dict[tuple[int, ...], int], targets: list[Target], total: int) -> bool:
    quotas = apportion(targets, total)
    return sum(route(patterns, targets, quotas).values()) == sum(quotas.values())


def apportion(targets: list[Target], total: int) -> dict[int, int]:
    """Whole quotas that add up to the total: largest remainders, ties to the earlier target."""
    whole = sum(t.share for t in targets)
    if whole <= 0:
        return {t.name: 0 for t in targets}
    exact = {t.name: total * t.share / whole for t in targets}
    out = {k: math.floor(v) for k, v in exact.items()}
    rest = total - sum(out.values())
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[:rest]:
        out[k] += 1
    return out


def largest_total(patterns: dict[tuple[int, ...], int], targets: list[Target]) -> int:
    """The largest mixture in which every target that has records reaches its share."""
    low, high = 0, sum(size * max((t.max_repeats for t in targets if t.name in p), default=0) for p, size in patterns.items())
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if feasible(patterns, targets, middle) else (low, middle - 1)
    return low


def mix(members: DataFrame, targets: DataFrame, *, total: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    ``members``: ``record_id``, ``pattern`` (sorted array of the target numbers it may serve) and ``size``
    (whole number, the unit in which shares are measured), one row for each record. ``targets``: ``target_no``,
    ``target_share``, ``max_repeats``, a fixed table. ``total``: size of the mixture; by default the largest at
    which every target with records reaches its share among these targets.

    Returns ``record_id, target_no, n_uses`` and ``target_no, target_share, actual_share, n_records, n_uses, size_used``.
    """
    spark = members.sparkSession
    wanted = [Target(r.target_no, r.target_share, r.max_repeats) for r in targets.collect() if (r.target_share or 0) > 0 and (r.max_repeats or 0) > 0]
    names = F.array(*[F.lit(t.name).cast("int") for t in wanted]).cast("array<int>")
    usable = members.withColumn("pattern", F.array_sort(F.array_intersect("pattern", names))).filter("size > 0 AND size(pattern) > 0")
    usable = write_table(usable.select("record_id", F.array_join("pattern", ",").alias("pattern"), F.col("size").cast("long").alias("size")), "mixture-members")
    counted = usable.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(counted) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} distinct sets of targets")
    sizes = {tuple(map(int, r.pattern.split(","))): int(r["size"]) for r in counted}
    rows = sum(r.n for r in counted)
    present = {t for p in sizes for t in p}
    reachable = [t for t in wanted if t.name in present]
    if total is None:
        total = largest_total(sizes, reachable) if reachable else 0
    flows = route(sizes, reachable, apportion(reachable, total))

    # At each repetition a pattern's records, in hash order, are dealt to its targets one after the other.
    dealt, start = [], {}
    for (p, r, t), amount in sorted(flows.items()):
        a = start.get((p, r), 0)
        dealt.append((",".join(map(str, p)), r, t, a, a + amount))
        start[(p, r)] = a + amount
    chosen = _select(usable, spark.createDataFrame(dealt, "pattern string, repetition int, target_no int, low long, high long"), rows, seed)
    report = (
        targets.select("target_no", "target_share")
        .join(chosen.groupBy("target_no").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_uses").alias("n_uses"), F.sum("size_used").alias("size_used")), "target_no", "left")
        .na.fill(0, ["n_records", "n_uses", "size_used"])
    )
    whole = F.sum("size_used").over(Window.partitionBy())  # one row for each target: a fixed table
    report = report.withColumn("actual_share", F.coalesce(F.try_divide("size_used", whole), F.lit(0.0)))
    return chosen.select("record_id", "target_no", "n_uses"), report


def _select(usable: DataFrame, dealt: DataFrame, rows: int, seed: int) -> DataFrame:
    """The records whose place, measured in size along the hash order of their pattern, lies in a dealt stretch.

    A record belongs to the stretch that holds its first unit. Only buckets that a boundary cuts are ordered.
    """
    spread = with_bucket(usable, "record_id", seed, buckets_for(rows))
    counts = spread.groupBy("pattern", "_bucket").agg(F.sum("size").alias("_size"))
    before = Window.partitionBy("pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    dealt = F.broadcast(dealt)  # one row for each pattern, repetition and target of the flow
    meets = (F.col("low") < F.col("_before") + F.col("_size")) & (F.col("high") > F.col("_before"))
    bucket_wise = places.join(dealt, "pattern").filter(meets)
    bucket_wise = bucket_wise.withColumn("_whole", (F.col("low") <= F.col("_before")) & (F.col("high") >= F.col("_before") + F.col("_size")))
    keys = ["pattern", "_bucket"]
    whole = spread.join(bucket_wise.filter("_whole").select(*keys, "target_no"), keys)
    inside = Window.partitionBy("pattern", "_bucket").orderBy("_hash", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    cut_keys = bucket_wise.filter("NOT _whole").select(*keys).distinct()
    placed = spread.join(cut_keys, keys, "left_semi").withColumn("_within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    cut = placed.join(bucket_wise.filter("NOT _whole").select(*keys, "target_no", "_before", "low", "high"), keys)
    place = F.col("_before") + F.col("_within")
    cut = cut.filter((place >= F.col("low")) & (place < F.col("high")))
    columns = ["record_id", "target_no", "size"]
    uses = whole.select(*columns).unionByName(cut.select(*columns))
    return uses.groupBy("record_id", "target_no").agg(F.count(F.lit(1)).alias("n_uses"), F.sum("size").alias("size_used"))


def spelled(name: Column) -> Column:
    """A source or task name in one spelling: trimmed, lower case, ``_`` for hyphens and white space."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[\s\p{Z}\-]+", "_")
