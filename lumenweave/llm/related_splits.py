"""Splits that keep related records together.

Records are linked through shared values (a picture, an author, ...). The graph
has the values as nodes; a record with several values is an edge between them,
so a hot value is one node, whatever its number of records. Each partition
reduces its edges to a local spanning forest by union-find; forests are merged
level by level, each level with fewer partitions of even numbers of edges, until
a partition would exceed ``max_forest`` edges, however large a component is. What
then still crosses partitions is finished by star contraction, in which every step
is a join or an aggregation; rows of hot nodes and groups stay where they are.

Groups go to the splits largest first, each to the split furthest below its
target. Groups of one size are alike, so the greedy runs over the histogram of
sizes, which has at most ``sqrt(2 n)`` entries, and the groups of each size are
dealt out by exact rank of a seeded hash.

Defined cases: null and blank values link nothing; a record without values is a
group of its own; repeated rows of a record count once; empty tables give empty
results; splits whose target is null or not positive get nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.operators.joins import hot_join, hot_keys
from lumenweave.operators.ranking import rank_in_group
from lumenweave.storage import write_table

_RECORDS_A_TASK = 1_000_000
_EDGE = pa.schema([("a", pa.string()), ("b", pa.string())])


class UnionFind:
    """Union by smaller name with path halving: a root is its tree's smallest node."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        parent = self.parent
        if x not in parent:
            parent[x] = x
            return x
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a < b:
            self.parent[b] = a
        elif b < a:
            self.parent[a] = b

    def stars(self) -> Iterator[tuple[str, str]]:
        """``(root, node)`` of every node that is no root."""
        for x in list(self.parent):
            r = self.find(x)
            if r != x:
                yield r, x


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.union(a, b)
    rows = list(forest.stars())
    for i in range(0, len(rows), 50_000):
        part = rows[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in part], pa.string()), pa.array([x for _, x in part], pa.string())], schema=_EDGE)


def _forests(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").mapInArrow(_local_forest, "a string, b string")


def components(edges: DataFrame, *, max_forest: int = 1_000_000, fan_in: int = 4, **hot: float) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; the root is the component's smallest node.

    ``max_forest``: edges that one task may hold.
    """
    forest = write_table(_forests(edges), "forest")
    n = forest.count()
    parts = max(1, forest.rdd.getNumPartitions())
    while parts > 1 and n > 0:
        fewer = max(-(-parts // fan_in), -(-n // max_forest))
        if fewer >= parts:
            break
        # Dealt evenly, not by root: no task gets a component as a whole.
        forest = write_table(_forests(forest.repartition(fewer)), "forest")
        n, parts = forest.count(), fewer
    if parts > 1 and n > 0:
        forest = _contract(forest, **hot)
    return forest.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(forest.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _least(both: DataFrame, rows: int, **hot: float) -> tuple[DataFrame, DataFrame]:
    """``a, m``: the smallest neighbour of each node; and the hot nodes."""
    counted = write_table(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    return counted.select("a", "m"), hot_keys(counted.select("a", "n"), "n", rows, **hot)


def _contract(edges: DataFrame, *, most_rounds: int = 60, **hot: float) -> DataFrame:
    """Alternating large-star and small-star steps until every component is a star around its smallest node."""
    edges = edges.filter("a <> b")
    rows = edges.count()
    for _ in range(most_rounds):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, hot_nodes = _least(both, 2 * rows, **hot)
        least = least.select("a", F.least("a", "m").alias("m"))
        large = hot_join(both.filter("b > a"), least, ["a"], hot_nodes).select(F.col("m").alias("a"), "b").distinct()
        down = write_table(large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "large-stars")
        least, hot_nodes = _least(down, rows, **hot)
        linked = hot_join(down, least, ["a"], hot_nodes).select("m", F.explode(F.array("a", "b")).alias("b"))
        small = write_table(linked.filter("m <> b").select(F.col("m").alias("a"), "b").distinct(), "stars")
        before, rows = rows, small.count()
        same = rows == before and small.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges = small
        if same:
            return edges
    raise RuntimeError("star contraction did not settle")


def group_records(linked: DataFrame, **hot: float) -> DataFrame:
    """``linked`` with ``root`` in place of ``values``: the component of every record; ``r:<id>`` where no value links it.

    ``linked`` has one row for each record: ``record_id``, its distinct ``values`` as an array of texts, each with a prefix that
    tells its kind, and any other columns. ``hot``: see ``hot_keys``.
    """
    first = F.get("values", F.lit(0))
    rows = linked.count()
    # A task's forest is held in memory: it gets a bounded number of records.
    parts = -(-rows // _RECORDS_A_TASK)
    spread = linked if linked.rdd.getNumPartitions() >= parts else linked.repartition(parts)
    several = spread.filter(F.size("values") > 1).select(first.alias("a"), F.explode("values").alias("b")).filter("a <> b")
    of_value = components(several, **hot)
    rest = [c for c in linked.columns if c != "values"]
    own = linked.select(*rest, first.alias("node"))
    with_node = own.filter("node IS NOT NULL")
    hot_nodes = hot_keys(with_node.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "n", rows, **hot)
    # Only values that meet another value have a component of their own; the rest are their own root.
    joined = hot_join(with_node, of_value, ["node"], hot_nodes, "left").select(*rest, F.coalesce("root", "node").alias("root"))
    alone = own.filter("node IS NULL").select(*rest, F.concat(F.lit("r:"), F.col("record_id").cast("string")).alias("root"))
    return joined.unionByName(alone)


def greedy_quotas(sizes: list[tuple[int, int]], targets: list[tuple[str, float]]) -> dict[int, list[tuple[str, int]]]:
    """How many groups of each size every split takes: ``size -> [(split, groups), ...]``.

    Sizes go from the largest; each group goes to the split furthest below its target, ties to the earlier split.
    Groups of one size are dealt at once, with the same result as one by one.
    """
    total = sum(s * n for s, n in sizes)
    whole = sum(t for _, t in targets)
    gap = {name: total * t / whole for name, t in targets}
    order = {name: i for i, (name, _) in enumerate(targets)}
    out: dict[int, list[tuple[str, int]]] = {}
    for size, n in sorted(sizes, reverse=True):
        took = dict.fromkeys(gap, 0)
        # Each split offers its gap, and what is left of it after each group; the n largest offers are taken.
        # All offers above a level come first, at once; the few that are left are taken one by one.
        low, high = min(gap.values()) - size * n, max(gap.values())
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(max(0, int((g - middle) // size)) for g in gap.values()) >= n else (low, middle)
        for name, g in gap.items():
            k = max(0, int((g - high) // size))
            took[name] = k
        n -= sum(took.values())
        for name, k in took.items():
            gap[name] -= k * size
        for _ in range(n):
            name = min(gap, key=lambda x: (-gap[x], order[x]))
            gap[name] -= size
            took[name] += 1
        out[size] = [(name, k) for name, k in took.items() if k]
    return out


def assign_splits(grouped: DataFrame, targets: DataFrame, *, seed: int = 29, **hot: float) -> DataFrame:
    """``record_id, root, new_split``; ``grouped`` is ``group_records``, ``targets`` the fixed table ``split, target_share``."""
    spark = grouped.sparkSession
    wanted = [(r.split, float(r.target_share)) for r in targets.collect() if r.split is not None and (r.target_share or 0) > 0]
    sizes = write_table(grouped.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "group-sizes")
    histogram = [(r["size"], r.n) for r in sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()]
    if not histogram or not wanted:
        return grouped.withColumn("new_split", F.lit(None).cast("string"))
    runs = []
    for size, taken in greedy_quotas(histogram, wanted).items():
        start = 0
        for name, k in taken:
            runs.append((size, start, start + k, name))
            start += k
    table = F.broadcast(spark.createDataFrame(runs, "size long, low long, high long, new_split string"))  # sizes times splits
    ranked = rank_in_group(sizes, ["size"], "root", seed=seed, rows=sum(n for _, n in histogram))
    placed = write_table(ranked.join(table, "size").filter("rank >= low AND rank < high").select("root", "new_split"), "placed")
    hot_roots = hot_keys(sizes.select("root", "size"), "size", sum(s * n for s, n in histogram), **hot)
    return hot_join(grouped, placed, ["root"], hot_roots)


def named_groups(grouped: DataFrame, **hot: float) -> DataFrame:
    """``record_id, group_id`` of the records in groups of two or more; ``grouped`` has ``record_id, root, name``.

    ``group_id`` is the group's smallest name, null if none of its records has one.
    """
    named = write_table(grouped.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("group_id")).filter("n > 1"), "named-groups")
    hot_roots = hot_keys(named.select("root", "n"), "n", grouped.count(), **hot)
    return hot_join(grouped.select("record_id", "root"), named.drop("n"), ["root"], hot_roots).select("record_id", "group_id")


def shares(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """``split, target_share, n_records, n_groups, actual_share`` of every target."""
    counted = assigned.groupBy(F.col("new_split").alias("split")).agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("root").alias("n_groups"))
    joined = targets.select("split", "target_share").join(counted, "split", "left").na.fill(0, ["n_records", "n_groups"])
    whole = F.sum("n_records").over(Window.partitionBy())  # one row for each split: a fixed table
    return joined.withColumn("actual_share", F.coalesce(F.try_divide("n_records", whole), F.lit(0.0)))
