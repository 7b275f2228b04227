"""Every query of the subpackage runs on the smallest tables and gives what the data promise."""

from __future__ import annotations

import pytest

from lumenweave.llm import queries

from ..conftest import SMALL

COLUMNS = {
    "p2_found": {"kept_id": "bigint", "copy_id": "bigint"},
    "p3_found": {"record_a": "bigint", "record_b": "bigint"},
    "p5_found": {"record_id": "bigint", "group_id": "string"},
    "p6_found": {"record_id": "bigint", "field_name": "string", "pos": "bigint", "defect": "string"},
    "p7_ids": {"doc_id": "bigint", "ids": "array<int>"},
    "p9_found": {"doc_id": "bigint", "kind": "string"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    n = df.count()
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
        if name != "p7_ids":
            assert df.distinct().count() == n


def test_mixture_report(spark):
    rows = queries.p1_shares(spark, SMALL).collect()
    reached = [r for r in rows if r.n_records]
    whole = sum(r.target_share for r in reached)
    assert sum(r.actual_share for r in rows) == pytest.approx(1)
    n = sum(r.n_uses for r in rows)
    assert all(abs(r.actual_share - r.target_share / whole) <= 1.5 / n for r in reached)


def test_splits(spark):
    rows = queries.p5_splits(spark, SMALL)
    assert rows.select("record_id").distinct().count() == rows.count() == spark.read.parquet(f"{SMALL}/records.parquet").select("record_id").distinct().count()
    assert rows.select("group_key", "new_split").distinct().count() == rows.select("group_key").distinct().count()
