"""Every query with SQL gives the SQL's rows on the smallest tables; every other one runs."""

from __future__ import annotations

import glob
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

from .conftest import SMALL


def core(name: str) -> bool:
    return not (name[0] == "p" and name[1].isdigit()) or name.startswith("p4_")


NAMES = sorted(n for n in entry.queries() if core(n))


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, database, name):
    got = entry.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(x) for x in r) for r in got.select(*columns).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    wanted = database.execute(sql)
    names = [d[0] for d in wanted.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in wanted.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
