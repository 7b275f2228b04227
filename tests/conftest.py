from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


RECORD = "record_id long, split string, task string, image struct<path:string,bytes:binary>, caption string, qa_pairs array<struct<question:string,answer:string>>, region array<struct<bbox:array<float>,phrase:string>>, relation array<struct<subject_name:string,subject_bbox:array<float>,object_name:string,object_bbox:array<float>,predicate:string>>, chat array<struct<role:string,text:string>>, source string, metadata string"


@pytest.fixture
def records(spark):
    """Makes a table of records from dicts; what a dict lacks is null."""
    names = [f.split(" ")[0] for f in ("record_id", "split", "task", "image", "caption", "qa_pairs", "region", "relation", "chat", "source", "metadata")]

    def make(*rows: dict, extra: str = ""):
        schema = RECORD + extra
        more = [c.strip().split(" ")[0] for c in extra.split(",") if c.strip()]
        return spark.createDataFrame([tuple(r.get(n) for n in names + more) for r in rows], schema)

    return make
