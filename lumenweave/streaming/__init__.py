"""Structured Streaming twins of batch operators: an extension, as annotation corpora have no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, *keys: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling windows; rows later than the watermark are dropped by Spark."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    counted = timed.groupBy(F.window("_t", window), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), *keys, "n")


def running_votes(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """How often each answer of a key was given so far: the state of a majority vote."""
    return answers.groupBy(key, answer).agg(F.count(F.lit(1)).alias("n"))


def first_of_each(rows: DataFrame, key: str, time: str, *, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark: repeated rows of a record are dropped."""
    return rows.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark([key]).drop("_t")
