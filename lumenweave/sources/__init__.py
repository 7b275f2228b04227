"""Readers and writers of annotation corpora. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_document(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Whole JSON documents: a top-level array gives a row for each element, an object one row."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_array(spark: SparkSession, path: str | list[str], root: str, element: str) -> DataFrame:
    """The elements of the array under ``root``, with their place ``pos``. ``element`` is the element's DDL type."""
    rows = read_json_document(spark, path, f"`{root}` array<{element}>")
    return rows.select(F.posexplode(root)).select(F.col("pos").cast("long").alias("pos"), "col.*")


def read_json_map(spark: SparkSession, path: str | list[str], value: str, key: str = "key") -> DataFrame:
    """A JSON object of records as rows: the field name becomes the column ``key``.

    The document is read as text; its parse gives a map, so no field names need to be known.
    """
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias(key, "_v")).select(key, "_v.*")


def read_json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """One object a line; several files or shards at once."""
    return spark.read.schema(schema).json(path)


def read_parquet(spark: SparkSession, path: str | list[str], *, status: str | None = None, ignore_corrupt: bool = False, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet files; ``status`` keeps rows of that status, pushed into the scan; corrupt files can be skipped.

    Where the first file may be corrupt, the schema must be given.
    """
    reader = spark.read.option("ignoreCorruptFiles", ignore_corrupt)
    reader = reader.schema(schema) if schema is not None else reader
    df = reader.parquet(*([path] if isinstance(path, str) else path))
    return df.filter(F.col("status") == status) if status is not None else df


def read_lines(spark: SparkSession, path: str | list[str], name: str = "line") -> DataFrame:
    """Stripped lines of text files, sorted; empty ones go. A join with them drops the sort."""
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    return spark.read.text(path).select(line.alias(name)).filter(F.col(name) != "").orderBy(name)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def list_files(spark: SparkSession, folder: str, pattern: str = "*", *, recursive: bool = False) -> DataFrame:
    """``path, stem, length, shard`` of the files; their contents are not read. ``shard`` is the file's directory."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder)
    return files.select("path", file_stem(F.col("path")).alias("stem"), "length", F.element_at(F.split("path", "/"), -2).alias("shard"))


def read_with_sidecars(spark: SparkSession, folder: str, schema: T.StructType | str, pattern: str = "*.jpg", *, recursive: bool = False) -> DataFrame:
    """Each picture that has a JSON file of the same stem in the same directory, with that file's fields."""
    without = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    pictures = list_files(spark, folder, pattern, recursive=recursive).withColumn("_key", without(F.col("path")))
    reader = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", recursive)
    notes = reader.json(folder).withColumn("_key", without(F.col("_metadata.file_path")))
    return pictures.join(notes, "_key").drop("_key")


def read_pictures(spark: SparkSession, folder: str, *, recursive: bool = False) -> DataFrame:
    """``path, width, height, channels, pixels`` of pictures that decode; others are dropped."""
    pictures = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", recursive).load(folder)
    return pictures.select("image.origin", "image.width", "image.height", "image.nChannels", "image.data").toDF("path", "width", "height", "channels", "pixels")


def dominant_color_share(pixels: Column, channels: int) -> Column:
    """The share of the most frequent colour of one picture's bytes."""
    n = (F.length(pixels) / channels).cast("int")
    places = F.sequence(F.lit(0), n - 1)
    colors = F.transform(places, lambda i: F.hex(pixels.substr(i * channels + 1, F.lit(channels))))
    ordered = F.array_sort(colors)
    start = F.struct(F.lit("").alias("c"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(a: Column, c: Column) -> Column:
        run = F.when(a["c"] == c, a["n"] + 1).otherwise(1)
        return F.struct(c.alias("c"), run.alias("n"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(ordered, start, step)["best"] / n


def keep_picture(width: Column, height: Column, share: Column, *, least_side: int = 32, most_share: float = 0.85) -> Column:
    """Quality of a decoded picture: its smaller side above the limit and no colour too dominant; null counts as failing."""
    return F.coalesce((F.least(width, height) > least_side) & (share <= most_share), F.lit(False))


def write_records(df: DataFrame, path: str, *, partitions: tuple[str, ...] = ("source", "split"), rows_per_file: int = 10_000, mode: str = "errorifexists") -> None:
    """Parquet, partitioned, with a bounded number of rows in each file."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy(*partitions).parquet(path)


def write_once(df: DataFrame, path: str, *, partitions: tuple[str, ...] = ()) -> None:
    """Written unless it is there already."""
    df.write.mode("ignore").partitionBy(*partitions).parquet(path)


def write_json(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """JSON lines, nulls included."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_submission(df: DataFrame, path: str, question: str, answer: str, *, names: tuple[str, str] = ("question_id", "answer"), mode: str = "errorifexists") -> None:
    write_json(df.select(F.col(question).alias(names[0]), F.col(answer).alias(names[1])), path, mode=mode)


def write_evaluation(predictions: DataFrame, truth: DataFrame, metrics: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Predictions, ground truth and metrics side by side."""
    for name, df in (("predictions", predictions), ("groundtruth", truth), ("metrics", metrics)):
        write_json(df, f"{path}/{name}", mode=mode)


def manifest(selected: DataFrame, listing: DataFrame, key: str = "stem") -> DataFrame:
    """The files whose key is selected: what is to be copied."""
    return listing.join(selected.select(key).distinct(), key, "left_semi")
