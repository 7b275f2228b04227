"""Tables written to the shared checkpoint folder, to cut lineage.

A written Parquet table survives the loss of any executor, is columnar and
compressed, and lets Spark plan what follows from real sizes.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session may go without it; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="lumenweave-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder's owner clears it then
        pass


@atexit.register
def drop_written() -> None:
    """Delete every table that ``write_table`` made in this process."""
    for path, spark in list(_WRITTEN.items()):
        _delete(spark, path)
        _WRITTEN.pop(path, None)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is not taken; it is deleted when the process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def write_table(df: DataFrame, name: str, *, file_rows: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    ``file_rows``: rows that a file may have (0: any number), so that tasks that read the table are even in rows, too.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    """The named tables of a folder of Parquet tables."""
    return [spark.read.parquet(f"{folder}/{name}.parquet") for name in names]
