"""The folder for written intermediates, which the driver and all executors must see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own in local mode, deleted at exit, and an error elsewhere."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not shared:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tilewright-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        shared = _own[0]
    return shared.rstrip("/")


def _folder(spark: SparkSession, path: str):
    """The Hadoop file system and path object of a folder, whatever store it is in."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def place(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, for files that go when the application ends."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    store, folder = _folder(spark, path)
    store.deleteOnExit(folder)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    The table goes when the application ends, or when it is discarded.
    """
    spark = df.sparkSession
    path = place(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing unfinished reads any more."""
    for table in tables:
        store, folder = _folder(table.sparkSession, table._scratch)
        store.delete(folder, True)
