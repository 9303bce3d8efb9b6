"""Run metadata as JSON lines under a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilewright.schemas import TASK


def write_metadata(runs: DataFrame, path: str) -> None:
    """Append TASK rows; other columns are left out."""
    runs.select(*[f.name for f in TASK.fields]).write.mode("append").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Rows that do not parse come back as nulls instead of ending the job."""
    return spark.read.schema(TASK).option("mode", "PERMISSIVE").json(path)
