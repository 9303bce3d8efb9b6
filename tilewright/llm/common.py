"""Shared plumbing of the text operators: inputs, scratch tables and session settings."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.graph import components
from tilewright.sources.scratch import discard, written

__all__ = ["components", "crc_mod", "discard", "prepare", "ranked", "sha256_hex", "shuffle_width", "table", "text_of", "unused", "written"]


def prepare(spark: SparkSession) -> None:
    """Bound what one Arrow batch may carry, so that very long texts do not pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(column), F.lit("")).alias("text")


def crc_mod(column: str, modulus: int) -> Column:
    """Remainder of the CRC-32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def ranked(keys: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct ``keys`` with numbers that rise in the order of ``columns``: sorted ranges, numbered where they lie."""
    return keys.select(*columns).repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("rank", F.monotonically_increasing_id())


def unused(taken: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that no caller's column has."""
    out = []
    for name in names:
        while (name := f"__{name}") in taken:
            pass
        out.append(name)
    return out
