"""Streams over the driver's tables, run to their end and read back as tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.config import BlendConfig
from tilewright.sources import scratch
from tilewright.streaming import micro, strips

QUERIES: dict = {}
ORACLES: dict = {}


def _shared(spark: SparkSession) -> str:
    """A folder that all executors see."""
    return f"{scratch.scratch_dir(spark)}/stream-{uuid.uuid4().hex}"


def _drained(stream: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """All that is there, through a parquet (append) or batch-wise (update) sink, as a table."""
    place = _shared(spark)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{place}/checkpoint")
    if mode == "append":
        query = writer.format("parquet").option("path", f"{place}/out").outputMode("append").start()
    else:
        query = writer.outputMode("update").foreachBatch(lambda df, epoch: df.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{place}/out")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{place}/out")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern, as a stream's plain path must be a folder and the table may be one file
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")


def stream_microbatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 x 2 tiles drawn from events through the default model, at most 8 a call: per event, the output's size and sum."""
    value = F.lpad(F.hex((F.col("event_id") % 256).cast("long")), 2, "0")
    tiles = _events(spark, sf_dir).select("event_id", F.unhex(F.repeat(value, F.lit(12))).alias("data"), F.lit(2).alias("h"), F.lit(2).alias("w"))
    out = _drained(micro.infer(tiles, micro.upsample()), spark, "append")
    return out.select("event_id", "h", "w", F.length("data").cast("long").alias("bytes"), F.conv(F.hex(F.substring("data", 1, 1)), 16, 10).cast("int").alias("first"))


def stream_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted blend by user as a stateful stream; each key's last state is the batch result."""
    k = (F.col("event_id") % 97).cast("double")
    contributions = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.col("value").alias("v"), F.exp(-(k * k) / 800.0).alias("w"))
    out = _with_rocksdb(spark, lambda: _drained(strips.stream_sums(contributions), spark, "update"))
    last = out.groupBy("key").agg(F.max_by(F.struct("total", "mass", "n"), F.struct("epoch", "n")).alias("s"))
    mean = F.col("s.total") / F.greatest(F.col("s.mass"), F.lit(BlendConfig().weight_floor))
    return last.select("key", F.least(F.greatest(mean, F.lit(0.0)), F.lit(255.0)).cast("int").alias("pixel"), F.round("s.mass", 6).alias("weight"), F.col("s.n").alias("n"))


def stream_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 tiles of one colour drawn from events, 64 a slide, blended as they come: the blocks whose tiles have all come, with a digest of their pixels.

    The kernel is flat here (1 inside a tile, 0 on its rim), so that sums are exact; those of the last slide that still wait for tiles stay in the stream.
    Times begin a day after 1970, as a stream's first watermark is its first second.
    """
    i = F.col("event_id")
    # a table of few bytes is one task's, whatever its tiles cost
    events = _events(spark, sf_dir).select("event_id").repartition(3 * spark.sparkContext.defaultParallelism, F.floor(i / 64))
    pixel = F.lpad(F.hex((i * 37 % 256).cast("long")), 2, "0")
    tiles = events.select(
        F.concat(F.lit("slide_"), F.floor(i / 64)).alias("slide"), F.floor(i % 64 / 8).cast("int").alias("row"), (i % 8).cast("int").alias("col"), F.unhex(F.repeat(pixel, F.lit(192))).alias("data"),
        F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(8).alias("total_rows"), F.lit(8).alias("total_cols"), F.timestamp_seconds(i + 86400).alias("at"),
    )
    out = _with_rocksdb(spark, lambda: _drained(strips.stream_blocks(tiles, 18, 8, 4, 1, 1e9), spark, "append"))
    return out.filter("status = 'whole'").select("slide", "block_row", "block_col", "n_tiles", F.md5(F.lower(F.hex("data"))).alias("pixels"))


def _with_rocksdb(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """Run with the state store that composite states need, then put the session's own back."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run()
    finally:
        spark.conf.set(provider, before)


QUERIES["stream_microbatch"] = stream_microbatch
ORACLES["stream_microbatch"] = "SELECT event_id, 8 AS h, 8 AS w, 192::BIGINT AS bytes, CAST(event_id % 256 AS INTEGER) AS first FROM events"
QUERIES["stream_blend"] = stream_blend
ORACLES["stream_blend"] = """WITH c AS (SELECT CAST(user_id AS VARCHAR) AS key, value AS v, exp(-(CAST(event_id % 97 AS DOUBLE) * CAST(event_id % 97 AS DOUBLE)) / 800.0::DOUBLE) AS w FROM events)
SELECT key, CAST(trunc(least(greatest(sum(v * w) / greatest(sum(w), 1e-8::DOUBLE), 0.0::DOUBLE), 255.0::DOUBLE)) AS INTEGER) AS pixel, round(sum(w), 6) AS weight, count(*) AS n FROM c GROUP BY key"""
QUERIES["stream_blocks"] = stream_blocks
ORACLES["stream_blocks"] = """WITH t AS (SELECT event_id // 64 AS s, event_id % 64 // 8 AS row, event_id % 8 AS col, event_id * 37 % 256 AS v FROM events),
b AS (SELECT s, r.i AS br, c.i AS bc, count(*) AS n FROM t, LATERAL unnest(range(2)) r(i), LATERAL unnest(range(2)) c(i) WHERE row BETWEEN 3 * r.i AND 3 * r.i + 4 AND col BETWEEN 3 * c.i AND 3 * c.i + 4 GROUP BY ALL HAVING count(*) = 25),
px AS (SELECT s, row * 4 + 1 + y.i AS y, col * 4 + 1 + x.i AS x, CAST(trunc(sum(v) / count(*)) AS BIGINT) AS p FROM t, LATERAL unnest(range(6)) y(i), LATERAL unnest(range(6)) x(i) GROUP BY ALL),
g AS (SELECT b.*, br * 18 + y.i AS y, bc * 18 + x.i AS x FROM b, LATERAL unnest(range(18)) y(i), LATERAL unnest(range(18)) x(i))
SELECT 'slide_' || g.s AS slide, CAST(br AS INTEGER) AS block_row, CAST(bc AS INTEGER) AS block_col, CAST(n AS INTEGER) AS n_tiles, md5(string_agg(repeat(printf('%02x', coalesce(p, 0)), 3), '' ORDER BY g.y, g.x)) AS pixels
FROM g LEFT JOIN px ON g.s = px.s AND g.y = px.y AND g.x = px.x GROUP BY g.s, br, bc, n"""
