"""Micro-batched model calls over a stream of tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

#: Tiles of one model call at most.
BATCH = 8


def tile_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 4) -> DataFrame:
    """Tiles from a folder that grows; the rate limit is the back pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def infer(tiles: DataFrame, model: Callable[[np.ndarray], np.ndarray], batch: int = BATCH, errors: bool = False) -> DataFrame:
    """Replace ``data`` (binary), ``h`` and ``w`` of each tile by the model's output; same-sized tiles go together.

    A call has at most ``batch`` tiles. A failing call fails its task, which Spark repeats; with ``errors`` it is halved until the bad
    tiles are alone: they come back without data and with the message in a column ``error``, which others have as null.
    """
    schema = StructType([*tiles.schema.fields, StructField("error", StringType())]) if errors else tiles.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for low in range(0, rows.num_rows, batch):
                yield _called(rows.slice(low, batch), model, errors)

    return tiles.mapInArrow(run, schema)


def _halved(images: np.ndarray, model: Callable[[np.ndarray], np.ndarray]) -> list[tuple[np.ndarray | None, str | None]]:
    """(output, error) of each image."""
    try:
        made = model(images)
        if len(made) != len(images):
            raise ValueError(f"{len(made)} outputs of {len(images)} tiles")
        return [(image, None) for image in made]
    except Exception as error:
        if len(images) == 1:
            return [(None, f"{type(error).__name__}: {error}")]
        half = len(images) // 2
        return _halved(images[:half], model) + _halved(images[half:], model)


def _called(rows: pa.RecordBatch, model: Callable[[np.ndarray], np.ndarray], errors: bool) -> pa.RecordBatch:
    sizes = list(zip(rows.column("h").to_pylist(), rows.column("w").to_pylist(), strict=True))
    data, out = rows.column("data").to_pylist(), [(None, None)] * rows.num_rows
    for size in dict.fromkeys(sizes):
        at = [i for i, s in enumerate(sizes) if s == size]
        if errors:  # a tile that is not what it says is a bad tile too
            odd = [i for i in at if data[i] is None or None in size or len(data[i]) != 3 * size[0] * size[1]]
            for i in odd:
                out[i] = None, "ValueError: the data are not of the tile's size"
            at = [i for i in at if i not in set(odd)]
        if not at:
            continue
        images = np.stack([np.frombuffer(data[i], np.uint8).reshape(*size, 3) for i in at])
        for i, result in zip(at, _halved(images, model) if errors else [(x, None) for x in model(images)], strict=True):
            out[i] = result
    made = [x for x, _ in out]
    columns = {
        "data": pa.array([None if x is None else x.tobytes() for x in made], pa.binary()),
        "h": pa.array([s[0] if x is None else x.shape[0] for x, s in zip(made, sizes, strict=True)], pa.int32()),
        "w": pa.array([s[1] if x is None else x.shape[1] for x, s in zip(made, sizes, strict=True)], pa.int32()),
    }
    arrays = [columns.get(n, rows.column(n)) for n in rows.schema.names]
    if errors:
        return pa.RecordBatch.from_arrays([*arrays, pa.array([e for _, e in out], pa.string())], names=[*rows.schema.names, "error"])
    return pa.RecordBatch.from_arrays(arrays, schema=rows.schema)


def upsample(scale: int = 4) -> Callable[[np.ndarray], np.ndarray]:
    """The default model: every pixel repeated ``scale`` times along both axes."""
    return lambda images: images.repeat(scale, axis=1).repeat(scale, axis=2)


def with_callback(tiles: DataFrame, done: Callable[[DataFrame, int], None], failed: Callable[[Exception, int], None] | None = None):
    """A stream writer that hands every finished batch to ``done``; an error goes to ``failed``, or ends the stream."""
    def each(batch: DataFrame, number: int) -> None:
        try:
            done(batch, number)
        except Exception as error:
            if failed is None:
                raise
            failed(error, number)

    return tiles.writeStream.foreachBatch(each)


def with_tile_callbacks(tiles: DataFrame, done: Callable[[DataFrame, int], None], failed: Callable[[DataFrame, int], None]):
    """A stream writer over infer(errors=True): a batch's good tiles go to ``done`` and its bad ones, if any, to ``failed``.

    The batch is kept meanwhile, so that the model is called once for it.
    """
    def each(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            done(kept.filter("error IS NULL").drop("error"), number)
            bad = kept.filter("error IS NOT NULL")
            if not bad.isEmpty():
                failed(bad, number)
        finally:
            kept.unpersist()

    return tiles.writeStream.foreachBatch(each)


def wait_all(query, seconds: float = 120.0) -> bool:
    """Whether a finite stream ended within ``seconds``; it is stopped if not."""
    if query.awaitTermination(seconds):
        return True
    query.stop()
    return False
