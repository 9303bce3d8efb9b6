"""Images and slides at any size: area means of pixel rows, and cubic or area kernels tile by tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.sources import tiff

KINDS = ("area", "cubic")


def area_means(pixels: DataFrame, size: tuple[int, int], new: tuple[int, int], keys: tuple[str, ...] = ("slide",), channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Pixel rows (keys, y, x, channels) of images of ``size`` (h, w) as rows of images of ``new`` (h, w).

    A new pixel is the mean of the pixels below it, by the area that each has in it, over those that there are; one below which there is
    none has no row. Areas are integers, so only means round. Nulls are left out of means. One aggregation, with partial sums.
    """
    def reached(at: str, n: int, m: int) -> Column:
        return F.sequence(F.floor(F.col(at) * m / n).cast("int"), F.ceil((F.col(at) + 1) * m / n).cast("int") - 1)

    def share(at: str, to: str, n: int, m: int) -> Column:
        return F.least((F.col(at) + 1) * m, (F.col(to) + 1) * n) - F.greatest(F.col(at) * m, F.col(to) * n)

    rows = pixels.withColumn("__y", F.explode(reached("y", size[0], new[0]))).withColumn("__x", F.explode(reached("x", size[1], new[1])))
    rows = rows.withColumn("__a", (share("y", "__y", size[0], new[0]).cast("long") * share("x", "__x", size[1], new[1])))
    means = [(F.sum(F.col(c) * F.col("__a")) / F.sum(F.when(F.col(c).isNotNull(), F.col("__a")))).alias(c) for c in channels]
    return rows.groupBy(*keys, F.col("__y").alias("y"), F.col("__x").alias("x")).agg(*means)


def axis_weights(n: int, m: int, low: int, high: int, kind: str = "cubic") -> tuple[int, np.ndarray]:
    """The first of ``n`` samples that new samples ``low`` up to ``high`` of ``m`` need, and their weights (new x old).

    Weights of a new sample depend on its place in the whole axis alone, so tiles equal the whole. "area" is the mean over the new
    sample's extent, "cubic" the interpolation with a = -1/2, widened where samples get fewer; at the ends what is there is scaled to 1.
    """
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {', '.join(KINDS)}")
    scale = n / m
    half = scale / 2 if kind == "area" else 2 * max(scale, 1.0)
    centre = (np.arange(low, high) + 0.5) * scale
    first, last = max(0, int(np.floor(centre[0] - half))), min(n, int(np.ceil(centre[-1] + half)))
    at = np.arange(first, last)
    if kind == "area":
        weights = np.minimum(at + 1, centre[:, None] + half) - np.maximum(at, centre[:, None] - half)
        weights = np.maximum(weights, 0)
    else:
        t = np.abs((at + 0.5 - centre[:, None]) / max(scale, 1.0))
        weights = np.where(t < 1, (1.5 * t - 2.5) * t * t + 1, np.where(t < 2, ((-0.5 * t + 2.5) * t - 4) * t + 2, 0.0))
    return first, weights / weights.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, h: int, w: int, kind: str = "cubic") -> np.ndarray:
    """A whole image (h x w x channels, bytes) at another size."""
    _, down = axis_weights(image.shape[0], h, 0, h, kind)
    _, across = axis_weights(image.shape[1], w, 0, w, kind)
    return _weighed(image, down, across)


def _weighed(image: np.ndarray, down: np.ndarray, across: np.ndarray) -> np.ndarray:
    mixed = np.einsum("oh,hwc->owc", down, image.astype(np.float64), optimize=True)
    return np.clip(np.rint(np.einsum("pw,owc->opc", across, mixed, optimize=True).round(6)), 0, 255).astype(np.uint8)


def best_level(levels: list[tiff.Level], h: int, w: int) -> tiff.Level:
    """The smallest level no smaller than the wanted size; level 0 if the size is greater than that."""
    enough = [x for x in levels if x.h >= h and x.w >= w]
    return min(enough, key=lambda x: x.h * x.w) if enough else levels[0]


def scaled_slide(spark: SparkSession, path: str, h: int, w: int, tile: int = 512, kind: str = "cubic") -> DataFrame:
    """A slide file at the size h x w as tiles (slide, row, col, h, w, data), those at the right and bottom edge cut.

    Each tile reads what it needs of the best level, with the kernel's margin, so no task has more than a tile and what is
    below it. A task reads the file's index once.
    """
    columns = -(-w // tile)
    cells = spark.range(-(-h // tile) * columns).select(F.floor(F.col("id") / columns).cast("int").alias("row"), (F.col("id") % columns).cast("int").alias("col"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = best_level(tiff.read_levels(path), h, w)
        with open(path, "rb") as f:
            for r in (r for batch in batches for r in batch.to_pylist()):
                y, down = axis_weights(own.h, h, r["row"] * tile, min(h, (r["row"] + 1) * tile), kind)
                x, across = axis_weights(own.w, w, r["col"] * tile, min(w, (r["col"] + 1) * tile), kind)
                image = _weighed(tiff.level_region(f, own, x, y, across.shape[1], down.shape[1]), down, across)
                yield pa.RecordBatch.from_arrays([pa.array([path]), *[pa.array([v], pa.int32()) for v in (r["row"], r["col"], *image.shape[:2])], pa.array([image.tobytes()], pa.binary())], names=["slide", "row", "col", "h", "w", "data"])

    return cells.mapInArrow(run, "slide string, row int, col int, h int, w int, data binary")


def slide_at(spark: SparkSession, path: str, mpp: float, tile: int = 512, kind: str = "cubic") -> tuple[DataFrame, tuple[int, int]]:
    """A slide at ``mpp`` microns a pixel (see scaled_slide) and its size (h, w); a slide without a resolution is an error."""
    base = tiff.read_levels(path)[0]
    if not base.mpp:
        raise ValueError(f"{path} has no resolution")
    w, h = (max(1, round(n * own / mpp)) for n, own in zip((base.w, base.h), base.mpp, strict=True))
    return scaled_slide(spark, path, h, w, tile, kind), (h, w)
