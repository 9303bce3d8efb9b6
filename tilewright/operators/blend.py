"""Weighted blending of overlapping tiles, its kernel, progress and pyramids."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.config import BlendConfig


def kernel_weight(y: Column, x: Column, size: int, overlap: int, sigma: float) -> Column:
    """Gaussian about the tile's centre times a squared sine that falls to 0 at its edges; not yet scaled to 1."""
    centre = size / 2.0
    distance = (y - centre) * (y - centre) + (x - centre) * (x - centre)
    edge = F.least(y, x, F.lit(size - 1) - y, F.lit(size - 1) - x)
    ramp = F.sin(F.lit(math.pi / 2) * F.least(F.lit(1.0), edge / float(max(overlap, 1))))
    return F.exp(-distance / (2 * sigma * sigma)) * ramp * ramp


def kernel(size: int, overlap: int, sigma: float) -> np.ndarray:
    """The same weights as an array whose greatest is 1."""
    at = np.arange(size)
    gauss = np.exp(-((at - size / 2.0) ** 2) / (2 * sigma**2))
    edge = np.minimum(at, size - 1 - at)
    ramp = np.sin(np.pi / 2 * np.minimum(1.0, np.minimum(edge[:, None], edge[None, :]) / max(overlap, 1))) ** 2
    weights = gauss[:, None] * gauss[None, :] * ramp
    return weights / weights.max()


def blend_kernel(positions: DataFrame, size: int, overlap: int, sigma: float) -> DataFrame:
    """(y, x, weight) at the given positions, scaled so that the kernel's greatest weight is 1."""
    peak = float(_peak(size, overlap, sigma))
    return positions.select("y", "x", (kernel_weight(F.col("y"), F.col("x"), size, overlap, sigma) / peak).alias("weight"))


def _peak(size: int, overlap: int, sigma: float) -> float:
    at = np.arange(size)
    gauss = np.exp(-((at - size / 2.0) ** 2) / (2 * sigma**2))
    edge = np.minimum(at, size - 1 - at)
    ramp = np.sin(np.pi / 2 * np.minimum(1.0, edge / max(overlap, 1))) ** 2
    best = 0.0
    for i in range(size):  # the ramp of a pixel is that of its nearer edge
        best = max(best, float((gauss[i] * gauss * np.minimum(ramp[i], ramp)).max()))
    return best


def weighted_blend(contributions: DataFrame, keys: tuple[str, ...], value: str = "v", weight: str = "w", floor: float = BlendConfig().weight_floor) -> DataFrame:
    """sum(v w) / max(sum w, floor) at each key, cut to 0..255 and truncated. Partial sums leave the map side."""
    total, mass = F.sum(F.col(value) * F.col(weight)), F.sum(weight)
    mean = total / F.greatest(mass, F.lit(floor))
    return contributions.groupBy(*keys).agg(F.least(F.greatest(mean, F.lit(0.0)), F.lit(255.0)).cast("int").alias("pixel"), mass.alias("weight"))


def strip_blend(contributions: DataFrame, strip_rows: int, keys: tuple[str, ...] = ("slide", "y", "x"), **kw) -> DataFrame:
    """The same blend with each pixel's strip; equals the whole-canvas result, as a strip is only a grouping."""
    return weighted_blend(contributions.withColumn("strip", F.floor(F.col("y") / strip_rows).cast("int")), (*keys, "strip"), **kw)


def fill_progress(canvas: DataFrame, slide: str = "slide", weight: str = "weight") -> DataFrame:
    return canvas.groupBy(slide).agg((F.count_if(F.col(weight) > 0) / F.count("*") * 100).alias("filled_percent"))


def tile_progress(done: DataFrame, keys: tuple[str, ...], total: Column) -> DataFrame:
    return done.groupBy(*keys).agg((F.count_if("processed") / F.greatest(F.first(total), F.lit(1)) * 100).alias("percent"))


def pyramid_levels(pixels: DataFrame, levels: int = 4, slide: str = "slide", channels: tuple[str, ...] = ("v",)) -> DataFrame:
    """(slide, level, y, x, channels): each level the mean of 2 x 2 pixels of the one below, or of those that there are at an odd edge.

    Each level aggregates a quarter of the rows of the last.
    """
    current = pixels.select(slide, "y", "x", *[F.col(c).cast("double").alias(c) for c in channels])
    out = current.select(slide, F.lit(0).alias("level"), "y", "x", *channels)
    for level in range(1, levels):
        current = current.groupBy(slide, F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).agg(*[F.avg(c).alias(c) for c in channels])
        out = out.unionByName(current.select(slide, F.lit(level).alias("level"), "y", "x", *channels))
    return out


def blended(tiles: Iterable[tuple[int, int, bytes, int, int]], block_row: int, block_col: int, block: int, pitch: int, weights: np.ndarray, floor: float) -> np.ndarray:
    """One output block out of the tiles (row, col, data, h, w) that reach it, summed by (row, col), so that their order does not show."""
    top, left = block_row * block, block_col * block
    total, mass = np.zeros((block, block, 3)), np.zeros((block, block, 1))
    for row, col, data, h, w in sorted(tiles):
        pixels = np.frombuffer(data, np.uint8).reshape(h, w, 3)
        y, x = row * pitch - top, col * pitch - left
        y0, x0, y1, x1 = max(y, 0), max(x, 0), min(y + h, block), min(x + w, block)
        if y0 < y1 and x0 < x1:
            part = weights[y0 - y : y1 - y, x0 - x : x1 - x, None]
            total[y0:y1, x0:x1] += pixels[y0 - y : y1 - y, x0 - x : x1 - x] * part
            mass[y0:y1, x0:x1] += part
    return np.clip(total / np.maximum(mass, floor), 0, 255).astype(np.uint8)


def blend_blocks(placed: DataFrame, block: int, tile: int, pitch: int, overlap: int, sigma: float, floor: float = BlendConfig().weight_floor) -> DataFrame:
    """Blend whole tiles by output block: rows (slide, block_row, block_col, row, col, data, h, w) to (slide, block_row, block_col, data).

    Each block is one group of the few tiles that reach it, so memory is a block and a tile.
    """
    def merge(rows: pa.Table) -> pa.Table:
        first = {c: rows.column(c)[0].as_py() for c in ("slide", "block_row", "block_col")}
        tiles = zip(*(rows.column(c).to_pylist() for c in ("row", "col", "data", "h", "w")), strict=True)
        image = blended(tiles, first["block_row"], first["block_col"], block, pitch, kernel(tile, overlap, sigma), floor)
        return pa.table({"slide": pa.array([first["slide"]], rows.schema.field("slide").type), "block_row": pa.array([first["block_row"]], pa.int32()), "block_col": pa.array([first["block_col"]], pa.int32()), "data": pa.array([image.tobytes()], pa.binary())})

    kind = dict(placed.dtypes)["slide"]
    return placed.groupBy("slide", "block_row", "block_col").applyInArrow(merge, f"slide {kind}, block_row int, block_col int, data binary")
