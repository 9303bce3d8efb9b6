"""Tissue masks as rows of (slide, my, mx), and the tiles that hold enough of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.config import GridConfig
from tilewright.operators import grid, raster


#: Slides up to this many are sent to all tasks (some tens of MB); more are joined by shuffle.
BROADCAST_SLIDES = 200_000


def tissue_mask(pixels: DataFrame, brightness: float = GridConfig().brightness) -> DataFrame:
    """1 where the mean of the three channels is below ``brightness``."""
    return pixels.withColumn("mask", (((F.col("r") + F.col("g") + F.col("b")) / 3) < brightness).cast("int"))


def mask_cells(tiles: DataFrame, slide: str, brightness: float = GridConfig().brightness) -> DataFrame:
    """(slide, my, mx, mask) of the pixels of image tiles (x, y, h, w, data), each a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                dark = np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"], 3).mean(axis=2) < brightness
                y, x = np.mgrid[r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]]
                columns = [pa.array(v.ravel().astype(np.int32)) for v in (y, x, dark)]
                yield pa.RecordBatch.from_arrays([pa.array([slide] * dark.size), *columns], names=["slide", "my", "mx", "mask"])

    return tiles.select("x", "y", "h", "w", "data").mapInArrow(run, "slide string, my int, mx int, mask int")


def tissue_bbox(cells: DataFrame, slides: DataFrame, slide: str = "slide") -> DataFrame:
    """Box of each slide's tissue cells in level-0 pixels; the whole slide where it has none.

    The extent runs from first to last cell, so the last cell's own width is left out.
    """
    true = cells.filter("mask > 0").groupBy(slide).agg(*[f(c).alias(f"{n}_{c}") for c in ("mx", "my") for n, f in (("low", F.min), ("high", F.max))])
    joined = slides.join(true, slide, "left")

    def part(found: Column, whole: Column) -> Column:
        return F.coalesce(F.floor(found * F.col("downsample")), whole).cast("int")

    return joined.select(slide, part(F.col("low_mx"), F.lit(0)).alias("x"), part(F.col("low_my"), F.lit(0)).alias("y"), part(F.col("high_mx") - F.col("low_mx"), F.col("w")).alias("w"), part(F.col("high_my") - F.col("low_my"), F.col("h")).alias("h"))


def tissue_tiles(tiles: DataFrame, cells: DataFrame, downsample: int, min_tissue: float = GridConfig().min_tissue, slide: str = "wsi_path", key: str = "tile_id") -> DataFrame:
    """(slide, key, tissue_ratio) of tiles whose share of tissue cells is above ``min_tissue``.

    Tiles explode into the cells they span and meet them by key; a tile that spans no
    known cell holds no tissue.
    """
    def span(at: str, size: str) -> Column:
        first = F.floor(F.col(at) / downsample).cast("int")
        last = F.greatest(first, F.floor((F.col(at) + F.col(size)) / downsample).cast("int") - 1)
        return F.sequence(first, last)

    spread = tiles.select(slide, key, F.explode(span("y", "height")).alias("my"), span("x", "width").alias("xs")).withColumn("mx", F.explode("xs")).drop("xs")
    joined = spread.join(cells.select(F.col("slide").alias(slide), "my", "mx", "mask"), [slide, "my", "mx"])
    return joined.groupBy(slide, key).agg(F.avg((F.col("mask") > 0).cast("double")).alias("tissue_ratio")).filter(F.col("tissue_ratio") > min_tissue)


def tissue_tiles_of_grid(slides: DataFrame, cells: DataFrame, downsample: int, min_tissue: float = GridConfig().min_tissue, config: GridConfig = GridConfig(), slide: str = "wsi_path") -> DataFrame:
    """tissue_tiles of grid.tile_grid(slides), from its arithmetic: each cell counts for the few tiles that span it.

    Counts are added up before they are shuffled, so that only tiles are, and no tile meets a cell by a join.
    """
    step = grid.grid_step(config)

    def spread(rows: DataFrame, start: str, extent: str, cell: str, to: str) -> DataFrame:
        """Rows by the tile number along an axis, of the tiles that span their cell."""
        low, at, i = F.col(start), F.col(cell) * downsample, F.col(to)
        # the first tile is moved into the box, so it reaches further than its number tells
        first = F.when(at <= low + config.tile_size, 0).otherwise(F.ceil((at - config.tile_size + config.overlap - low) / step)).cast("int")
        last = F.least(grid.tile_count(F.col(extent), config) - 1, F.floor((at + downsample - 1 - low + config.overlap) / step).cast("int"))
        x = F.greatest(low, low + i * step - config.overlap)
        begin = F.floor(x / downsample)
        end = F.floor((x + F.least(F.lit(config.tile_size), low + F.col(extent) - x)) / downsample)
        return rows.withColumn(to, F.explode(F.sequence(first, F.greatest(first, last)))).filter((i <= last) & (begin <= F.col(cell)) & (F.greatest(begin, end - 1) >= F.col(cell)))

    boxes = slides.select(slide, "stem", "x0", "y0", "w", "h")
    few = boxes.limit(BROADCAST_SLIDES + 1).count() <= BROADCAST_SLIDES
    placed = cells.select(F.col("slide").alias(slide), "my", "mx", (F.col("mask") > 0).cast("int").alias("true")).join(F.broadcast(boxes) if few else boxes, slide)
    placed = spread(spread(placed, "y0", "h", "my", "row"), "x0", "w", "mx", "col")
    ratio = placed.groupBy(slide, "row", "col").agg(F.first("stem").alias("stem"), (F.sum("true").cast("double") / F.count("*")).alias("tissue_ratio")).filter(F.col("tissue_ratio") > min_tissue)
    return ratio.select(slide, F.format_string("%s_r%04d_c%04d", "stem", "row", "col").alias("tile_id"), "tissue_ratio")


_CROSS = ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))


def _hits(cells: DataFrame, slide: str) -> DataFrame:
    """How many of each place's cross are in ``cells``: every cell votes for its neighbours, one aggregation."""
    shifts = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in _CROSS])
    votes = cells.select(slide, "my", "mx", F.explode(shifts).alias("s")).select(slide, (F.col("my") + F.col("s.dy")).alias("my"), (F.col("mx") + F.col("s.dx")).alias("mx"))
    return votes.groupBy(slide, "my", "mx").agg(F.count("*").alias("n"))


def binary_opening(cells: DataFrame, iterations: int = 2, slide: str = "slide") -> DataFrame:
    """Erode, then dilate, the set of true cells by the 4-neighbour cross; outside the slide is false.

    ``cells`` holds true cells only, as does the result. Dilation cannot leave the set, so no bounds are needed.
    """
    current = cells.select(slide, "my", "mx").distinct()
    for _ in range(iterations):
        current = _hits(current, slide).filter(F.col("n") == len(_CROSS)).drop("n")
    for _ in range(iterations):
        current = _hits(current, slide).drop("n")
    return current


def fill_holes(cells: DataFrame, slide: str = "slide") -> DataFrame:
    """True cells with the false ones that the outside cannot reach; one slide's mask is one group."""
    kind = dict(cells.dtypes)[slide]

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        top, left = rows["my"].min() - 1, rows["mx"].min() - 1
        mask = np.zeros((rows["my"].max() - top + 2, rows["mx"].max() - left + 2), bool)
        mask[rows["my"] - top, rows["mx"] - left] = True
        y, x = np.nonzero(~raster.outside(mask))
        return pd.DataFrame({slide: [rows[slide].iloc[0]] * len(y), "my": (y + top).astype("int32"), "mx": (x + left).astype("int32")})

    return cells.groupBy(slide).applyInPandas(fill, f"{slide} {kind}, my int, mx int")
