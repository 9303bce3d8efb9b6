"""Tile grids, screening tiles, strips, batches and their arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.config import BlendConfig, GridConfig, IngestConfig, ScreenConfig


def _ceil_div(a: Column, b: int) -> Column:
    return F.ceil(a / F.lit(b)).cast("int")


def grid_step(config: GridConfig = GridConfig()) -> int:
    step = config.tile_size - 2 * config.overlap
    if step <= 0:
        raise ValueError(f"overlap {config.overlap} leaves no step in tiles of {config.tile_size}")
    return step


def tile_count(extent: Column, config: GridConfig = GridConfig()) -> Column:
    """Tiles along an axis; the last columns of an extent may stay uncovered (see ``cover`` in tile_grid)."""
    return F.greatest(F.lit(1), _ceil_div(extent - 2 * config.overlap, grid_step(config)))


def tile_grid(slides: DataFrame, config: GridConfig = GridConfig(), cover: bool = False) -> DataFrame:
    """One row per tile of the box (x0, y0, w, h) of each slide (stem, wsi_path).

    Tile i starts at ``i * step - overlap`` inside the box and is cut at its end.
    ``cover=True`` adds a tile where the plain count leaves an edge uncovered.
    """
    step = grid_step(config)

    def count(extent: Column) -> Column:
        n = tile_count(extent, config)
        last = F.greatest(F.lit(0), (n - 1) * step - config.overlap) + config.tile_size
        return n + F.when(last < extent, 1).otherwise(0) if cover else n

    grid = slides.withColumn("total_rows", count(F.col("h"))).withColumn("total_cols", count(F.col("w")))
    grid = grid.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("total_rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("total_cols") - 1)))

    def origin(start: str, i: str) -> Column:
        return F.greatest(F.col(start), F.col(start) + F.col(i) * step - config.overlap)

    def size(start: str, extent: str, at: str) -> Column:
        return F.least(F.lit(config.tile_size), F.col(start) + F.col(extent) - F.col(at))

    grid = grid.withColumn("x", origin("x0", "col")).withColumn("y", origin("y0", "row"))
    grid = grid.withColumn("width", size("x0", "w", "x")).withColumn("height", size("y0", "h", "y"))
    name = F.format_string("%s_r%04d_c%04d", "stem", "row", "col")
    return grid.select(name.alias("tile_id"), "wsi_path", *[F.col(c).cast("int") for c in ("x", "y", "width", "height")], F.lit(0).alias("level"), "row", "col", "total_rows", "total_cols")


def output_dims(slides: DataFrame, config: GridConfig = GridConfig()) -> DataFrame:
    """Size and origin of the upscaled image of each slide's box."""
    step = grid_step(config)
    dims = [(_ceil_div(F.col(c), step) * step * config.scale).alias(f"out_{c}") for c in ("w", "h")]
    return slides.select("wsi_path", *dims, (F.col("x0") * config.scale).cast("int").alias("out_x"), (F.col("y0") * config.scale).cast("int").alias("out_y"))


def screen_tiles(slides: DataFrame, config: ScreenConfig = ScreenConfig()) -> DataFrame:
    """Ragged tiles of each (wsi_name, w, h) at a step of tile less overlap; slivers under ``min_side`` go.

    ``tile_row`` and ``tile_col`` are origins over the tile size and may repeat; the offsets are the key.
    """
    step = config.tile_size - config.overlap
    rows = slides
    for axis, extent in (("y", "h"), ("x", "w")):
        rows = rows.withColumn(f"off_{axis}", F.explode(F.sequence(F.lit(0), F.greatest(F.col(extent) - 1, F.lit(0)), F.lit(step))))
    rows = rows.withColumn("tile_h", F.least(F.lit(config.tile_size), F.col("h") - F.col("off_y"))).withColumn("tile_w", F.least(F.lit(config.tile_size), F.col("w") - F.col("off_x")))
    rows = rows.filter((F.col("tile_h") >= config.min_side) & (F.col("tile_w") >= config.min_side))
    return rows.select("wsi_name", *[F.col(c).cast("int") for c in ("off_y", "off_x", "tile_h", "tile_w")], F.floor(F.col("off_y") / config.tile_size).cast("int").alias("tile_row"), F.floor(F.col("off_x") / config.tile_size).cast("int").alias("tile_col"))


def reflect_index(i: Column, n: Column) -> Column:
    """Source of position i when n samples are mirrored about their ends, as often as it takes."""
    period = F.greatest(2 * (n - 1), F.lit(1))
    j = F.pmod(i, period)
    return F.when(n == 1, F.lit(0)).otherwise(F.when(j >= n, period - j).otherwise(j)).cast("int")


def tile_batches(tiles: DataFrame, slide: str = "wsi_path", order: tuple[str, ...] = ("row", "col"), size: int = IngestConfig().batch_tiles, whole: bool = False) -> DataFrame:
    """Number each slide's tiles and cut them into batches of ``size``.

    A ``whole`` grid, with total_cols, is numbered row by row where its rows are, without a shuffle; else the tiles that are left of one
    are sorted by slide.
    """
    at = F.col(order[0]) * F.col("total_cols") + F.col(order[1]) if whole else F.row_number().over(Window.partitionBy(slide).orderBy(*order)) - 1
    return tiles.withColumn("tile_index", at).withColumn("batch_idx", F.floor(F.col("tile_index") / size).cast("int"))


def strip_plan(slides: DataFrame, grid: GridConfig = GridConfig(), blend: BlendConfig = BlendConfig()) -> DataFrame:
    """Tile rows and columns of the upscaled image and the height of its strips."""
    pitch = grid_step(grid) * grid.scale
    return slides.select("wsi_path", _ceil_div(F.col("out_h"), pitch).alias("total_rows"), _ceil_div(F.col("out_w"), pitch).alias("total_cols"), F.lit(blend.strip_factor * pitch).alias("strip_height"))


def strip_boundaries(tiles: DataFrame, slide: str = "wsi_path", strip: str = "strip", rows: int | None = None) -> DataFrame:
    """Mark tiles, in order of (row, col), at which a new strip begins.

    In a whole grid whose strips have so many ``rows`` of tiles each they are the first of every such row, and nothing is sorted.
    """
    if rows:
        return tiles.withColumn("starts_strip", (F.col("col") == 0) & (F.col("row") % rows == 0))
    before = F.lag(strip).over(Window.partitionBy(slide).orderBy("row", "col"))
    return tiles.withColumn("starts_strip", before.isNull() | (before != F.col(strip)))


def tile_block_map(tiles: DataFrame, block: int, tile: int, pitch: int) -> DataFrame:
    """(slide, row, col, block_row, block_col): the output blocks that each placed tile reaches.

    Tiles explode into block keys, so that gathering a block's tiles is an equi-grouping.
    """
    def span(i: str) -> Column:
        first = F.col(i) * pitch
        return F.sequence(F.floor(first / block).cast("int"), F.floor((first + tile - 1) / block).cast("int"))

    return tiles.withColumn("block_row", F.explode(span("row"))).withColumn("block_col", F.explode(span("col")))


def file_size_estimate(slides: DataFrame, channels: int = 3, ratio: float = 2.0) -> DataFrame:
    """Compressed size of a w x h image, in GiB."""
    return slides.select("wsi_path", (F.col("w").cast("double") * F.col("h") * channels / ratio / float(1 << 30)).alias("estimated_gib"))


def memory_estimate(slides: DataFrame, strip_rows: int = 4096, channels: int = 3, tile: int = 2048, spare_mib: int = 50, rings: int = 4) -> DataFrame:
    """MiB that a w x h canvas takes as a whole, and strip by strip with a kernel and ring buffers on a device."""
    mib = float(1 << 20)
    w, h = F.col("w").cast("double"), F.col("h").cast("double")
    pixel = float(channels * 4 + 4)
    whole, strip = w * h * pixel, w * float(strip_rows) * pixel
    peak = strip * float(1 + rings) + float(tile * tile * 4)
    return slides.select(
        "wsi_path",
        (w * h * float(channels * 4) / mib).alias("output_image_mb"),
        (w * h * 4.0 / mib).alias("weight_map_mb"),
        (whole / mib + float(spare_mib)).alias("estimated_total_mb"),
        (strip / mib).alias("strip_gpu_mb"),
        (peak / mib).alias("peak_gpu_mb"),
        (whole / mib).alias("cpu_mb"),
        ((peak + whole) / float(1 << 30)).alias("total_gb"),
    )
