"""End to end: tiles through a model to blended blocks, and images through a detector to scored objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.config import EngineConfig
from tilewright.functions import geometry, shape
from tilewright.operators import area, blend, detect, grid, raster, report, shapes
from tilewright.sources import tiff
from tilewright.streaming import micro


#: Cells a side that a slide's tissue mask has at most, where its tiles can be parted into cells.
MASK_SIDE = 4096


class TileModel(Protocol):
    """Upscales a stack of n x h x w x 3 byte images."""

    def __call__(self, images: np.ndarray) -> np.ndarray: ...


class Detector(Protocol):
    """(probability map, score) of each object in one h x w x 3 byte image."""

    def __call__(self, image: np.ndarray) -> list[tuple[np.ndarray, float]]: ...


def components(image: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """The default detector: connected dark parts, each certain; one within another's hole is a part of its own."""
    labels, firsts = raster.label_parts(image.mean(axis=2) < 128)
    return [((labels == n).astype(float), 1.0) for n in range(1, len(firsts) + 1)]


def _contours(mask: np.ndarray) -> list[list[tuple[int, int]]]:
    """Outer borders in a mask that is mostly false: only the box of its true pixels is looked at."""
    rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    if not len(rows):
        return []
    x, y = int(columns[0]), int(rows[0])
    return [[(px + x, py + y) for px, py in c] for c in raster.trace_contours(mask[y : rows[-1] + 1, x : columns[-1] + 1])]


def process_slide(tiles: DataFrame, model: TileModel | None = None, config: EngineConfig = EngineConfig(), block: int = 2048) -> DataFrame:
    """Tiles (slide, row, col, h, w, data) to blended output blocks (slide, block_row, block_col, data).

    The one shuffle brings together the few tiles that reach a block.
    """
    g = config.grid
    scaled = micro.infer(tiles, model or micro.upsample(g.scale))
    pitch, size = grid.grid_step(g) * g.scale, g.tile_size * g.scale
    placed = grid.tile_block_map(scaled, block, size, pitch)
    return blend.blend_blocks(placed, block, size, pitch, g.overlap * g.scale, config.blend.sigma, config.blend.weight_floor)


def process_file(spark: SparkSession, path: str, model: TileModel | None = None, config: EngineConfig = EngineConfig(), block: int = 2048) -> tuple[DataFrame, tuple[int, int], tuple[float, float] | None]:
    """process_slide of one file: its tissue's box is cut into the grid's tiles that hold tissue; also the result's size and microns per pixel.

    The tissue is looked for in the smallest level, by cells of so many of its pixels that a mask has some MASK_SIDE a side,
    if its tiles can be parted so. The file's index is read once by the driver and once a task.
    """
    spark.dataSource.register(tiff.SlideSource)
    levels = tiff.read_levels(path)
    w, h, last = levels[0].w, levels[0].h, len(levels) - 1
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    slide = spark.createDataFrame([(stem, path, 0, 0, w, h)], "stem string, wsi_path string, x0 int, y0 int, w int, h int")
    tiles = grid.tile_grid(slide, config.grid, cover=True)
    small, own = spark.read.format("slide").option("level", str(last)).load(path), levels[last]
    cell = 1
    while max(own.w, own.h) > MASK_SIDE * cell and own.tile_w % (2 * cell) == 0 and own.tile_h % (2 * cell) == 0:
        cell *= 2
    mask = area.mask_blocks(small, path, config.grid.brightness, cell)
    side = own.tile_h // cell, own.tile_w // cell
    held = area.tissue_tiles(tiles, mask, side, max(1, round(w / own.w)) * cell, config.grid.min_tissue).select("tile_id")
    cut = tiff.cut_tiles(spark, path, tiles.join(held, "tile_id", "left_semi"))
    mpp = tuple(m / config.grid.scale for m in levels[0].mpp) if levels[0].mpp else None
    return process_slide(cut, model, config, block), (w * config.grid.scale, h * config.grid.scale), mpp


def block_tiles(blocks: DataFrame, w: int, h: int, block: int) -> DataFrame:
    """Blended blocks (block_row, block_col, data) as the tiles (row, col, h, w, data) of a w x h image, cut at its edge."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                image = np.frombuffer(r["data"], np.uint8).reshape(block, block, 3)[: h - r["block_row"] * block, : w - r["block_col"] * block]
                if image.size:
                    yield pa.RecordBatch.from_arrays([*[pa.array([v], pa.int32()) for v in (r["block_row"], r["block_col"], *image.shape[:2])], pa.array([image.tobytes()], pa.binary())], names=["row", "col", "h", "w", "data"])

    return blocks.select("block_row", "block_col", "data").mapInArrow(cut, "row int, col int, h int, w int, data binary")


_FOUND = "wsi_name string, tile_row int, tile_col int, instance_id int, off_x int, off_y int, score double, contour array<struct<x: double, y: double>>"


def detect_objects(tiles: DataFrame, detector: Detector | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Tiles (wsi_name, tile_row, tile_col, off_x, off_y, h, w, data) to objects with contours in slide coordinates.

    Objects are numbered within their tile before the score filter, so numbers have gaps.
    """
    found: Callable = detector or components
    min_score, threshold = config.screen.min_score, config.screen.mask_threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("wsi_name", pa.string()), *[(c, pa.int32()) for c in ("tile_row", "tile_col", "instance_id", "off_x", "off_y")], ("score", pa.float64()), ("contour", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))])
        for batch in batches:
            for row in batch.to_pylist():
                image = np.frombuffer(row["data"], np.uint8).reshape(row["h"], row["w"], 3)
                rows = []
                for n, (probability, score) in enumerate(found(image)):
                    contours = _contours(probability > threshold)
                    if score < min_score or not contours:
                        continue
                    largest = max(contours, key=lambda c: _ring_area(c))
                    points = [{"x": float(x + row["off_x"]), "y": float(y + row["off_y"])} for x, y in largest]
                    rows.append({**{c: row[c] for c in ("wsi_name", "tile_row", "tile_col", "off_x", "off_y")}, "instance_id": n, "score": float(score), "contour": points})
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return tiles.select("wsi_name", "tile_row", "tile_col", "off_x", "off_y", "h", "w", "data").mapInArrow(run, _FOUND)


def _ring_area(points: list[tuple[int, int]]) -> float:
    return geometry.ring_measures(np.array(points, float))[0]


def describe(objects: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Gate objects with contours, then add all descriptors, the vector and the score.

    The gates come before the Arrow function, which Catalyst would not move a filter below.
    """
    c = F.col
    kept = objects.withColumn("area", geometry.polygon_area("contour")).withColumn("perimeter", geometry.polygon_perimeter("contour")).filter(shape.gate("area", "perimeter", F.size("contour"), config.shape))
    kept = kept.withColumn("bbox", geometry.polygon_bbox("contour")).withColumn("centroid", geometry.polygon_centroid("contour")).filter(c("centroid").isNotNull())
    kept = kept.withColumn("__outline", geometry.outline("contour", c("perimeter") * 0.02))
    out = kept.withColumns({
        "circularity": shape.circularity("area", "perimeter"), "form_factor": shape.form_factor("area", "perimeter"),
        "major_axis_length": c("__outline.major"), "minor_axis_length": c("__outline.minor"), "aspect_ratio": shape.aspect_ratio("__outline.major", "__outline.minor"),
        "eccentricity": shape.eccentricity("__outline.major", "__outline.minor"), "roundness": shape.roundness("area", "__outline.major"),
        "solidity": shape.share("area", "__outline.area"), "convexity": shape.share("__outline.perimeter", "perimeter"),
        "edge_roughness": shape.edge_roughness(F.size("contour"), "__outline.kept", "perimeter", "__outline.perimeter"),
    })
    vector = shape.feature_vector("area", "perimeter", "circularity", "aspect_ratio", "edge_roughness", "solidity", "convexity", "eccentricity", "form_factor", "roundness")
    return report.scored(out.withColumn("feature_vector", vector), config.shape).drop("__outline")


def screen(tiles: DataFrame, detector: Detector | None = None, config: EngineConfig = EngineConfig(), dedup: bool | str = False) -> DataFrame:
    """Detected, described and scored objects.

    ``dedup`` makes what several tiles show of an object one: ``True`` or "shape" by the pixels that pieces share, which are united
    before they are described; "box" by suppressing boxes that overlap a better one.
    """
    found = detect_objects(tiles, detector, config)
    if dedup in (True, "shape"):
        found = shapes.merge_pieces(found)
    described = describe(found, config)
    if dedup != "box":
        return described
    key = F.concat_ws("/", "tile_row", "tile_col", "off_y", "off_x", "instance_id")
    boxed = described.withColumn("__id", key).withColumns({"x1": F.col("bbox.x").cast("double"), "y1": F.col("bbox.y").cast("double"), "x2": (F.col("bbox.x") + F.col("bbox.w")).cast("double"), "y2": (F.col("bbox.y") + F.col("bbox.h")).cast("double")})
    kept = detect.nms_by_rounds(boxed, config.screen.nms_iou, "wsi_name", "__id").select("wsi_name", "__id")
    return boxed.join(kept, ["wsi_name", "__id"], "left_semi").drop("__id", "x1", "y1", "x2", "y2")
