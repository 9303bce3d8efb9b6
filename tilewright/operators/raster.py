"""Pixels as rows: regions, thumbnails, padding, normalisation; and contours of masks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators.grid import reflect_index


def region_scan(pixels: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """Pixels of a level-0 region; the bounds reach the scan as pushed filters."""
    return pixels.filter(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1))


def thumbnail(pixels: DataFrame, factor: int, slide: str = "slide", channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Block means by ``factor``."""
    at = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("y", "x")]
    return pixels.groupBy(slide, *at).agg(*[F.avg(c).alias(c) for c in channels])


def center_crop(pixels: DataFrame, images: DataFrame, size: int, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """The middle size x size of each image (keys, h, w), moved to the origin; smaller sides stay whole."""
    joined = pixels.join(images.select(*keys, "h", "w"), list(keys))
    for at, extent in (("y", "h"), ("x", "w")):
        joined = joined.withColumn(at, F.col(at) - F.greatest(F.floor((F.col(extent) - size) / 2), F.lit(0)).cast("int"))
    return joined.filter(F.col("y").between(0, size - 1) & F.col("x").between(0, size - 1)).drop("h", "w")


def pad_tile(tiles: DataFrame, pixels: DataFrame, size: int, keys: tuple[str, ...] = ("tile_id",), value: str = "v") -> DataFrame:
    """Every position of a size x size tile, with 0 where it has no pixel (bottom and right)."""
    full = tiles.select(*keys).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    # merged: both sides are many times the tables that they come from, whose size is all that a choice to broadcast would go by
    return full.join(pixels.hint("merge"), [*keys, "y", "x"], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def reflect_pad(tiles: DataFrame, size: int, width: str = "tile_w", height: str = "tile_h") -> DataFrame:
    """(keys, y, x, src_y, src_x) for every position of tiles padded to ``size`` by mirroring."""
    full = tiles.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return full.withColumn("src_y", reflect_index(F.col("y"), F.col(height))).withColumn("src_x", reflect_index(F.col("x"), F.col(width)))


def normalize(value: Column) -> Column:
    """Bytes to -1..1."""
    return value / 127.5 - 1


def denormalize(value: Column) -> Column:
    """-1..1 back to bytes, cut and truncated."""
    return F.least(F.greatest((value + 1) * 127.5, F.lit(0.0)), F.lit(255.0)).cast("int")


def normalize_adaptive(pixels: DataFrame, keys: tuple[str, ...], value: str = "v") -> DataFrame:
    """Divide an image's values by 255 only if any is above 1. One maximum an image, joined back."""
    top = pixels.groupBy(*keys).agg(F.max(value).alias("__top"))
    joined = pixels.join(top, list(keys))
    return joined.withColumn(value, F.when(F.col("__top") > 1, F.col(value) / 255.0).otherwise(F.col(value).cast("double"))).drop("__top")


def augmented(images: DataFrame, size: int, seed: int = 0, key: str = "path") -> DataFrame:
    """Images (key, h, w, data) as size x size random cuts, mirrored at random left to right and top to bottom.

    Chances come from a hash of the seed and the key, so a run can be repeated; smaller
    images are mirrored about their edges to the size.
    """
    kinds = dict(images.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, h, w, data in zip(*(batch.column(c).to_pylist() for c in (key, "h", "w", "data")), strict=True):
                image = np.frombuffer(data, np.uint8).reshape(h, w, 3)
                image = np.pad(image, ((0, max(0, size - h)), (0, max(0, size - w)), (0, 0)), mode="symmetric")
                rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(f"{seed}/{name}".encode(), digest_size=8).digest(), "little"))
                y, x = (int(rng.integers(0, n - size + 1)) for n in image.shape[:2])
                image = image[y : y + size, x : x + size]
                for axis in (1, 0):
                    if rng.random() < 0.5:
                        image = np.flip(image, axis)
                out.append(np.ascontiguousarray(image).tobytes())
            n = len(out)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([size] * n, pa.int32()), pa.array([size] * n, pa.int32()), pa.array(out, pa.binary())], names=[key, "h", "w", "data"])

    return images.select(key, "h", "w", "data").mapInArrow(run, f"`{key}` {kinds[key]}, h int, w int, data binary")


_TURNS = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))  # clockwise, y down


def outside(mask: np.ndarray) -> np.ndarray:
    """False cells connected to the border, growing along whole runs until nothing changes."""
    out = np.zeros_like(mask)
    out[0], out[-1], out[:, 0], out[:, -1] = ~mask[0], ~mask[-1], ~mask[:, 0], ~mask[:, -1]
    while True:
        before = out.sum()
        for axis in (0, 1):
            for step in (1, -1):
                line = out if step == 1 else np.flip(out, axis)
                free = ~mask if step == 1 else ~np.flip(mask, axis)
                for i in range(1, mask.shape[axis]):
                    here, last = (slice(None),) * axis + (i,), (slice(None),) * axis + (i - 1,)
                    line[here] |= line[last] & free[here]
        if out.sum() == before:
            return out


def label_parts(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(labels from 1, 0 where false; first pixel (y, x) of each) of the 8-connected parts (4-connected without ``diagonal``), in the order of those pixels.

    Runs of a row join the runs of the row below that they touch; the least run names a part.
    """
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(edges == 1)
    stops = np.nonzero(edges == -1)[1]
    labels = np.zeros(mask.shape, np.int64)
    if not len(rows):
        return labels, np.zeros((0, 2), np.int64)
    wide = mask.shape[1] + 2
    first = np.searchsorted(rows * wide + stops, (rows + 1) * wide + starts, side="left" if diagonal else "right")
    last = np.searchsorted(rows * wide + starts, (rows + 1) * wide + stops, side="right" if diagonal else "left")
    many = np.maximum(last - first, 0)
    one = np.repeat(np.arange(len(rows)), many)
    other = np.repeat(first, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    root = np.arange(len(rows))
    while True:
        least = np.minimum(root[one], root[other])
        after = root.copy()
        np.minimum.at(after, root[one], least)
        np.minimum.at(after, root[other], least)
        after = after[after]
        if (after == root).all():
            break
        root = after
    heads, number = np.unique(root, return_inverse=True)
    sizes = stops - starts
    x = np.repeat(starts, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    labels[np.repeat(rows, sizes), x] = np.repeat(number + 1, sizes)
    return labels, np.stack([rows[heads], starts[heads]], axis=1)


def trace_contours(mask: np.ndarray) -> list[list[tuple[int, int]]]:
    """Outer borders of the 8-connected parts of a mask, in order of their first pixel, as (x, y) corners.

    What lies in a part's holes is the part's inside, other parts too. Border following:
    from a part's first pixel in row order, turn about each border pixel for
    the next until start and direction recur; of straight runs only the ends stay.
    """
    padded = ~outside(np.pad(mask.astype(bool), 1))
    out = []
    for y, x in label_parts(padded)[1].tolist():
        border, at, turn = [], (y, x), 0
        first = None
        while True:
            for k in range(8):
                d = (turn + 5 + k) % 8 if border else (5 + k) % 8
                to = (at[0] + _TURNS[d][0], at[1] + _TURNS[d][1])
                if padded[to]:
                    break
            else:
                border.append((at, 0))
                break
            if (at, d) == first:
                break
            first = first or (at, d)
            border.append((at, d))
            at, turn = to, d
        points = [p for i, (p, d) in enumerate(border) if len(border) < 3 or border[i - 1][1] != d]
        out.append([(px - 1, py - 1) for py, px in points])
    return out


def mask_images(cells: DataFrame, h: int, w: int, slide: str = "slide") -> DataFrame:
    """(slide, data, h, w): the true cells (my, mx) of each h x w mask as an image of 0 and 1."""
    kind = dict(cells.dtypes)[slide]

    def paint(rows: pa.Table) -> pa.Table:
        image = np.zeros((h, w), np.uint8)
        image[rows.column("my").to_numpy(), rows.column("mx").to_numpy()] = 1
        return pa.table([rows.column(slide).slice(0, 1), pa.array([image.tobytes()], pa.binary()), pa.array([h], pa.int32()), pa.array([w], pa.int32())], names=[slide, "data", "h", "w"])

    return cells.select(slide, "my", "mx").groupBy(slide).applyInArrow(paint, f"{slide} {kind}, data binary, h int, w int")


def extract_contours(masks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, contour_id, contour, area) of each mask row (data binary, h, w); an empty mask has none."""
    kinds = dict(masks.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", contour_id int, contour array<struct<x: double, y: double>>, area double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                mask = np.frombuffer(row["data"], np.uint8).reshape(row["h"], row["w"]) > 0
                for n, points in enumerate(trace_contours(mask)):
                    p = np.array(points, float)
                    after = np.roll(p, -1, axis=0)
                    area = abs(float((p[:, 0] * after[:, 1] - after[:, 0] * p[:, 1]).sum())) / 2
                    rows.append({**{k: row[k] for k in keys}, "contour_id": n, "contour": [{"x": float(a), "y": float(b)} for a, b in points], "area": area})
            kind = pa.schema([*[batch.schema.field(k) for k in keys], ("contour_id", pa.int32()), ("contour", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), ("area", pa.float64())])
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return masks.select(*keys, "data", "h", "w").mapInArrow(run, schema)
