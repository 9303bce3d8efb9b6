"""Overlap of objects by their true shapes, and one object out of the pieces that tiles show of it.

A shape is the pixels inside or on a contour, as spans of rows. Boxes that overlap meet first; then spans are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators import quad, raster
from tilewright.operators.graph import components
from tilewright.sources.scratch import written


def filled(points: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(mask, y, x): the pixels inside or on a closed polygon of whole (x, y) corners, in its box, whose first pixel is (y, x)."""
    p = np.asarray(points, np.int64).reshape(-1, 2)
    x0, y0 = p.min(axis=0)
    w, h = p.max(axis=0) - (x0, y0) + 1
    p = p - (x0, y0)
    toggles, border = np.zeros((h, w + 1), np.int64), np.zeros((h, w), bool)
    for (ax, ay), (bx, by) in zip(p.tolist(), np.roll(p, -1, axis=0).tolist(), strict=True):
        steps = gcd(abs(bx - ax), abs(by - ay))
        k = np.arange(steps + 1)
        border[ay + k * ((by - ay) // max(steps, 1)), ax + k * ((bx - ax) // max(steps, 1))] = True
        if ay != by:
            if ay > by:
                ax, ay, bx, by = bx, by, ax, ay
            rows = np.arange(ay, by)
            # the first pixel at or right of the edge in each row
            first = -((-(ax * (by - ay) + (rows - ay) * (bx - ax))) // (by - ay))
            np.add.at(toggles, (rows, first), 1)
    return (np.cumsum(toggles[:, :-1], axis=1) % 2 == 1) | border, int(y0), int(x0)


def spans_of(mask: np.ndarray, y: int, x: int) -> np.ndarray:
    """Rows (y, first x, last x) of the true pixels of a mask that lies at (y, x)."""
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, firsts = np.nonzero(edges == 1)
    return np.stack([rows + y, firsts + x, np.nonzero(edges == -1)[1] - 1 + x], axis=1)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Pixels in both of two sets of spans, each in order."""
    if not len(a) or not len(b):
        return 0
    low = min(a[:, 1].min(), b[:, 1].min())
    wide = max(a[:, 2].max(), b[:, 2].max()) - low + 2
    starts, ends = b[:, 0] * wide + b[:, 1] - low, b[:, 0] * wide + b[:, 2] - low + 1
    before = np.concatenate([[0], np.cumsum(ends - starts)])

    def covered(at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(starts, at, side="right")
        return before[k] - np.where(k > 0, np.maximum(ends[np.maximum(k - 1, 0)] - at, 0), 0)

    return int((covered(a[:, 0] * wide + a[:, 2] - low + 1) - covered(a[:, 0] * wide + a[:, 1] - low)).sum())


def overlaps(a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """``overlap`` of many pairs at once: spans one after the other, and how many each pair has of either side."""
    own_a, own_b = np.repeat(np.arange(len(sizes_a)), sizes_a), np.repeat(np.arange(len(sizes_b)), sizes_b)
    own, every = np.concatenate([own_a, own_b]), np.concatenate([a, b])
    low, high = np.zeros((2, len(sizes_a)), np.int64), np.zeros((2, len(sizes_a)), np.int64)
    for i, first, last in ((0, 0, 0), (1, 1, 2)):
        low[i], high[i] = np.iinfo(np.int64).max // 4, np.iinfo(np.int64).min // 4
        np.minimum.at(low[i], own, every[:, first])
        np.maximum.at(high[i], own, every[:, last])
    found = np.bincount(own, minlength=len(sizes_a)) > 0
    low[:, ~found] = high[:, ~found] = 0
    # each pair's pixels have numbers of their own, row by row
    wide = high[1] - low[1] + 2
    base = np.concatenate([[0], np.cumsum((high[0] - low[0] + 1) * wide)[:-1]]) if len(wide) else np.zeros(0, np.int64)

    def numbers(spans: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = base[o] + (spans[:, 0] - low[0][o]) * wide[o] - low[1][o]
        return row + spans[:, 1], row + spans[:, 2] + 1

    (from_a, to_a), (starts, ends) = numbers(a, own_a), numbers(b, own_b)
    before = np.concatenate([[0], np.cumsum(ends - starts)])

    def covered(at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(starts, at, side="right")
        return before[k] - (np.where(k > 0, np.maximum(ends[np.maximum(k - 1, 0)] - at, 0), 0) if len(ends) else 0)

    return np.bincount(own_a, weights=covered(to_a) - covered(from_a), minlength=len(sizes_a)).astype(np.int64)


_SPANS = "spans array<int>, pixels long, x1 double, y1 double, x2 double, y2 double"


def with_spans(objects: DataFrame, key: str, contour: str = "contour") -> DataFrame:
    """(key, spans, pixels, x1, y1, x2, y2) of each object's contour: its spans one after the other, their pixels and box."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for points in batch.column(contour).to_pylist():
                spans = spans_of(*filled(np.rint([(q["x"], q["y"]) for q in points]))) if points else np.zeros((0, 3), np.int64)
                box = (spans[:, 1].min(), spans[:, 0].min(), spans[:, 2].max() + 1, spans[:, 0].max() + 1) if len(spans) else (0, 0, 0, 0)
                rows.append((spans.ravel().tolist(), int((spans[:, 2] - spans[:, 1] + 1).sum()), *map(float, box)))
            kinds = [pa.list_(pa.int32()), pa.int64(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=[key, "spans", "pixels", "x1", "y1", "x2", "y2"])

    return objects.select(key, contour).mapInArrow(run, f"{key} {dict(objects.dtypes)[key]}, {_SPANS}")


def _packed(shapes: DataFrame, key: str) -> DataFrame:
    """Spans as bytes of 32-bit integers, which pass to Python as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [x.values.to_numpy(zero_copy_only=False).astype(np.int32).tobytes() for x in batch.column("spans")]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()) if c == "spans" else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    return shapes.mapInArrow(run, f"{key} {dict(shapes.dtypes)[key]}, {_SPANS.replace('spans array<int>', 'spans binary')}")


def shape_pairs(objects: DataFrame, slide: str = "wsi_name", key: str = "instance_id", contour: str = "contour") -> DataFrame:
    """(slide, id_a, id_b, shared, pixels_a, pixels_b, iou) of objects whose shapes share a pixel, each pair once. Keys are unique."""
    kind = dict(objects.dtypes)[key]
    shapes = written(objects.select(slide, key).join(_packed(with_spans(objects, key, contour), key), key), "shape-spans")
    # a shape goes with its box, so that pairs have their spans where they meet; the key comes first and tells the order
    whole = shapes.filter("pixels > 0").select(slide, F.struct(F.col(key).alias("id"), "pixels", "spans").alias("__shape"), "x1", "y1", "x2", "y2")
    met = quad.overlapping(whole, slide, "__shape").select(slide, *[F.col(f"id_{n}.{c}").alias(f"{c}_{n}") for n in "ab" for c in ("id", "pixels", "spans")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = []
            for n in "ab":
                data = batch.column(f"spans_{n}").to_pylist()
                both += [np.frombuffer(b"".join(data), np.int32).reshape(-1, 3).astype(np.int64), np.array([len(x) // 12 for x in data], np.int64)]
            kept = [slide, "id_a", "id_b", "pixels_a", "pixels_b"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(overlaps(*both), pa.int64())], names=[*kept, "shared"])

    found = met.mapInArrow(run, f"{slide} {dict(objects.dtypes)[slide]}, id_a {kind}, id_b {kind}, pixels_a long, pixels_b long, shared long").filter("shared > 0")
    return found.select(slide, "id_a", "id_b", "shared", "pixels_a", "pixels_b", (F.col("shared") / (F.col("pixels_a") + F.col("pixels_b") - F.col("shared"))).alias("iou"))


def merge_pieces(objects: DataFrame, share: float = 0.5, slide: str = "wsi_name", tile: tuple[str, ...] = ("off_y", "off_x")) -> DataFrame:
    """Objects with those that tiles show of the same thing made one: of different tiles, sharing ``share`` of the smaller one's pixels.

    What hangs together becomes the outer border of all its pixels, with the highest score and the other columns of the piece
    with most pixels (ties: the first in ``tile``, then instance_id). A piece that a tile's edge cuts lies within the whole.
    """
    names = objects.columns
    numbered = written(objects.withColumn("__id", F.monotonically_increasing_id()), "shape-objects")
    tiles = numbered.select("__id", F.struct(*tile).alias("tile"))
    pairs = shape_pairs(numbered, slide, "__id").filter(F.col("shared") >= share * F.least("pixels_a", "pixels_b"))
    pairs = pairs.join(tiles.select(F.col("__id").alias("id_a"), F.col("tile").alias("tile_a")), "id_a").join(tiles.select(F.col("__id").alias("id_b"), F.col("tile").alias("tile_b")), "id_b").filter("tile_a != tile_b")
    joined = components(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), "shape-edges").withColumnRenamed("id", "__id")
    several = numbered.join(joined, "__id")

    def unite(rows: pa.Table) -> pa.Table:
        found = []
        for r in rows.to_pylist():
            mask, y, x = filled(np.rint([(q["x"], q["y"]) for q in r["contour"]]))
            found.append((-int(mask.sum()), tuple(r[c] for c in tile), r["instance_id"], mask, y, x, r))
        found.sort(key=lambda f: f[:3])
        top, left = min(f[4] for f in found), min(f[5] for f in found)
        whole = np.zeros((max(f[4] + f[3].shape[0] for f in found) - top, max(f[5] + f[3].shape[1] for f in found) - left), bool)
        for *_, mask, y, x, _ in found:
            whole[y - top : y - top + mask.shape[0], x - left : x - left + mask.shape[1]] |= mask
        border = max(raster.trace_contours(whole), key=len)
        best = {**found[0][-1], "score": max(f[-1]["score"] for f in found), "contour": [{"x": float(px + left), "y": float(py + top)} for px, py in border]}
        return pa.Table.from_pylist([{c: best[c] for c in names}], schema=rows.select(names).schema)

    schema = objects.schema
    united = several.select(*names, "component").groupBy("component").applyInArrow(unite, schema)
    return numbered.join(joined, "__id", "left_anti").select(*names).unionByName(united)
