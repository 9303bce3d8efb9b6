"""Overlap of shapes against pixel counts, and objects that tiles cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import raster, shapes
from tilewright.plans import pipeline


def blob(rng, n=24):
    """A part without holes, as mask and outer border."""
    while True:
        mask = rng.random((n, n)) < 0.55
        labels, firsts = raster.label_parts(mask)
        if len(firsts):
            sizes = np.bincount(labels.ravel())[1:]
            part = labels == 1 + int(sizes.argmax())
            part = ~raster.outside(np.pad(part, 1))[1:-1, 1:-1]
            return part, raster.trace_contours(part)[0]


def test_a_border_is_filled_to_its_pixels():
    rng = np.random.default_rng(0)
    for _ in range(60):
        mask, border = blob(rng)
        got, y, x = shapes.filled(np.array(border))
        whole = np.zeros_like(mask)
        whole[y : y + got.shape[0], x : x + got.shape[1]] = got
        assert (whole == mask).all()
    # slanted edges: pixels inside or on, by the sides of a triangle
    got, y, x = shapes.filled(np.array([(0, 0), (7, 2), (3, 9)]))
    py, px = np.mgrid[:10, :8]
    side = [(b[0] - a[0]) * (py - a[1]) - (b[1] - a[1]) * (px - a[0]) >= 0 for a, b in (((0, 0), (7, 2)), ((7, 2), (3, 9)), ((3, 9), (0, 0)))]
    assert (got == (side[0] & side[1] & side[2])).all() and (y, x) == (0, 0)


def test_overlap_is_the_count_of_pixels():
    rng = np.random.default_rng(1)
    for _ in range(80):
        (a, _), (b, _) = blob(rng), blob(rng)
        dy, dx = rng.integers(-20, 21, 2).tolist()
        canvas = np.zeros((2, 70, 70), int)
        canvas[0, 22:46, 22:46], canvas[1, 22 + dy : 46 + dy, 22 + dx : 46 + dx] = a, b
        assert shapes.overlap(shapes.spans_of(a, 0, 0), shapes.spans_of(b, dy, dx)) == (canvas[0] & canvas[1]).sum()


CONTOUR = "array<struct<x: double, y: double>>"


def points(border, dx=0, dy=0):
    return [{"x": float(x + dx), "y": float(y + dy)} for x, y in border]


def test_pairs_by_shape(spark):
    rng = np.random.default_rng(2)
    rows, masks = [], {}
    for i in range(40):
        mask, border = blob(rng)
        dy, dx = rng.integers(0, 60, 2).tolist()
        masks[i] = np.zeros((90, 90), bool)
        masks[i][dy : dy + 24, dx : dx + 24] = mask
        rows.append((f"s{i % 2}", i, points(border, dx, dy)))
    df = spark.createDataFrame(rows, f"wsi_name string, id int, contour {CONTOUR}")
    got = {(r["id_a"], r["id_b"]): (r["shared"], r["iou"]) for r in shapes.shape_pairs(df, "wsi_name", "id").collect()}
    want = {(a, b): int((masks[a] & masks[b]).sum()) for a in masks for b in masks if a < b and a % 2 == b % 2}
    want = {k: n for k, n in want.items() if n}
    assert {k: v[0] for k, v in got.items()} == want and len(want) > 20
    for (a, b), (n, iou) in got.items():
        assert iou == pytest.approx(n / (masks[a] | masks[b]).sum())
    none = df.withColumn("contour", F.array().cast(CONTOUR))
    assert shapes.shape_pairs(none, "wsi_name", "id").count() == 0 and shapes.shape_pairs(df.limit(0), "wsi_name", "id").count() == 0


def tiles_of_slide(spark, image, side, overlap):
    rows, step = [], side - overlap
    for y in range(0, image.shape[0] - overlap, step):
        for x in range(0, image.shape[1] - overlap, step):
            part = np.ascontiguousarray(image[y : y + side, x : x + side])
            rows.append(("w", y // side, x // side, x, y, *part.shape[:2], part.tobytes()))
    return spark.createDataFrame(rows, "wsi_name string, tile_row int, tile_col int, off_x int, off_y int, h int, w int, data binary").repartition(3)


def test_objects_that_tiles_cut_are_one(spark):
    """Discs over tile borders and corners: as many objects as there are, each of its true size."""
    image = np.full((420, 420, 3), 255, np.uint8)
    y, x = np.mgrid[:420, :420]
    discs = [(60, 60, 25), (200, 200, 38), (200, 330, 30), (95, 210, 20), (340, 110, 45), (330, 300, 30), (330, 340, 9)]
    for cy, cx, r in discs:
        image[(y - cy) ** 2 + (x - cx) ** 2 <= r * r] = 0
    tiles = tiles_of_slide(spark, image, 200, 110)
    found = pipeline.screen(tiles, dedup=True).collect()
    assert pipeline.screen(tiles).count() > len(found)
    want = {}
    labels, firsts = raster.label_parts(image[:, :, 0] == 0)
    for n in range(1, len(firsts) + 1):
        py, px = np.nonzero(labels == n)
        want[int(px.min()), int(py.min()), int(px.max()), int(py.max())] = n
    got = {(int(min(p["x"] for p in r["contour"])), int(min(p["y"] for p in r["contour"])), int(max(p["x"] for p in r["contour"])), int(max(p["y"] for p in r["contour"]))) for r in found}
    assert got == set(want) and len(found) == len(want)
    for r in found:
        mask, _, _ = shapes.filled(np.array([(p["x"], p["y"]) for p in r["contour"]]))
        assert mask.sum() in {int((labels == n).sum()) for n in want.values()}
    assert pipeline.screen(tiles, dedup="box").count() >= len(want)


def test_overlaps_of_many_pairs_at_once(spark):
    rng = np.random.default_rng(11)
    sides = [[], []]
    for _ in range(300):
        for s in sides:
            mask = rng.random((int(rng.integers(1, 7)), int(rng.integers(1, 9)))) < rng.choice([0.0, 0.5, 1.0])
            s.append(shapes.spans_of(mask, *rng.integers(-4, 4, 2).tolist()))
    flat = [x for s in sides for x in (np.concatenate(s), np.array([len(a) for a in s]))]
    assert shapes.overlaps(*flat).tolist() == [shapes.overlap(a, b) for a, b in zip(*sides, strict=True)]
    plan = shapes.shape_pairs(spark.createDataFrame([("s", 1, [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0)])], "wsi_name string, id int, contour array<struct<x: double, y: double>>"), "wsi_name", "id")._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join") == 1  # spans come with the boxes
