"""Parts, holes and contours by blocks against the whole mask at once."""

import numpy as np
import pytest

from tilewright.operators import parts, raster

CELLS = "slide string, my int, mx int"


def masks_of(seed):
    rng = np.random.default_rng(seed)
    masks = {f"d{d}": rng.random((19, 23)) < d for d in (0.1, 0.3, 0.45, 0.6, 0.85)}
    ring = np.zeros((19, 23), bool)
    ring[1:18, 1:22] = True
    ring[3:16, 3:20] = False  # a hole over many blocks, with an island that has a hole
    ring[6:12, 6:15] = True
    ring[8:10, 8:12] = False
    masks["ring"] = ring
    snake = np.zeros((19, 23), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    masks["snake"] = snake
    masks["one"] = np.zeros((19, 23), bool)
    masks["one"][7, 7] = True
    stairs = np.eye(19, 23, dtype=bool)  # joined by corners alone, over blocks' corners too
    masks["stairs"], masks["rising"] = stairs, stairs[:, ::-1]
    return masks


def cells_of(spark, masks, shift=0):
    rows = [(s, int(y) + shift, int(x) + shift) for s, m in masks.items() for y, x in zip(*np.nonzero(m), strict=True)]
    return spark.createDataFrame(rows, CELLS).repartition(3)


def filled(mask):
    return ~raster.outside(np.pad(mask, 1))[1:-1, 1:-1]


@pytest.mark.parametrize("side", [2, 5, 64])
def test_parts_are_those_of_the_whole(spark, side):
    masks = masks_of(side)
    got = {}
    for r in parts.label_parts(cells_of(spark, masks), side).collect():
        got.setdefault((r["slide"], r["part"]), set()).add((r["my"], r["mx"]))
    want = set()
    for s, m in masks.items():
        labels, firsts = raster.label_parts(m)
        want |= {(s, frozenset(zip(*(v.tolist() for v in np.nonzero(labels == n)), strict=True))) for n in range(1, len(firsts) + 1)}
    assert {(s, frozenset(c)) for (s, _), c in got.items()} == want and len(got) == len(want)


@pytest.mark.parametrize(("side", "shift"), [(3, 0), (5, -11), (64, 100)])
def test_holes_are_those_of_the_whole(spark, side, shift):
    masks = masks_of(side)
    got = {(r["slide"], r["my"], r["mx"]) for r in parts.fill_holes(cells_of(spark, masks, shift), side).collect()}
    assert got == {(s, int(y) + shift, int(x) + shift) for s, m in masks.items() for y, x in zip(*np.nonzero(filled(m)), strict=True)}


@pytest.mark.parametrize("side", [2, 5, 64])
def test_contours_are_those_of_the_whole(spark, side):
    masks = masks_of(side + 1)
    got = {}
    for r in parts.trace_contours(cells_of(spark, masks), side).collect():
        got[r["slide"], r["contour_id"]] = [(int(p["x"]), int(p["y"])) for p in r["contour"]]
    want = {(s, n): c for s, m in masks.items() for n, c in enumerate(raster.trace_contours(m))}
    assert got == want


def test_no_cells(spark):
    none = spark.createDataFrame([], CELLS)
    assert parts.label_parts(none, 4).count() == parts.fill_holes(none, 4).count() == parts.trace_contours(none, 4).count() == 0


def test_chains_and_cycles_are_ordered():
    # 3 -> 1 -> 4, a cycle 0 -> 5 -> 2 -> 0, and 6 alone
    order = parts._ranked(np.array([5, 4, 0, 1, -1, 2, -1])).tolist()
    joined = "".join(map(str, order))
    assert all(piece in joined for piece in ("314", "052", "6")) and len(order) == 7
