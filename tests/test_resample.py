"""Images and slides at fractional sizes."""

import numpy as np
import pytest
from test_files import picture, tiles_of

from tilewright.operators import resample
from tilewright.sources import tiff


def put_together(tiles, h, w, tile):
    out = np.zeros((h, w, 3), np.uint8)
    for r in tiles.collect():
        out[r["row"] * tile : r["row"] * tile + r["h"], r["col"] * tile : r["col"] * tile + r["w"]] = np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"], 3)
    return out


@pytest.mark.parametrize("kind", resample.KINDS)
@pytest.mark.parametrize("size", [(1, 1), (7, 50), (40, 31), (90, 65), (33, 33)])
def test_constants_stay(kind, size):
    image = np.full((33, 41, 3), 201, np.uint8)
    assert (resample.resized(image, *size, kind) == 201).all()


def test_cubic_is_exact_on_a_slope_and_the_same_size():
    _, weights = resample.axis_weights(50, 120, 0, 120)
    got, want = weights @ np.arange(50.0), (np.arange(120) + 0.5) * 50 / 120 - 0.5
    inside = (want > 1) & (want < 48)
    assert inside.sum() > 90 and np.allclose(got[inside], want[inside])
    image = picture(20, 30)
    assert (resample.resized(image, 20, 30) == image).all()


def test_area_by_whole_factors_is_the_block_mean():
    image = picture(24, 36)
    want = image.reshape(8, 3, 9, 4, 3).astype(float).mean(axis=(1, 3)).round(6)
    assert np.abs(resample.resized(image, 8, 9, "area") - want).max() <= 0.5


def test_an_unknown_kernel_is_refused():
    with pytest.raises(ValueError):
        resample.axis_weights(4, 2, 0, 2, "nearest")


def test_rows_equal_the_array_form(spark):
    image = picture(24, 36)
    rows = [("s", y, x, *(int(v) for v in image[y, x])) for y in range(24) for x in range(36)]
    df = spark.createDataFrame(rows, "slide string, y int, x int, r int, g int, b int")
    out = resample.area_means(df, (24, 36), (11, 50)).collect()
    got = np.zeros((11, 50, 3))
    for r in out:
        got[r["y"], r["x"]] = r["r"], r["g"], r["b"]
    assert len(out) == 550
    _, down = resample.axis_weights(24, 11, 0, 11, "area")
    _, across = resample.axis_weights(36, 50, 0, 50, "area")
    assert np.allclose(got, np.einsum("oh,hwc,pw->opc", down, image.astype(float), across))


def test_rows_that_are_missing_or_null(spark):
    df = spark.createDataFrame([("s", 0, 0, 10), ("s", 0, 1, None), ("s", 3, 3, 8), (None, 0, 0, 4)], "slide string, y int, x int, v int")
    got = {(r["slide"], r["y"], r["x"]): r["v"] for r in resample.area_means(df, (4, 4), (2, 2), channels=("v",)).collect()}
    assert got == {("s", 0, 0): 10.0, ("s", 1, 1): 8.0, (None, 0, 0): 4.0}
    assert resample.area_means(df.limit(0), (4, 4), (2, 2), channels=("v",)).count() == 0


@pytest.mark.parametrize("kind", resample.KINDS)
def test_tiles_of_a_slide_equal_the_whole(spark, tmp_path, kind):
    image, path = picture(150, 211), str(tmp_path / "s.tiff")
    tiff.write_pyramid(tiles_of(spark, image, 32), path, 211, 150, 32, levels=2, mpp=(0.25, 0.25))
    for h, w in ((101, 140), (170, 260)):  # between the levels, and above level 0
        assert (put_together(resample.scaled_slide(spark, path, h, w, 48, kind), h, w, 48) == resample.resized(image, h, w, kind)).all()
    half = tiff.read_region(path, 0, 0, 106, 75, 1)
    assert (put_together(resample.scaled_slide(spark, path, 60, 80, 48, kind), 60, 80, 48) == resample.resized(half, 60, 80, kind)).all()
    tiles, size = resample.slide_at(spark, path, 0.4, 64, kind)
    assert size == (94, 132) and (put_together(tiles, *size, 64) == resample.resized(image, *size, kind)).all()


def test_a_slide_without_resolution_is_an_error(spark, tmp_path):
    path = str(tmp_path / "n.tiff")
    tiff.write_pyramid(tiles_of(spark, picture(20, 20), 16), path, 20, 20, 16)
    with pytest.raises(ValueError):
        resample.slide_at(spark, path, 0.5)
