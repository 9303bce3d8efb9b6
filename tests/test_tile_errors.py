"""One bad tile costs one row."""

import numpy as np
import pytest

from tilewright.streaming import micro

TILE = "tile_id int, h int, w int, data binary"


@pytest.fixture
def picky():
    """A model that refuses stacks with a tile that is white."""

    def model(images):
        if (images == 255).all(axis=(1, 2, 3)).any():
            raise RuntimeError("white tile")
        return images.repeat(2, axis=1)

    return model


def tiles(spark, n=1000, bad=(517,)):
    rows = [(i, 2 + i % 2, 3, (b"\xff" if i in bad else bytes([i % 250])) * (3 * (2 + i % 2) * 3)) for i in range(n)]
    return spark.createDataFrame(rows, TILE).repartition(4)


def test_one_bad_tile_of_a_thousand(spark, picky):
    got = {r["tile_id"]: r for r in micro.infer(tiles(spark), picky, errors=True).collect()}
    assert len(got) == 1000 and [i for i, r in got.items() if r["error"]] == [517]
    assert got[517]["data"] is None and got[517]["error"] == "RuntimeError: white tile"
    assert all(r["h"] == 2 * (2 + i % 2) and bytes(r["data"]) == bytes([i % 250]) * (r["h"] * 9) for i, r in got.items() if i != 517)
    with pytest.raises(Exception, match="white tile"):
        micro.infer(tiles(spark), picky).collect()


def test_tiles_that_are_not_what_they_say(spark):
    odd = spark.createDataFrame([(0, 2, 2, bytes(12)), (1, 2, 2, bytes(5)), (2, None, 2, None), (3, 2, 2, bytes(12))], TILE).coalesce(1)
    got = {r["tile_id"]: r["error"] for r in micro.infer(odd, lambda x: x, errors=True).collect()}
    assert got[0] is None and got[3] is None and "size" in got[1] and "size" in got[2]


def test_wrong_numbers_of_outputs_are_errors(spark):
    got = micro.infer(tiles(spark, 20, ()), lambda x: np.zeros((0, 1, 1, 3), np.uint8), errors=True).collect()
    assert all("0 outputs of 1 tiles" in r["error"] for r in got)


def test_callbacks_get_their_own_tiles(spark, picky, tmp_path):
    tiles(spark, 60, (7, 33)).write.parquet(str(tmp_path / "in"))
    stream = micro.tile_stream(spark, str(tmp_path / "in"), tiles(spark, 1).schema)
    good, bad = [], []
    query = micro.with_tile_callbacks(micro.infer(stream, picky, errors=True), lambda d, n: good.extend(r["tile_id"] for r in d.collect()), lambda d, n: bad.extend((r["tile_id"], r["error"]) for r in d.collect()))
    assert micro.wait_all(query.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start())
    assert sorted(good) == [i for i in range(60) if i not in (7, 33)] and sorted(bad) == [(7, "RuntimeError: white tile"), (33, "RuntimeError: white tile")]
