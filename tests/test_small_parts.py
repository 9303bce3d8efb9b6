import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.config import GridConfig
from tilewright.functions import udtf
from tilewright.operators import area, grid, jobs, raster
from tilewright.plans import registry
from tilewright.schemas import TASK, TILE_DATA
from tilewright.sources import metadata, tiff
from tilewright.streaming import micro


def test_table_function_is_the_grid(spark):
    udtf.register(spark)
    got = {tuple(r) for r in spark.sql("SELECT * FROM tile_grid(960, 700, 512, 32)").collect()}
    box = spark.createDataFrame([("s", "/s", 0, 0, 960, 700)], "stem string, wsi_path string, x0 int, y0 int, w int, h int")
    assert got == {tuple(r) for r in grid.tile_grid(box, GridConfig()).select("row", "col", "x", "y", "width", "height").collect()}


def test_metadata_comes_back(spark, tmp_path):
    rows = spark.createDataFrame([("t1", "process", "SUCCESS", 3, 4, 100.0, None, 7)], TASK)
    metadata.write_metadata(rows.withColumn("more", F.lit(1)), str(tmp_path / "m"))
    assert metadata.read_metadata(spark, str(tmp_path / "m")).collect() == rows.collect()
    assert rows.select(jobs.state_name().alias("s")).first()["s"] == "completed"


@pytest.mark.parametrize("size", [2, 3, 9])
def test_center_crop(spark, size):
    image = np.arange(5 * 7).reshape(5, 7)
    pixels = spark.createDataFrame([("a", y, x, int(image[y, x])) for y in range(5) for x in range(7)], "image string, y int, x int, v int")
    got = raster.center_crop(pixels, spark.createDataFrame([("a", 5, 7)], "image string, h int, w int"), size)
    top, left = max(0, (5 - size) // 2), max(0, (7 - size) // 2)
    part = image[top : top + size, left : left + size]
    assert {(r["y"], r["x"]): r["v"] for r in got.collect()} == {(y, x): int(part[y, x]) for y in range(part.shape[0]) for x in range(part.shape[1])}


def test_stream_equals_batch_and_reports(spark, tmp_path):
    rows = [(f"t{i}", "/s", 0, 0, 2, 2, 0, 0, i, 1, 9, bytes([i]) * 12, [2, 2, 3], "uint8") for i in range(9)]
    tiles = spark.createDataFrame(rows, TILE_DATA).withColumn("h", F.lit(2)).withColumn("w", F.lit(2))
    tiles.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = micro.tile_stream(spark, str(tmp_path / "in"), tiles.schema, 1)
    seen, errors = [], []

    def done(batch, number):
        seen.extend((r["tile_id"], r["h"], len(r["data"])) for r in batch.collect())
        if number == 1:
            raise RuntimeError("late")

    query = micro.with_callback(micro.infer(stream, micro.upsample(2)), done, lambda e, n: errors.append(n)).trigger(availableNow=True).start()
    assert micro.wait_all(query, 60)
    assert sorted(seen) == sorted((r["tile_id"], 4, 48) for r in micro.infer(tiles, micro.upsample(2)).collect()) and errors == [1]


def test_slide_file_tiles_in_a_session_without_sources(spark, sf_dir):
    plain, sessions = spark.newSession(), spark._jvm.org.apache.spark.sql.classic.SparkSession
    sessions.setActiveSession(plain._jsparkSession)
    try:
        assert registry.QUERIES["slide_file_tiles"](plain, sf_dir).count() == plain.read.parquet(f"{sf_dir}/part.parquet").count()
    finally:
        sessions.setActiveSession(spark._jsparkSession)


def test_slide_file_tiles_are_spread_and_no_keys_are_broadcast(spark, sf_dir, monkeypatch):
    seen, write = [], tiff.write_pyramid
    monkeypatch.setattr(tiff, "write_pyramid", lambda tiles, *rest, **named: seen.append(tiles) or write(tiles, *rest, **named))
    found = registry.QUERIES["slide_file_tiles"](spark, sf_dir)
    found.collect()
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().toString() and "RoundRobinPartitioning" in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_padding_broadcasts_no_pixels(spark, sf_dir):
    padded = registry.QUERIES["pad_tile"](spark, sf_dir)
    padded.collect()
    assert "BroadcastHashJoin" not in padded._jdf.queryExecution().toString()


def test_small_tables_are_spread_and_polygons_made_once(spark, sf_dir):
    for name in ("abnormal_summary", "feature_records", "jpeg_images"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "RoundRobinPartitioning" in plan and plan.count("COS(") <= 1


def test_tissue_tiles_meet_blocks_without_the_whole_masks_sums(spark):
    rng = np.random.default_rng(7)
    mask = (rng.random((70, 50)) < 0.4).astype(np.uint8)
    blocks = [("s", r, c, *mask[r * 16 : r * 16 + 16, c * 16 : c * 16 + 16].shape, mask[r * 16 : r * 16 + 16, c * 16 : c * 16 + 16].tobytes()) for r in range(5) for c in range(4)]
    blocks = spark.createDataFrame([(*b[:5], bytearray(b[5])) for b in blocks], "slide string, block_row int, block_col int, h int, w int, mask binary")
    for most in (9, 60):  # tiles of a block's size at most, and greater ones too
        tiles = [("s", str(i), int(rng.integers(-8, 75)), int(rng.integers(-8, 55)), int(rng.integers(1, most)), int(rng.integers(1, most))) for i in range(200)]
        df = spark.createDataFrame(tiles, "wsi_path string, tile_id string, y int, x int, height int, width int")
        found = area.tissue_tiles(df, blocks, (16, 16), 1, 0.1)
        want = {}
        for _, i, y, x, h, w in tiles:
            part = mask[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)]
            if part.size and part.mean() > 0.1:
                want[i] = part.mean()
        got = {r["tile_id"]: r["tissue_ratio"] for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
        assert ("row_sums_before" in found._jdf.queryExecution().analyzed().toString()) == (most == 60)
