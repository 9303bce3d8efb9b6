import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.config import BlendConfig, EngineConfig, GridConfig, ScreenConfig, StoreConfig
from tilewright.operators import blend, detect, grid, metrics, raster, report, search, tissue
from tilewright.plans import api, pipeline
from tilewright.sources import slides
from tilewright.sources.store import FeatureStore


def test_grid_stays_in_the_box(spark):
    box = spark.createDataFrame([("s", "/s.svs", 10, 20, 960, 700)], "stem string, wsi_path string, x0 int, y0 int, w int, h int")
    tiles = grid.tile_grid(box).collect()
    assert len(tiles) == 4 and tiles[0]["tile_id"] == "s_r0000_c0000"
    assert all(t["x"] >= 10 and t["x"] + t["width"] <= 970 and t["y"] + t["height"] <= 720 for t in tiles)
    assert max(t["x"] + t["width"] for t in tiles) == 10 + 928  # the plain count leaves an edge out
    assert max(t["x"] + t["width"] for t in grid.tile_grid(box, cover=True).collect()) == 970
    with pytest.raises(ValueError, match="no step"):
        grid.tile_grid(box, GridConfig(64, 32))


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_reflection_equals_numpy(spark, n):
    got = [r[0] for r in spark.range(20).select(grid.reflect_index(F.col("id"), F.lit(n)).alias("i")).collect()]
    assert got == np.pad(np.arange(n), (0, 20 - n), mode="reflect" if n > 1 else "edge").tolist()


def boxes(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    x, y, w, h = rng.integers(0, 300, n), rng.integers(0, 300, n), rng.integers(5, 80, n), rng.integers(5, 80, n)
    rows = [("a" if i % 3 else "b", i, float(s), float(x[i]), float(y[i]), float(x[i] + w[i]), float(y[i] + h[i])) for i, s in enumerate(np.round(rng.random(n), 1))]
    return rows, spark.createDataFrame(rows, "wsi_name string, instance_id int, score double, x1 double, y1 double, x2 double, y2 double")


def greedy(rows, threshold):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[2], r[1])):
        for k in kept:
            if k[0] == r[0]:
                w, h = min(k[5], r[5]) - max(k[3], r[3]), min(k[6], r[6]) - max(k[4], r[4])
                inter = max(w, 0) * max(h, 0)
                if inter / ((k[5] - k[3]) * (k[6] - k[4]) + (r[5] - r[3]) * (r[6] - r[4]) - inter) > threshold:
                    break
        else:
            kept.append(r)
    return {r[1] for r in kept}


@pytest.mark.parametrize("threshold", [0.1, 0.5])
def test_nms_equals_greedy_and_keeps_what_it_kept(spark, threshold):
    rows, df = boxes(spark)
    kept = detect.nms(df, threshold)
    assert {r["instance_id"] for r in kept.collect()} == greedy(rows, threshold)
    assert {r["instance_id"] for r in detect.nms_by_rounds(df, threshold).collect()} == greedy(rows, threshold)
    assert detect.nms(kept, threshold).count() == kept.count()


def test_boxes_without_area_are_suppressed(spark):
    df = spark.createDataFrame([("a", i, 0.5, 1.0, 1.0, 1.0, 1.0) for i in range(3)], "wsi_name string, instance_id int, score double, x1 double, y1 double, x2 double, y2 double")
    assert [r["instance_id"] for r in detect.nms(df).collect()] == [0]


def test_iou_pairs_equal_all_pairs(spark):
    rows, df = boxes(spark, 120)
    want = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and min(a[5], b[5]) > max(a[3], b[3]) and min(a[6], b[6]) > max(a[4], b[4]):
                want.add((a[1], b[1]))
    assert {(r["id_a"], r["id_b"]) for r in detect.iou_pairs(df).collect()} == want


def test_blend_of_a_constant_is_that_constant(spark):
    tiles = spark.createDataFrame([("s", r, c, 64, 64, bytes([128]) * (64 * 64 * 3)) for r in range(2) for c in range(2)], "slide string, row int, col int, h int, w int, data binary")
    out = blend.blend_blocks(grid.tile_block_map(tiles, 64, 64, 48), 64, 64, 48, 8, 16.0).collect()
    image = {(r["block_row"], r["block_col"]): np.frombuffer(r["data"], np.uint8).reshape(64, 64, 3) for r in out}
    assert len(image) == 4
    inner = image[0, 0][1:, 1:]
    assert ((inner == 128) | (inner == 127)).all()
    assert (image[1, 1][48:, 48:] == 0).all()


def test_pixel_and_strip_forms_agree(spark):
    rng = np.random.default_rng(1)
    rows = [("s", int(rng.integers(40)), int(rng.integers(8)), float(rng.random() * 300), float(rng.random())) for _ in range(2000)]
    df = spark.createDataFrame(rows, "slide string, y int, x int, v double, w double")
    whole = {(r["y"], r["x"]): r["pixel"] for r in blend.weighted_blend(df, ("slide", "y", "x")).collect()}
    assert whole == {(r["y"], r["x"]): r["pixel"] for r in blend.strip_blend(df, 16).collect()}
    assert max(whole.values()) <= 255


def test_kernel_is_the_columns_form(spark):
    at = spark.createDataFrame([(y, x) for y in range(16) for x in range(16)], "y int, x int")
    got = np.zeros((16, 16))
    for r in blend.blend_kernel(at, 16, 4, 5.0).collect():
        got[r["y"], r["x"]] = r["weight"]
    assert np.allclose(got, blend.kernel(16, 4, 5.0)) and got.max() == pytest.approx(1) and (got[0] == 0).all()


def erode(m):
    p = np.pad(m, 1)
    return p[1:-1, 1:-1] & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]


def dilate(m):
    p = np.pad(m, 1)
    return p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]


def as_cells(spark, mask):
    return spark.createDataFrame([("s", int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)], "slide string, my int, mx int")


def test_opening_and_filling_equal_arrays(spark):
    mask = np.random.default_rng(4).random((30, 30)) < 0.85
    opened = dilate(dilate(erode(erode(mask))))
    assert {(r["my"], r["mx"]) for r in tissue.binary_opening(as_cells(spark, mask)).collect()} == set(zip(*(x.tolist() for x in np.nonzero(opened)), strict=True))
    frame = np.zeros((9, 9), bool)
    frame[2:7, 2:7] = True
    frame[3:6, 3:6] = False
    filled = tissue.fill_holes(as_cells(spark, frame)).count()
    assert filled == 25


def test_contours_of_simple_masks():
    mask = np.zeros((12, 12), bool)
    mask[2:6, 3:9] = True
    mask[8, 8] = True
    found = raster.trace_contours(mask)
    assert found[0] == [(3, 2), (8, 2), (8, 5), (3, 5)] and found[1] == [(8, 8)]


def test_adaptive_normalisation_and_psnr(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 1.0), ("b", 51.0)], "image string, v double")
    assert sorted(r["v"] for r in raster.normalize_adaptive(df, ("image",)).collect()) == [0.2, 0.5, 1.0]
    errors = spark.createDataFrame([(0, 0, 0, 0.0), (1, 0, 0, 0.01)], "epoch int, batch int, image int, squared_error double")
    values = {r["epoch"]: r["psnr"] for r in metrics.psnr(errors).collect()}
    assert values[0] == float("inf") and values[1] == pytest.approx(20)


def test_ivf_reaches_most_of_the_exact_top(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "record_id long, feature_vector array<double>")
    query = rng.normal(size=16).tolist()
    exact = {r["record_id"] for r in search.search_similar(df, query).collect()}
    centres = search.coarse_centroids(df, 16)
    near = {r["record_id"] for r in search.search_lists(search.index_lists(df, centres), centres, query, 12).collect()}
    assert len(exact & near) >= 16
    assert {r["record_id"] for r in search.search_lists(search.index_lists(df, centres), centres, query, 16).collect()} == exact


def test_registered_ivf_query_has_the_recall(spark, sf_dir):
    from tilewright.plans import proxies, registry

    v = proxies.vectors(spark, sf_dir)
    rows = {r["record_id"]: r["feature_vector"] for r in v.collect()}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for r in registry.QUERIES["ann_ivf"](spark, sf_dir).collect():
        found.setdefault(r["query_id"], {})[r["record_id"]] = r["distance"]
    assert found.keys() == {i for i in rows if i % 20 == 0}
    exact = {q: {int(i) for i in ids[np.lexsort((ids, -(x @ x[ids == q][0])))[:20]]} for q in found}
    one = min(found)
    assert {r["record_id"] for r in search.search_similar(v, rows[one]).collect()} == exact[one]
    assert all(len(near) == 20 for near in found.values())
    assert np.mean([len(exact[q] & found[q].keys()) / 20 for q in found]) >= 0.9


def test_many_queries_as_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 60)
    rng = np.random.default_rng(3)
    rows = [(i, "s", rng.normal(size=8).tolist()) for i in range(300)] + [(300 + i, "s", [1.0] * 8) for i in range(150)] + [(450, "s", [0.0] * 8)]
    df = spark.createDataFrame(rows, "record_id long, wsi_name string, feature_vector array<double>")
    centres = search.coarse_centroids(df, 6)
    indexed = search.index_lists(df, centres)
    got = {}
    for r in search.search_lists_each(indexed, centres, df.filter("record_id % 150 = 0"), 3, 7).collect():
        got.setdefault(r["query_id"], {})[r["record_id"]] = r["distance"]
    assert got.keys() == {0, 150, 300, 450}
    for q, near in got.items():
        want = {r["record_id"]: r["distance"] for r in search.search_lists(indexed, centres, rows[q][2], 3, 7).collect()}
        assert near == pytest.approx(want)


def screen_tile(spark):
    image = np.full((400, 400, 3), 255, np.uint8)
    y, x = np.mgrid[:400, :400]
    image[(y - 120) ** 2 + (x - 120) ** 2 < 50**2] = 0
    image[((y - 310) / 8.0) ** 2 + ((x - 200) / 150.0) ** 2 < 1] = 0
    return spark.createDataFrame([("w", 0, 0, 1000, 2000, 400, 400, image.tobytes())], "wsi_name string, tile_row int, tile_col int, off_x int, off_y int, h int, w int, data binary")


def test_screen_finds_and_scores_objects(spark, tmp_path):
    engine = api.Engine(spark, str(tmp_path), str(tmp_path / "log"), str(tmp_path / "store"))
    found = engine.screen(screen_tile(spark), "t1", dedup=True).cache()
    disc, bar = sorted(found.collect(), key=lambda r: r["centroid"]["y"])
    assert disc["circularity"] > 0.85 and not disc["is_abnormal"] and disc["centroid"]["x"] == pytest.approx(1120, abs=1)
    assert bar["aspect_ratio"] > 3 and any(r.startswith("high_aspect_ratio") for r in bar["abnormality_reasons"])
    assert engine.screening_results(found).first()["total_nuclei"] == 2
    assert engine.query_abnormal(min_score=0.0).count() == found.filter("is_abnormal").count()


def test_process_slide_upscales(spark):
    config = EngineConfig(grid=GridConfig(32, 4, 2), blend=BlendConfig(sigma=16.0))
    tiles = spark.createDataFrame([("s", 0, c, 32, 32, bytes([90]) * (32 * 32 * 3)) for c in range(2)], "slide string, row int, col int, h int, w int, data binary")
    out = pipeline.process_slide(tiles, config=config, block=64).collect()
    assert {(r["block_row"], r["block_col"]) for r in out} == {(0, 0), (0, 1)}


def test_store_checks_what_it_takes(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "s"), StoreConfig())
    store.create()
    store.create()
    found = pipeline.describe(pipeline.detect_objects(screen_tile(spark), config=EngineConfig(screen=ScreenConfig())))
    records = report.feature_records(found.withColumn("task_id", F.lit("t")))
    assert store.insert(records) == 2 and store.records().count() == 2
    assert store.insert(records.limit(0)) == 0
    with pytest.raises(ValueError, match="do not fit"):
        store.insert(records.withColumn("wsi_name", F.repeat(F.lit("x"), 300)))
    with pytest.raises(ValueError, match="do not fit"):
        store.insert(records.withColumn("feature_vector", F.array(F.lit(1.0).cast("float"))))
    hit = store.search_similar(records.first()["feature_vector"], 1).first()
    assert hit["distance"] == pytest.approx(1, abs=1e-6)
    assert store.query_abnormal(0.0, wsi_name='w" || true').count() == 0
    spark.range(1).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="other columns"):
        FeatureStore(spark, str(tmp_path / "other")).create()


def test_sources(spark, tmp_path):
    spark.dataSource.register(slides.TileSource)
    tiles = spark.read.format("tiles").option("height", 100).option("width", 70).option("tile", 32).load()
    assert tiles.count() == 12 and tiles.agg(F.sum(F.length("data"))).first()[0] == 100 * 70 * 3
    with pytest.raises(FileNotFoundError):
        slides.list_images(spark, str(tmp_path))
    (tmp_path / "in").mkdir()
    for name in ("b.png", "a.jpg", "c.txt"):
        (tmp_path / "in" / name).write_bytes(b"x")
    assert [r["path"][-5:] for r in slides.list_images(spark, str(tmp_path)).collect()] == ["a.jpg", "b.png"]
    image = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    assert (slides.decode_ppm(b"P6 # c\n3 2\n255\n" + image.tobytes()) == image).all()
    data = slides.write_tiff(image, 16, "d")
    assert data[:4] == b"II*\0" and len(data) > 16 * 16 * 3
    with pytest.raises(ValueError, match="channels"):
        slides.write_tiff(np.zeros((2, 2, 7), np.uint8))
    assert slides.image_metadata(1, 1, 4)["channels"] == ["Red", "Green", "Blue", "Channel3"]
