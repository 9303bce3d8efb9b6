"""Files of slides and images: what is written is read back, region by region and tile by tile."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.config import BlendConfig, EngineConfig, GridConfig, StoreConfig
from tilewright.operators import raster
from tilewright.plans import api, pipeline
from tilewright.schemas import NUCLEUS_RECORD
from tilewright.sources import slides, tiff
from tilewright.sources.store import FeatureStore


def picture(h, w, seed=0):
    """Smooth colours with noise, so that neither compression nor prediction is trivial."""
    y, x = np.mgrid[:h, :w]
    noise = np.random.default_rng(seed).integers(0, 9, (h, w, 3))
    return (np.stack([y, x, (x + y) // 2], axis=2) % 240 + noise).astype(np.uint8)


def tiles_of(spark, image, tile):
    h, w = image.shape[:2]
    rows = []
    for r in range(-(-h // tile)):
        for c in range(-(-w // tile)):
            part = np.ascontiguousarray(image[r * tile : (r + 1) * tile, c * tile : (c + 1) * tile])
            rows.append((r, c, part.shape[0], part.shape[1], part.tobytes()))
    return spark.createDataFrame(rows, "row int, col int, h int, w int, data binary")


def whole(spark, path, level=0):
    rows = spark.read.format("slide").option("level", str(level)).load(path).collect()
    out = np.zeros((max(r["y"] + r["h"] for r in rows), max(r["x"] + r["w"] for r in rows), 3), np.uint8)
    for r in rows:
        out[r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]] = np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"], 3)
    return out


def test_a_pyramid_is_read_as_written(spark, tmp_path):
    image, path = picture(150, 211), str(tmp_path / "a.ome.tiff")
    size = tiff.write_pyramid(tiles_of(spark, image, 32), path, 211, 150, 32, levels=3, mpp=(0.25, 0.5))
    assert size == (tmp_path / "a.ome.tiff").stat().st_size
    levels = tiff.read_levels(path)
    assert [(x.w, x.h) for x in levels] == [(211, 150), (106, 75), (53, 38)] and levels[0].mpp == pytest.approx((0.25, 0.5))
    assert 'SizeX="211"' in levels[0].description and "µm" in levels[0].description
    assert (whole(spark, path) == image).all()
    half = np.pad(image, ((0, 0), (0, 1), (0, 0)), mode="edge").reshape(75, 2, 106, 2, 3).mean(axis=(1, 3))
    assert np.abs(whole(spark, path, 1) - half).max() <= 0.5
    info = tiff.slide_info(spark.createDataFrame([(path,)], "path string")).orderBy("level").collect()
    assert [(r["w"], r["level_count"]) for r in info] == [(211, 3), (106, 3), (53, 3)] and info[1]["downsample"] == pytest.approx(211 / 106)


def test_regions_reach_over_tiles_and_edges(spark, tmp_path):
    image, path = picture(100, 90), str(tmp_path / "r.tiff")
    tiff.write_pyramid(tiles_of(spark, image, 16), path, 90, 100, 16)
    for x, y, w, h in ((0, 0, 90, 100), (5, 17, 40, 50), (80, 90, 30, 30), (-6, -3, 20, 20), (200, 5, 4, 4)):
        want = np.zeros((h, w, 3), np.uint8)
        part = image[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)]
        want[max(-y, 0) : max(-y, 0) + part.shape[0], max(-x, 0) : max(-x, 0) + part.shape[1]] = part
        assert (tiff.read_region(path, x, y, w, h) == want).all()


def lzw(data):
    """Codes from 9 bits, widened when the next entry would not fit, most significant bit first."""
    table, out, width, word = {bytes([i]): i for i in range(256)}, [(256, 9)], 9, b""
    for byte in data:
        if word + bytes([byte]) in table:
            word += bytes([byte])
            continue
        out.append((table[word], width))
        table[word + bytes([byte])] = len(table) + 2
        word = bytes([byte])
        entries = len(table) + 2
        if entries >= 4094:
            out.append((256, width))
            table, width = {bytes([i]): i for i in range(256)}, 9
        else:
            width = max(9, entries.bit_length())
    out.append((table[word], width))
    out.append((257, max(9, (len(table) + 3).bit_length())))
    bits = "".join(f"{c:0{w}b}" for c, w in out)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def packbits(data):
    return b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128))


def strips(image, compression, predictor, order="<", rows=7):
    """A classic TIFF in strips."""
    h, w, c = image.shape
    source = np.diff(image, axis=1, prepend=np.zeros((h, 1, c), np.uint8)).astype(np.uint8) if predictor == 2 else image
    pack = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}[compression]
    parts = [pack(source[y : y + rows].tobytes()) for y in range(0, h, rows)]
    n, start = len(parts), 8
    offsets = [start + sum(map(len, parts[:i])) for i in range(n)]
    at = start + sum(map(len, parts))
    lists = struct.pack(f"{order}{n}I", *offsets) + struct.pack(f"{order}{n}I", *map(len, parts)) + struct.pack(f"{order}3H", 8, 8, 8)
    fields = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 3, at + 8 * n), (259, 3, 1, compression), (262, 3, 1, 2), (273, 4, n, at if n > 1 else offsets[0]), (277, 3, 1, c), (278, 4, 1, rows), (279, 4, n, at + 4 * n if n > 1 else len(parts[0])), (317, 3, 1, predictor)]
    entries = b"".join(struct.pack(f"{order}HHI", t, k, m) + (struct.pack(f"{order}HH", v, 0) if k == 3 and m == 1 else struct.pack(f"{order}I", v)) for t, k, m, v in fields)
    head = struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, at + len(lists))
    return head + b"".join(parts) + lists + struct.pack(f"{order}H", len(fields)) + entries + struct.pack(f"{order}I", 0)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize("predictor", [1, 2])
def test_strips_of_every_compression(tmp_path, order, compression, predictor):
    image, path = picture(60, 47, 3), tmp_path / "s.tif"
    path.write_bytes(strips(image, compression, predictor, order))
    assert (tiff.read_region(str(path), 0, 0, 47, 60) == image).all()


def test_lzw_tables_start_anew(tmp_path):
    image, path = np.random.default_rng(5).integers(0, 256, (90, 90, 3), np.uint8), tmp_path / "l.tif"
    path.write_bytes(strips(image, 5, 1, rows=90))
    assert (tiff.read_region(str(path), 0, 0, 90, 90) == image).all()


def test_what_is_no_slide_is_refused(tmp_path):
    with pytest.raises(FileNotFoundError):
        tiff.read_levels(str(tmp_path / "none.tiff"))
    (tmp_path / "text.tiff").write_bytes(b"not an image at all")
    with pytest.raises(ValueError, match="not a TIFF"):
        tiff.read_levels(str(tmp_path / "text.tiff"))


def test_tiles_of_the_plain_writer_are_read(tmp_path):
    image = picture(50, 70)
    (tmp_path / "p.tiff").write_bytes(slides.write_tiff(image, 16, "d"))
    assert (tiff.read_region(str(tmp_path / "p.tiff"), 0, 0, 70, 50) == image).all()


def png(image, colour, filters, palette=None):
    h, w = image.shape[:2]
    flat, body = image.reshape(h, w, -1).astype(int), b""
    for y in range(h):
        f = filters[y % len(filters)]
        left = np.pad(flat[y], ((1, 0), (0, 0)))[:-1]
        up = flat[y - 1] if y else np.zeros_like(flat[y])
        corner = np.pad(up, ((1, 0), (0, 0)))[:-1]
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0 * left, left, up, (left + up) // 2, near][f]
        body += bytes([f]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("filters", [[0], [1], [2], [3], [4], [0, 4, 3, 2, 1]])
def test_png_of_every_filter(spark, tmp_path, filters):
    image = picture(20, 33, 7)
    alpha = np.concatenate([image, image[:, :, :1]], axis=2)
    assert (slides.decode(png(image, 2, filters)) == image).all()
    assert (slides.decode(png(alpha, 6, filters)) == image).all()
    assert (slides.decode(png(image[:, :, 0], 0, filters)) == image[:, :, :1]).all()
    palette = np.random.default_rng(1).integers(0, 256, (256, 3), np.uint8)
    assert (slides.decode(png(image[:, :, 0], 3, filters, palette)) == palette[image[:, :, 0]]).all()


def test_images_are_decoded_in_tasks(spark, tmp_path):
    image = picture(9, 12)
    (tmp_path / "b.png").write_bytes(png(image, 2, [4]))
    found = spark.read.format("binaryFile").load(str(tmp_path)).select(slides.decode_image("content").alias("i")).first()["i"]
    assert (found["h"], found["w"], bytes(found["data"])) == (9, 12, image.tobytes())


def test_random_cuts_repeat_by_seed(spark):
    image = picture(40, 50)
    df = spark.createDataFrame([(f"p{i}", 40, 50, image.tobytes()) for i in range(12)] + [("small", 5, 7, picture(5, 7).tobytes())], "path string, h int, w int, data binary")
    first, again, other = ({r["path"]: bytes(r["data"]) for r in raster.augmented(df, 16, seed).collect()} for seed in (1, 1, 2))
    assert first == again != other and len(set(first.values())) > 8 and {len(x) for x in first.values()} == {16 * 16 * 3}
    cuts = {np.ascontiguousarray(part).tobytes() for y in range(25) for x in range(35) for one in [image[y : y + 16, x : x + 16]] for part in (one, one[::-1], one[:, ::-1], one[::-1, ::-1])}
    assert all(data in cuts for path, data in first.items() if path != "small")


def test_a_slide_goes_from_upload_to_pyramid(spark, tmp_path):
    """Plain tissue on white: upscaled by repeating pixels and blended, it is itself."""
    image = np.full((200, 260, 3), 255, np.uint8)
    image[20:150, 30:220] = (90, 120, 60)
    (tmp_path / "in").mkdir()
    tiff.write_pyramid(tiles_of(spark, image, 32), str(tmp_path / "in" / "case.tiff"), 260, 200, 32, levels=2, mpp=(0.5, 0.5))
    config = EngineConfig(grid=GridConfig(64, 8, 2, min_tissue=0.0), blend=BlendConfig(sigma=32.0))
    engine = api.Engine(spark, str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "store"), config)
    target = str(tmp_path / "case_super_resolved.ome.tiff")
    engine.export_slide("case", target, block=64, levels=2)
    out = tiff.read_levels(target)
    assert [(x.w, x.h) for x in out] == [(520, 400), (260, 200)] and out[0].mpp == pytest.approx((0.25, 0.25))
    made = tiff.read_region(target, 0, 0, 520, 400)
    want = np.repeat(np.repeat(image, 2, axis=0), 2, axis=1)
    inside = np.zeros((400, 520), bool)
    inside[40:300, 60:440] = True
    assert np.abs(made[inside].astype(int) - want[inside]).max() <= 1
    assert engine.process_slide("case", block=64).count() > 0
    plain, sessions = spark.newSession(), spark._jvm.org.apache.spark.sql.classic.SparkSession
    with pytest.raises(Exception, match="DATA_SOURCE_NOT_FOUND"):  # nothing is registered in it
        plain.read.format("slide").load(target)
    sessions.setActiveSession(plain._jsparkSession)
    try:
        assert api.Engine(plain, str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "store"), config).process_slide("case", block=64).count() > 0
    finally:
        sessions.setActiveSession(spark._jsparkSession)
    with pytest.raises(FileNotFoundError):
        engine.slide_path("nothing")


def records(spark, n, slides_=3):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(20, 10))
    rows = [(f"r{i:05d}", f"s{i % slides_}", (i % 97) / 97.0, (middle[i % 20] + rng.normal(size=10) * 0.4).tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "record_id string, wsi_name string, abnormality_score double, feature_vector array<double>")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in NUCLEUS_RECORD.fields])


def test_a_slides_query_reads_its_folder(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "s"))
    store.create()
    assert store.records().count() == 0 and store.insert(records(spark, 60)) == 60
    store.create()
    found = store.query_abnormal(0.0, "s1")
    assert found.count() == 20 and {r["wsi_name"] for r in found.collect()} == {"s1"}
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(wsi_name" in plan and sorted(x.name for x in (tmp_path / "s").iterdir() if "=" in x.name) == ["wsi_name=s0", "wsi_name=s1", "wsi_name=s2"]


def test_a_stored_index_reaches_the_recall(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "s"), StoreConfig(lists=20, probes=6))
    store.create()
    store.insert(records(spark, 1500))
    vector = [float(x) for x in store.records().filter("record_id = 'r00040'").first()["feature_vector"]]
    exact = {r["record_id"] for r in store.search_similar(vector).collect()}
    assert {r["record_id"] for r in store.search_similar(vector, exact=False).collect()} == exact  # no index yet
    store.create_index()
    near = store.search_similar(vector, exact=False)
    assert len(exact & {r["record_id"] for r in near.collect()}) >= 18 and near.columns == store.search_similar(vector).columns
    assert store.recall(store.records().filter(F.pmod(F.xxhash64("record_id"), F.lit(20)) == 0)) >= 0.9


def test_parts_within_holes_are_not_outer():
    mask = np.zeros((20, 20), bool)
    mask[2:15, 2:15] = True
    mask[4:13, 4:13] = False
    mask[7:9, 7:9] = True
    mask[17:19, 3:6] = True
    assert raster.trace_contours(mask) == [[(2, 2), (14, 2), (14, 14), (2, 14)], [(3, 17), (5, 17), (5, 18), (3, 18)]]
    assert len(pipeline.components(np.where(mask[:, :, None], 0, 255).repeat(3, axis=2).astype(np.uint8))) == 3


def test_labels_are_those_of_a_flood():
    rng = np.random.default_rng(9)
    for density in (0.2, 0.45, 0.7):
        mask = rng.random((40, 37)) < density
        labels, firsts = raster.label_parts(mask)
        want, n = np.zeros(mask.shape, int), 0
        for y, x in zip(*np.nonzero(mask), strict=True):
            if want[y, x]:
                continue
            n += 1
            stack = [(y, x)]
            while stack:
                a, b = stack.pop()
                if 0 <= a < 40 and 0 <= b < 37 and mask[a, b] and not want[a, b]:
                    want[a, b] = n
                    stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert (labels == want).all() and len(firsts) == n


def test_cancel_stops_what_runs_under_the_tasks_tag(spark, tmp_path):
    import time

    from pyspark import InheritableThread

    engine, ended = api.Engine(spark, str(tmp_path), str(tmp_path / "log"), str(tmp_path / "store")), []

    def slow(batches):
        for batch in batches:
            time.sleep(20)
            yield batch

    def work():
        try:
            with engine.running("t9"):
                spark.range(2, numPartitions=2).mapInArrow(slow, "id long").count()
        except Exception as e:
            ended.append(str(e))

    thread, start = InheritableThread(target=work), time.time()
    thread.start()
    while not ended and time.time() - start < 60:
        time.sleep(0.5)
        engine.cancel("t9")
    thread.join(60)
    assert ended and "cancel" in ended[0].lower()


def test_the_driver_has_no_row_for_each_tile(spark, tmp_path, monkeypatch):
    """A file's index is put together by tasks and read in parts; tiles that are missing or lie outside do not matter."""
    image, path = picture(150, 211), str(tmp_path / "i.tiff")
    image[32:64] = 0
    tiles = tiles_of(spark, image, 32).filter("row != 1").union(tiles_of(spark, picture(32, 32), 32).withColumn("col", F.lit(7))).localCheckpoint()
    before = tmp_path / "w.tiff"
    tiff.write_pyramid(tiles, str(before), 211, 150, 32)
    monkeypatch.setattr(tiff, "INDEX_WRITTEN", 4)
    monkeypatch.setattr(tiff, "INDEX_READ", 5)
    seen, layout = [], tiff._layout
    monkeypatch.setattr(tiff, "_layout", lambda rows, *rest: seen.extend(rows) or layout(rows, *rest))
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *_, **__: pytest.fail("rows come from the driver"))
    size = tiff.write_pyramid(tiles, path, 211, 150, 32)
    assert len(seen) == 8 and size == (tmp_path / "i.tiff").stat().st_size  # of 35 places in parts of 4, one part empty
    assert (tmp_path / "i.tiff").read_bytes().replace(b"i.tiff", b"w.tiff") == before.read_bytes()
    level = tiff.read_levels(path)[0]
    assert isinstance(level.sizes, tiff.Index) and len(level.sizes) == 35 and [n for n in range(35) if not level.sizes[n]] == list(range(7, 14))
    assert len(level.sizes.part) <= 5 and [level.offsets[n] for n in (34, 0, 20)] == [tiff.read_levels(str(before))[0].offsets[n] for n in (34, 0, 20)]
    with pytest.raises(IndexError):
        level.sizes[35]
    assert (whole(spark, path) == image).all() and (tiff.read_region(path, 0, 0, 211, 150) == image).all()
