"""JPEG against the JVM's codec and known coefficients, LZW, and summed-area tables against plain sums."""

import numpy as np
import pytest
from test_files import picture, strips, tiles_of, whole

from tilewright.operators import area, tissue
from tilewright.sources import jpeg, slides, tiff


def soft(h, w, seed=0):
    y, x = np.mgrid[:h, :w]
    noise = np.random.default_rng(seed).normal(0, 5, (h, w, 3))
    return np.clip(np.stack([128 + 100 * np.sin(x / 17), 128 + 90 * np.cos(y / 23), (x + y) * 0.7 % 256], axis=2) + noise, 0, 255).astype(np.uint8)


def jvm_decode(spark, data):
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    w, h = image.getWidth(), image.getHeight()
    pixels = np.array(list(image.getRGB(0, 0, w, h, None, 0, w)), np.int64).reshape(h, w)
    return np.stack([pixels >> 16 & 255, pixels >> 8 & 255, pixels & 255], axis=2)


def jvm_encode(spark, image, progressive=False, grey=False):
    jvm = spark._jvm
    h, w = image.shape[:2]
    buffer = jvm.java.awt.image.BufferedImage(w, h, 10 if grey else 1)
    for y in range(h):
        for x in range(w):
            buffer.setRGB(x, y, int(image[y, x, 0]) << 16 | int(image[y, x, 1]) << 8 | int(image[y, x, 2]))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    out = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(jvm.javax.imageio.stream.MemoryCacheImageOutputStream(out))
    how = writer.getDefaultWriteParam()
    if progressive:
        how.setProgressiveMode(jvm.javax.imageio.ImageWriteParam.MODE_DEFAULT)
    writer.write(None, jvm.javax.imageio.IIOImage(buffer, None, None), how)
    writer.getOutput().flush()
    return bytes(out.toByteArray())


def test_the_jvms_streams_are_read_alike(spark):
    image = soft(45, 61)
    data = jvm_encode(spark, image)
    assert np.abs(slides.decode(data).astype(int) - jvm_decode(spark, data)).max() <= 2
    grey = jvm_encode(spark, image, grey=True)
    assert jpeg.decode(grey).shape == (45, 61, 1)
    with pytest.raises(ValueError, match="progressive"):
        jpeg.decode(jvm_encode(spark, image, progressive=True))


@pytest.mark.parametrize("chroma", [1, 2])
@pytest.mark.parametrize("restart", [0, 1, 5])
def test_our_streams_are_read_alike(spark, chroma, restart):
    for h, w in ((8, 8), (33, 47), (1, 1), (17, 70)):
        image = soft(h, w, h)
        data = jpeg.encode(image, 3.0, chroma, restart)
        assert np.abs(jpeg.decode(data).astype(int) - jvm_decode(spark, data)).max() <= 2
        if chroma == 1:
            assert np.abs(jpeg.decode(jpeg.encode(image, 0.0, 1, restart)).astype(int) - image).max() <= 3
        grey = image[:, :, :1]
        assert np.abs(jpeg.decode(jpeg.encode(grey, 0.0, restart=restart)).astype(int) - grey).max() <= 1


def test_known_coefficients():
    """Blocks of single cosines, by the transform's definition."""
    y, x = np.mgrid[:8, :8]
    for u, v, n in ((0, 0, 40), (3, 0, -120), (2, 5, 90), (7, 7, 60)):
        scale = 0.25 * (np.sqrt(0.5) if u == 0 else 1) * (np.sqrt(0.5) if v == 0 else 1)
        want = np.clip(np.rint(128 + n * scale * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16)), 0, 255)
        block = np.zeros((8, 8))
        block[u, v] = n
        assert np.abs(np.clip(np.rint(jpeg.COSINE.T @ block @ jpeg.COSINE + 128), 0, 255) - want).max() == 0
        data = jpeg.encode(want.astype(np.uint8)[:, :, None], 0.0)
        assert np.abs(jpeg.decode(data)[:, :, 0] - want).max() <= 1
    assert jpeg.ZIGZAG[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and jpeg.ZIGZAG[-3:] == [55, 62, 63]


def test_damaged_streams_are_refused():
    data = jpeg.encode(soft(40, 40))
    for bad in (b"", b"\xff\xd8", data[:20], data[: len(data) // 2], data[:-40], b"\xff\xd8" + data[200:]):
        with pytest.raises(ValueError, match="JPEG"):
            jpeg.decode(bad)
    rng = np.random.default_rng(0)
    for _ in range(60):
        broken = bytearray(data)
        for i in rng.integers(2, len(data), 4):
            broken[i] = rng.integers(256)
        try:
            jpeg.decode(bytes(broken))
        except ValueError:
            pass


def test_jpeg_strips_with_shared_tables(tmp_path, monkeypatch):
    """Compression 7: abbreviated strips and one stream of tables, as YCbCr and as RGB."""
    image = soft(40, 48)
    tables, _ = jpeg.encode(image, 2.0, abbreviated=True)
    for photometric in (tiff.YCBCR, tiff.RGB):
        whole_ = jpeg.encode(image, 2.0)
        path = tmp_path / f"{photometric}.tif"
        data = strips(image, 1, 1, rows=40)
        assert (tiff.read_region(str(_file(path, data)), 0, 0, 48, 40) == image).all()
        level = tiff.read_levels(str(path))[0]
        rest = jpeg.encode(image, 2.0, abbreviated=True)[1]
        path.write_bytes(rest)
        own = tiff.Level(48, 40, 3, 48, 40, tiff.JPEG, 1, np.array([0]), np.array([len(rest)]), "", None, photometric, tables)
        with open(path, "rb") as f:
            got = tiff.read_tile(f, own, 0, 0)
        assert level.w == 48 and (got == jpeg.decode(whole_, rgb=photometric == tiff.RGB)).all()
        assert (np.abs(got.astype(int) - image).mean() < 4) == (photometric == tiff.YCBCR)


def _file(path, data):
    path.write_bytes(data)
    return path


@pytest.mark.parametrize("compression", ["deflate", "lzw", "jpeg"])
def test_pyramids_of_every_compression(spark, tmp_path, compression):
    image, path = soft(100, 150), str(tmp_path / "a.tiff")
    tiff.write_pyramid(tiles_of(spark, image, 48), path, 150, 100, 48, levels=2, compression=compression)
    got = whole(spark, path)
    assert got.shape == image.shape and np.abs(got.astype(int) - image).max() <= (40 if compression == "jpeg" else 0)
    assert np.abs(got.astype(int) - image).mean() < 4 and whole(spark, path, 1).shape == (50, 75, 3)
    with pytest.raises(ValueError, match="lzw"):
        tiff.write_pyramid(tiles_of(spark, image, 48), path, 150, 100, 48, compression="zip")


def test_lzw_is_read_back():
    rng = np.random.default_rng(3)
    for data in (b"", b"a", b"ab" * 9000, bytes(20000), rng.integers(0, 256, 30000, np.uint8).tobytes(), rng.integers(0, 3, 50000, np.uint8).tobytes(), picture(40, 50).tobytes()):
        assert tiff._lzw(tiff.lzw(data)) == data


def blocks_of(masks, h, w):
    out = []
    for name, mask in masks.items():
        for r in range(-(-mask.shape[0] // h)):
            for c in range(-(-mask.shape[1] // w)):
                part = np.ascontiguousarray(mask[r * h : r * h + h, c * w : c * w + w])
                out.append((name, r, c, *part.shape, part.tobytes()))
    return out


BLOCKS = "slide string, block_row int, block_col int, h int, w int, mask binary"


@pytest.mark.parametrize(("h", "w"), [(8, 6), (1, 1), (5, 64), (64, 64)])
def test_any_rectangle_is_four_look_ups(spark, h, w):
    rng = np.random.default_rng(h)
    masks = {"a": (rng.random((23, 31)) < 0.4).astype(np.uint8), "b": (rng.random((8, 5)) < 0.4).astype(np.uint8), "c": np.ones((1, 1), np.uint8)}
    asked = []
    for i in range(300):
        name = "abc"[i % 3]
        y, x = (sorted(rng.integers(0, n + 1, 2).tolist()) for n in masks[name].shape)
        asked.append((name, i, y[0], x[0], y[1], x[1]))
    areas = area.summed_areas(area.measured(spark.createDataFrame(blocks_of(masks, h, w), BLOCKS)))
    got = {r["id"]: r["true"] for r in area.rectangle_sums(spark.createDataFrame(asked, "slide string, id int, y1 int, x1 int, y2 int, x2 int"), areas, (h, w), ["id"]).collect()}
    assert got == {i: masks[s][a:c, b:d].sum() for s, i, a, b, c, d in asked}


def test_tissue_tiles_are_those_of_cells(spark):
    rng = np.random.default_rng(2)
    masks = {s: (rng.random((40, 37)) < 0.3).astype(np.uint8) for s in "ab"}
    tiles = spark.createDataFrame([(s, f"{s}{i}", *rng.integers(-20, 400, 2).tolist(), *rng.integers(1, 120, 2).tolist()) for s in "ab" for i in range(100)], "wsi_path string, tile_id string, x int, y int, width int, height int")
    cells = spark.createDataFrame([(s, y, x, int(m[y, x])) for s, m in masks.items() for y in range(40) for x in range(37)], "slide string, my int, mx int, mask int")
    want = {r["tile_id"]: r["tissue_ratio"] for r in tissue.tissue_tiles(tiles, cells, 10, 0.25).collect()}
    got = {r["tile_id"]: r["tissue_ratio"] for r in area.tissue_tiles(tiles, spark.createDataFrame(blocks_of(masks, 16, 16), BLOCKS), (16, 16), 10, 0.25).collect()}
    assert got == pytest.approx(want) and 20 < len(got) < 200


def test_mask_blocks_of_image_tiles(spark):
    image = picture(50, 41)
    image[10:30, 5:20] = 250
    tiles = tiles_of(spark, image, 16)
    for cell in (1, 4):
        out = np.zeros((-(-50 // cell), -(-41 // cell)), np.uint8)
        for r in area.mask_blocks(tiles, "s", 120.0, cell).collect():
            y, x = r["block_row"] * 16 // cell, r["block_col"] * 16 // cell
            out[y : y + r["h"], x : x + r["w"]] = np.frombuffer(r["mask"], np.uint8).reshape(r["h"], r["w"])
        grey = image.mean(axis=2)
        want = [[grey[y : y + cell, x : x + cell].mean() < 120.0 for x in range(0, 41, cell)] for y in range(0, 50, cell)]
        assert (out == np.array(want)).all()
