"""Slides and images as tables: listings, a tile source, decoding and sinks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from tilewright.config import IngestConfig
from tilewright.sources import jpeg

_SUFFIX = r"\.[^./]+$"


def suffix(path: Column | str = "path", pattern: str = _SUFFIX) -> Column:
    return F.lower(F.regexp_extract(path, pattern, 0))


def admissible(listing: DataFrame, suffixes: tuple[str, ...] = IngestConfig().suffixes, max_bytes: int = IngestConfig().max_bytes, pattern: str = _SUFFIX) -> DataFrame:
    """Files of a listing (path, length) with a known suffix and an admitted size."""
    return listing.withColumn("suffix", suffix("path", pattern)).filter(F.col("suffix").isin(*suffixes) & (F.col("length") <= max_bytes))


def list_files(spark: SparkSession, folder: str, patterns: tuple[str, ...], recursive: bool = False) -> DataFrame:
    """(path, length, modificationTime) of matching files; content stays unread as it is not selected."""
    parts = [spark.read.format("binaryFile").option("pathGlobFilter", p).option("recursiveFileLookup", str(recursive).lower()).load(folder) for p in patterns]
    return reduce(DataFrame.unionByName, parts).select("path", "length", "modificationTime")


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """png and jpg files of a folder in order of their path; its subfolders only if it has none itself."""
    patterns = ("*.png", "*.jpg")
    for recursive in (False, True):
        found = list_files(spark, folder, patterns, recursive)
        if not found.isEmpty():
            return found.orderBy("path")
    raise FileNotFoundError(f"no png or jpg below {folder}")


def find_result(spark: SparkSession, folder: str, pattern: str = "*_super_resolved.ome.tiff") -> DataFrame:
    """The first matching file, by path."""
    return list_files(spark, folder, (pattern,)).orderBy("path").limit(1)


def decode_ppm(data: bytes) -> np.ndarray:
    """A binary PPM or PGM image of 8 bits as h x w x 3."""
    fields, at = [], 0
    while len(fields) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(data[at:end])
        at = end
    kind, w, h, top = fields[0], *(int(x) for x in fields[1:])
    if kind not in (b"P5", b"P6") or top > 255:
        raise ValueError("not an 8-bit binary PPM or PGM image")
    image = np.frombuffer(data, np.uint8, h * w * (3 if kind == b"P6" else 1), at + 1).reshape(h, w, -1)
    return np.repeat(image, 3, axis=2) if image.shape[2] == 1 else image


def decode_png(data: bytes) -> np.ndarray:
    """A PNG image of 8 bits a sample, not interlaced, as h x w x 3: grey is repeated, palettes are looked up, alpha is left out."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, body, palette, head = 8, [], None, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = chunk
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            break
    w, h, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if bits != 8 or interlaced or not channels:
        raise ValueError("only PNG images of 8 bits a sample, not interlaced")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * channels)
    image, above = np.zeros((h, w, channels), np.uint8), np.zeros((w, channels), np.uint8)
    for y in range(h):
        kind, line = int(lines[y, 0]), lines[y, 1:].reshape(w, channels)
        if kind == 1:
            line = np.cumsum(line, axis=0, dtype=np.uint8)
        elif kind == 2:
            line = line + above
        elif kind > 2:
            line = _unfiltered(kind, line, above)
        image[y] = above = line
    if colour == 3:
        return palette[image[:, :, 0]]
    return np.repeat(image[:, :, :1], 3, axis=2) if channels < 3 else image[:, :, :3]


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A PNG line told by the mean (3) of left and above, or by the one of left, above and upper left nearest to left + above - upper left (4)."""
    out, left, corner = [], [0] * line.shape[1], [0] * line.shape[1]
    for own, up in zip(line.tolist(), above.tolist(), strict=True):
        if kind == 3:
            left = [(v + (a + b) // 2) & 255 for v, a, b in zip(own, left, up, strict=True)]
        else:
            # ties go to left, then to above
            guess = [min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2] for a, b, c in zip(left, up, corner, strict=True)]
            left = [(v + g) & 255 for v, g in zip(own, guess, strict=True)]
        out.append(left)
        corner = up
    return np.array(out, np.uint8).reshape(line.shape)


def decode(data: bytes) -> np.ndarray:
    """An image of a kind that its first bytes tell."""
    if data[:2] == b"\xff\xd8":
        image = jpeg.decode(data)
        return np.repeat(image, 3, axis=2) if image.shape[2] == 1 else image
    return decode_png(data) if data[:4] == b"\x89PNG" else decode_ppm(data)


def write_tiff(image: np.ndarray, tile: int = 1024, description: str = "") -> bytes:
    """A baseline tiled TIFF (uncompressed, little-endian) of an h x w x c byte image."""
    if image.ndim == 2:
        image = image[:, :, None]
    if image.ndim != 3 or image.shape[2] not in (1, 3, 4):
        raise ValueError(f"an image has 1, 3 or 4 channels, not shape {image.shape}")
    h, w, c = image.shape
    rows, cols = -(-h // tile), -(-w // tile)
    padded = np.zeros((rows * tile, cols * tile, c), np.uint8)
    padded[:h, :w] = image
    blocks = [padded[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile].tobytes() for y in range(rows) for x in range(cols)]
    text = description.encode() + b"\0"
    n = len(blocks)
    entries = 13
    start = 8 + 2 + 12 * entries + 4
    extra, place = bytearray(), {}

    def put(name: str, data: bytes) -> None:
        place[name] = start + len(extra)
        extra.extend(data + b"\0" * (len(data) % 2))

    put("bits", struct.pack(f"<{c}H", *[8] * c))
    put("text", text)
    put("sizes", struct.pack(f"<{n}I", *map(len, blocks)))
    put("offsets", b"\0" * 4 * n)
    first = start + len(extra)
    offsets = [first + i * len(blocks[0]) for i in range(n)]
    at = place["offsets"] - start
    extra[at : at + 4 * n] = struct.pack(f"<{n}I", *offsets)
    short = lambda tag, v: struct.pack("<HHIHH", tag, 3, 1, v, 0)
    long = lambda tag, v, count=1, kind=4: struct.pack("<HHII", tag, kind, count, v)
    bits = short(258, 8) if c == 1 else struct.pack("<HHIHH", 258, 3, c, 8, 8) if c == 2 else long(258, place["bits"], c, 3)
    fields = [
        long(256, w), long(257, h), bits, short(259, 1), short(262, 2 if c > 2 else 1), long(270, place["text"] if len(text) > 4 else int.from_bytes(text.ljust(4, b"\0"), "little"), len(text), 2),
        short(277, c), short(284, 1), short(322, tile), short(323, tile), long(324, place["offsets"] if n > 1 else offsets[0], n), long(325, place["sizes"] if n > 1 else len(blocks[0]), n), short(339, 1),
    ]
    return struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(fields)) + b"".join(fields) + struct.pack("<I", 0) + bytes(extra) + b"".join(blocks)


def image_metadata(w: int, h: int, channels: int, mpp: tuple[float, float] | None = None) -> dict:
    """Size, pixel size and channel names for an image's description."""
    names = [*("Red", "Green", "Blue")[:channels], *(f"Channel{i}" for i in range(3, channels))]
    return {"size_x": w, "size_y": h, "size_c": channels, "channels": names, **({"physical_size_x": mpp[0], "physical_size_y": mpp[1]} if mpp else {})}


def mpp_of(text: Column) -> Column:
    """Microns per pixel from a property, null where missing, not a number or not positive."""
    x = text.try_cast("double")
    return F.when(x > 0, x)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Image blocks as parquet, foldered by block row, so that a region reads a few folders."""
    blocks.write.partitionBy("block_row").mode("overwrite").parquet(path)


_TILES = StructType([StructField("path", StringType()), StructField("row", IntegerType()), StructField("col", IntegerType()), StructField("h", IntegerType()), StructField("w", IntegerType()), StructField("data", BinaryType())])


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__(first)
        self.first, self.last = first, last


class _TileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.h, self.w, self.tile = (int(options[k]) for k in ("height", "width", "tile"))
        self.path, self.per = options.get("path", "synthetic"), int(options.get("rowsPerPartition", 1))

    def partitions(self) -> list[InputPartition]:
        n = -(-self.h // self.tile)
        return [_Rows(i, min(i + self.per, n)) for i in range(0, n, self.per)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        for row in range(partition.first, partition.last):
            for col in range(-(-self.w // self.tile)):
                h, w = min(self.tile, self.h - row * self.tile), min(self.tile, self.w - col * self.tile)
                y, x = np.mgrid[row * self.tile : row * self.tile + h, col * self.tile : col * self.tile + w]
                image = np.stack([y % 256, x % 256, (x + y) % 256], axis=2).astype(np.uint8)
                yield self.path, row, col, h, w, image.tobytes()


class TileSource(DataSource):
    """``spark.read.format("tiles")``: tiles of a test slide, an input partition for each range of tile rows.

    Options height, width and tile. Real slides are read by ``tiff.SlideSource``.
    """

    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> StructType:
        return _TILES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TileReader(self.options)


@F.pandas_udf(StructType([StructField("h", IntegerType()), StructField("w", IntegerType()), StructField("data", BinaryType())]))
def decode_image(content: pd.Series) -> pd.DataFrame:
    """binaryFile contents (PNG, JPEG, PPM, PGM) to pixels."""
    images = [decode(bytes(c)) for c in content]
    return pd.DataFrame({"h": [i.shape[0] for i in images], "w": [i.shape[1] for i in images], "data": [i.tobytes() for i in images]})


def encode_jpeg_blocks(rows: DataFrame, key: str) -> DataFrame:
    """(key, content) of (key, levels): JPEG images of 2 x 2 blocks of 8 x 8 pixels, each of one grey level, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = [np.array(x, np.uint8).reshape(2, 2).repeat(8, axis=0).repeat(8, axis=1)[:, :, None] for x in batch.column("levels").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([jpeg.encode(x, 0.0) for x in levels], pa.binary())], names=[key, "content"])

    return rows.select(key, "levels").mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, content binary")
