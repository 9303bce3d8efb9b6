"""Tiled TIFF and BigTIFF: headers, regions, a tile source for Spark, and a parallel writer of pyramids.

Reads 8-bit chunky images in tiles or strips, uncompressed, deflate, LZW, PackBits or JPEG (with tables that tiles share),
with or without horizontal prediction; levels are the file's chained and sub-directories. Writes deflate, LZW or JPEG.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StringType, StructField, StructType

from tilewright.sources import jpeg, scratch

# fixed values: the format's field types (size, struct letter), tags and compressions
_KINDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_SIZES = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279
X_RESOLUTION, Y_RESOLUTION, PLANAR, UNIT, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, SUB_LEVELS, JPEG_TABLES, SUB_SAMPLING = 282, 283, 284, 296, 317, 322, 323, 324, 325, 330, 347, 530
PLAIN, LZW, JPEG, DEFLATE, OLD_DEFLATE, PACK_BITS = 1, 5, 7, 8, 32946, 32773
RGB, YCBCR = 2, 6
#: Tiles of an index that are read at once, and that a task puts into a new file.
INDEX_READ, INDEX_WRITTEN = 1 << 13, 1 << 16


class Index:
    """An index of many tiles, read where it is asked; a reader goes along its rows, so the last part is kept."""

    def __init__(self, path: str, at: int, kind: str, n: int):
        self.path, self.at, self.kind, self.n = path, at, np.dtype(kind), n
        self.first, self.part = 0, np.zeros(0, np.int64)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, n: int) -> int:
        if not 0 <= n < self.n:
            raise IndexError(n)
        if not self.first <= n < self.first + len(self.part):
            self.first = n // INDEX_READ * INDEX_READ
            count = min(INDEX_READ, self.n - self.first)
            with open(self.path, "rb") as f:
                f.seek(self.at + self.first * self.kind.itemsize)
                self.part = np.frombuffer(f.read(count * self.kind.itemsize), self.kind, count).astype(np.int64)
        return self.part[n - self.first]


@dataclass
class Level:
    """One image of a file: its size and where its tiles (or strips, as tiles of full width) lie."""

    w: int
    h: int
    channels: int
    tile_w: int
    tile_h: int
    compression: int
    predictor: int
    offsets: np.ndarray | Index
    sizes: np.ndarray | Index
    description: str
    mpp: tuple[float, float] | None
    photometric: int = RGB
    tables: bytes = b""

    @property
    def columns(self) -> int:
        return -(-self.w // self.tile_w)

    @property
    def rows(self) -> int:
        return -(-self.h // self.tile_h)


def _microns(tags: dict, tag: int) -> float | None:
    """Microns per pixel from pixels per inch (2) or centimetre (3)."""
    value, unit = tags.get(tag), {2: 25400.0, 3: 10000.0}.get(tags.get(UNIT, (2,))[0])
    return unit * value[1] / value[0] if value and unit and value[0] > 0 and value[1] > 0 else None


def read_levels(path: str) -> list[Level]:
    """All images of a file, the largest first; FileNotFoundError if there is none, ValueError if it is no such TIFF.

    An index of more than INDEX_READ tiles stays in the file.
    """
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with open(path, "rb") as f:
        head = f.read(16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = struct.unpack(f"{order}H", head[2:4])[0] if order and len(head) >= 8 else 0
        if version not in (42, 43):
            raise ValueError(f"{path} is not a TIFF file")
        big = version == 43
        following = [struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]]
        levels, seen = [], set()
        while following:
            at = following.pop(0)
            if not at or at in seen:
                continue
            seen.add(at)
            f.seek(at)
            count = struct.unpack(f"{order}{'Q' if big else 'H'}", f.read(8 if big else 2))[0]
            size, inline = (20, 8) if big else (12, 4)
            entries, tags = f.read(size * count), {}
            after = struct.unpack(f"{order}{'Q' if big else 'I'}", f.read(inline))[0]
            for i in range(count):
                entry = entries[i * size : (i + 1) * size]
                tag, kind = struct.unpack(f"{order}HH", entry[:4])
                n = struct.unpack(f"{order}{'Q' if big else 'I'}", entry[4 : 4 + inline])[0]
                if kind not in _KINDS:
                    continue
                length, letter = _KINDS[kind]
                data = entry[4 + inline :]
                if n * length > inline:
                    place = struct.unpack(f"{order}{'Q' if big else 'I'}", data)[0]
                    if tag in (TILE_OFFSETS, TILE_SIZES, STRIP_OFFSETS, STRIP_SIZES) and n > INDEX_READ:
                        tags[tag] = Index(path, place, f"{order}u{length}", n)
                        continue
                    f.seek(place)
                    data = f.read(n * length)
                if tag in (TILE_OFFSETS, TILE_SIZES, STRIP_OFFSETS, STRIP_SIZES):
                    tags[tag] = np.frombuffer(data, f"{order}u{length}", n).astype(np.int64)
                elif kind in (2, 7):
                    tags[tag] = data[:n].rstrip(b"\0") if kind == 2 else data[:n]
                else:
                    tags[tag] = struct.unpack(f"{order}{letter * n}", data[: n * length])
            following = [*tags.get(SUB_LEVELS, ()), *following, after]
            if WIDTH in tags and (TILE_OFFSETS in tags or STRIP_OFFSETS in tags):
                levels.append(_level(tags, path))
    return sorted(levels, key=lambda x: -x.w * x.h)


def _level(tags: dict, path: str) -> Level:
    w, h, channels = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    compression = tags.get(COMPRESSION, (PLAIN,))[0]
    if any(b != 8 for b in tags.get(BITS, (1,))) or tags.get(PLANAR, (1,))[0] != 1 or compression not in (PLAIN, LZW, JPEG, DEFLATE, OLD_DEFLATE, PACK_BITS):
        raise ValueError(f"{path}: only 8-bit chunky images, uncompressed, deflate, LZW, PackBits or JPEG")
    tiled = TILE_OFFSETS in tags
    tile = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (w, min(h, tags.get(STRIP_ROWS, (h,))[0]))
    mpp = _microns(tags, X_RESOLUTION), _microns(tags, Y_RESOLUTION)
    return Level(w, h, channels, *tile, compression, tags.get(PREDICTOR, (1,))[0], tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_SIZES if tiled else STRIP_SIZES], bytes(tags.get(DESCRIPTION, b"")).decode(errors="replace"), mpp if all(mpp) else None, tags.get(PHOTOMETRIC, (RGB,))[0], bytes(tags.get(JPEG_TABLES, b"")))


_SINGLE = [*(bytes([i]) for i in range(256)), b"", b""]


def _lzw(data: bytes) -> bytes:
    """The format's LZW: codes of 9 to 12 bits, most significant first, widened one code early; 256 clears, 257 ends."""
    table, out, before = list(_SINGLE), [], b""
    width, held, bits = 9, 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            bits -= width
            code, held = held >> bits, held & ((1 << bits) - 1)
            if code == 257:
                return b"".join(out)
            if code == 256:
                table, width, before = list(_SINGLE), 9, b""
                continue
            piece = table[code] if code < len(table) else before + before[:1]
            out.append(piece)
            if before:
                table.append(before + piece[:1])
            before = piece
            width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def lzw(data: bytes) -> bytes:
    """``data`` in the format's LZW, as _lzw reads it: a clear code first and whenever the table is full."""
    # a longer word's code, by the code of all but its last byte and that byte
    table, following, width, held, bits = {}, 258, 9, 256, 9
    out, word = bytearray(), -1

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        if bits >= 4096:
            rest = bits & 7
            out.extend((held >> rest).to_bytes(bits >> 3, "big"))
            held, bits = held & ((1 << rest) - 1), rest

    for byte in data:
        longer = table.get(word << 8 | byte) if word >= 0 else byte
        if longer is not None:
            word = longer
            continue
        put(word)
        table[word << 8 | byte], following = following, following + 1
        word = byte
        if following == 4094:
            put(256)
            table, following, width = {}, 258, 9
        else:
            width = max(9, following.bit_length())
    if word >= 0:
        put(word)
        following += 1
        width = max(9, following.bit_length())
    put(257)
    held, bits = held << (-bits & 7), bits + (-bits & 7)
    return bytes(out) + held.to_bytes(bits >> 3, "big")


def _squeezed(image: np.ndarray, compression: str) -> bytes:
    """A tile's bytes as they are stored: deflate and LZW after horizontal prediction, or JPEG."""
    if compression == "jpeg":
        return jpeg.encode(image)
    ahead = image.copy()
    ahead[:, 1:] -= image[:, :-1]
    return lzw(ahead.tobytes()) if compression == "lzw" else zlib.compress(ahead.tobytes(), 6)


def _pack_bits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2 if n > 128 else 1
    return b"".join(out)


def read_tile(f, level: Level, row: int, column: int) -> np.ndarray:
    """One tile, cut at the image's edge, as h x w x channels; a tile of no bytes is black."""
    h, w = min(level.tile_h, level.h - row * level.tile_h), min(level.tile_w, level.w - column * level.tile_w)
    n = row * level.columns + column
    if not level.sizes[n]:
        return np.zeros((h, w, level.channels), np.uint8)
    f.seek(int(level.offsets[n]))
    data = f.read(int(level.sizes[n]))
    if level.compression == JPEG:
        return jpeg.decode(data, level.tables, rgb={RGB: True, YCBCR: False}.get(level.photometric))[:h, :w]
    if level.compression in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif level.compression != PLAIN:
        data = _lzw(data) if level.compression == LZW else _pack_bits(data)
    stride = level.tile_w * level.channels
    image = np.frombuffer(data, np.uint8, len(data) // stride * stride).reshape(-1, level.tile_w, level.channels)
    if level.predictor == 2:
        image = np.cumsum(image, axis=1, dtype=np.uint8)
    return image[:h, :w]


def read_region(path: str, x: int, y: int, w: int, h: int, level: int = 0) -> np.ndarray:
    """A region of a level as h x w x 3; (x, y) are pixels of level 0, and what lies outside is black."""
    with open(path, "rb") as f:
        return _region(f, read_levels(path), x, y, w, h, level)


def _region(f, levels: list[Level], x: int, y: int, w: int, h: int, level: int) -> np.ndarray:
    own = levels[level]
    x, y = x * own.w // levels[0].w, y * own.h // levels[0].h
    out = np.zeros((h, w, own.channels), np.uint8)
    for row in range(max(0, y // own.tile_h), min(own.rows, -(-(y + h) // own.tile_h))):
        for column in range(max(0, x // own.tile_w), min(own.columns, -(-(x + w) // own.tile_w))):
            tile = read_tile(f, own, row, column)
            top, left = row * own.tile_h, column * own.tile_w
            y0, x0, y1, x1 = max(y, top), max(x, left), min(y + h, top + tile.shape[0]), min(x + w, left + tile.shape[1])
            if y0 < y1 and x0 < x1:
                out[y0 - y : y1 - y, x0 - x : x1 - x] = tile[y0 - top : y1 - top, x0 - left : x1 - left]
    return rgb(out)


def level_region(f, level: Level, x: int, y: int, w: int, h: int) -> np.ndarray:
    """A region of an open file's level, in that level's own pixels."""
    return _region(f, [level], x, y, w, h, 0)


def rgb(image: np.ndarray) -> np.ndarray:
    """Three channels: grey is repeated, further channels are left out."""
    return np.repeat(image[:, :, :1], 3, axis=2) if image.shape[2] < 3 else image[:, :, :3]


_TILES = StructType([StructField("path", StringType()), *[StructField(c, IntegerType()) for c in ("row", "col", "x", "y", "h", "w")], StructField("data", BinaryType())])


class _Rows(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first))
        self.path, self.first, self.last = path, first, last


class _SlideReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p.removeprefix("file://") for p in options["path"].split(",")]
        self.level, self.per = int(options.get("level", 0)), int(options.get("rowsPerPartition", 1))

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            rows = read_levels(path)[self.level].rows
            out += [_Rows(path, i, min(i + self.per, rows)) for i in range(0, rows, self.per)]
        return out

    def read(self, partition: _Rows) -> Iterator[tuple]:
        level = read_levels(partition.path)[self.level]
        with open(partition.path, "rb") as f:
            for row in range(partition.first, partition.last):
                for column in range(level.columns):
                    tile = rgb(read_tile(f, level, row, column))
                    yield partition.path, row, column, column * level.tile_w, row * level.tile_h, tile.shape[0], tile.shape[1], tile.tobytes()


class SlideSource(DataSource):
    """``spark.read.format("slide").load(path)``: the stored tiles of a level, an input partition for each range of tile rows.

    Several paths are parted by commas; option level is 0, the largest, by default. Paths are
    files that the driver and all executors can open.
    """

    @classmethod
    def name(cls) -> str:
        return "slide"

    def schema(self) -> StructType:
        return _TILES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SlideReader(self.options)


_INFO = StructType([StructField("path", StringType()), *[StructField(c, IntegerType()) for c in ("level", "level_count", "w", "h")], StructField("downsample", DoubleType()), StructField("mpp_x", DoubleType()), StructField("mpp_y", DoubleType()), StructField("description", StringType())])


def slide_info(paths: DataFrame) -> DataFrame:
    """A row for each level of each file of (path): sizes, downsample, microns per pixel if the file tells them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                levels = read_levels(path.removeprefix("file:"))
                for i, own in enumerate(levels):
                    mpp = own.mpp or (None, None)
                    rows.append((path, i, len(levels), own.w, own.h, levels[0].w / own.w, *mpp, own.description))
            kinds = [pa.string(), *[pa.int32()] * 4, *[pa.float64()] * 3, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=_INFO.names)

    return paths.select("path").mapInArrow(run, _INFO)


def cut_tiles(spark: SparkSession, path: str, grid: DataFrame, level: int = 0) -> DataFrame:
    """(slide, row, col, h, w, data) of a tile grid (wsi_path, row, col, x, y, width, height) over one file.

    Each task opens the file and reads its index once, and the stored tiles below the grid tiles it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = read_levels(path)
        with open(path, "rb") as f:
            for r in (r for batch in batches for r in batch.to_pylist()):
                image = _region(f, levels, r["x"], r["y"], r["width"], r["height"], level)
                yield pa.RecordBatch.from_arrays([pa.array([r["wsi_path"]]), *[pa.array([v], pa.int32()) for v in (r["row"], r["col"], *image.shape[:2])], pa.array([image.tobytes()], pa.binary())], names=["slide", "row", "col", "h", "w", "data"])

    return grid.select("wsi_path", "row", "col", "x", "y", "width", "height").mapInArrow(run, "slide string, row int, col int, h int, w int, data binary")


def ome_xml(w: int, h: int, channels: int = 3, mpp: tuple[float, float] | None = None, name: str = "slide") -> str:
    """The image's description in the OME schema: sizes, pixel type, pixel size in microns, and a channel of all samples."""
    size = f' PhysicalSizeX="{mpp[0]}" PhysicalSizeXUnit="µm" PhysicalSizeY="{mpp[1]}" PhysicalSizeYUnit="µm"' if mpp else ""
    colours = ", ".join([*("Red", "Green", "Blue")[:channels], *(f"Channel{i}" for i in range(3, channels))])
    return (
        '<?xml version="1.0" encoding="UTF-8"?><OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06">'
        f'<Image ID="Image:0" Name={quoteattr(name)}><Pixels ID="Pixels:0" DimensionOrder="XYCZT" Type="uint8" SizeX="{w}" SizeY="{h}" SizeC="{channels}" SizeZ="1" SizeT="1"{size}>'
        f'<Channel ID="Channel:0:0" Name={quoteattr(colours)} SamplesPerPixel="{channels}"/><TiffData/></Pixels></Image></OME>'
    )


def halved(tiles: DataFrame, tile: int) -> DataFrame:
    """The next level of (row, col, h, w, data): 2 x 2 pixels are one mean, 2 x 2 tiles one tile; an odd edge is repeated."""

    def merge(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        row, column = (k.as_py() for k in key)
        parts = {(r["row"] % 2, r["col"] % 2): np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"], 3) for r in rows.to_pylist()}
        h, w = parts[0, 0].shape[0] + (parts[1, 0].shape[0] if (1, 0) in parts else 0), parts[0, 0].shape[1] + (parts[0, 1].shape[1] if (0, 1) in parts else 0)
        whole = np.zeros((h + h % 2, w + w % 2, 3), np.float32)
        for (y, x), part in parts.items():
            whole[y * tile : y * tile + part.shape[0], x * tile : x * tile + part.shape[1]] = part
        if h % 2:
            whole[-1] = whole[-2]
        if w % 2:
            whole[:, -1] = whole[:, -2]
        small = np.rint(whole.reshape(whole.shape[0] // 2, 2, whole.shape[1] // 2, 2, 3).mean(axis=(1, 3))).astype(np.uint8)
        return pa.table([pa.array([v], pa.int32()) for v in (row, column, *small.shape[:2])] + [pa.array([small.tobytes()], pa.binary())], names=["row", "col", "h", "w", "data"])

    kept = tiles.withColumn("to_row", F.floor(F.col("row") / 2).cast("int")).withColumn("to_col", F.floor(F.col("col") / 2).cast("int"))
    return kept.groupBy("to_row", "to_col").applyInArrow(merge, "row int, col int, h int, w int, data binary")


def write_pyramid(tiles: DataFrame, path: str, w: int, h: int, tile: int, levels: int = 1, mpp: tuple[float, float] | None = None, compression: str = "deflate") -> int:
    """Write (row, col, h, w, data) tiles of a w x h RGB image as one BigTIFF with reduced levels; the number of its bytes.

    ``compression`` is deflate, lzw or jpeg (with loss; levels are reduced from what was given).

    Each level comes from the one above, tile by tile, and is kept compressed in the scratch
    folder. Then tiles' sizes fix where each lies: the driver sees a sum for INDEX_WRITTEN tiles
    and writes the header, and tasks put the file's own index (16 bytes a tile) and their tiles
    in place in any order, as often as they are run. ``path`` is a file that the driver and all
    executors can open.
    """
    if w < 1 or h < 1 or tile % 16 or compression not in _COMPRESSIONS:
        raise ValueError(f"an image has pixels, tiles of a multiple of 16 and one of {', '.join(_COMPRESSIONS)}")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                image = np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"], 3)
                if r["h"] < tile or r["w"] < tile:
                    image = np.pad(image, ((0, tile - r["h"]), (0, tile - r["w"]), (0, 0)), mode="edge")
                out.append(_squeezed(image, compression))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("col"), pa.array(out, pa.binary())], names=["row", "col", "data"])

    made, sizes = [], [(w, h)]
    current = scratch.written(tiles.select("row", "col", "h", "w", "data"), "slide-level")
    for level in range(levels):
        columns, rows = (-(-n // tile) for n in sizes[-1])
        packed = current.filter(F.col("row").between(0, rows - 1) & F.col("col").between(0, columns - 1)).select("row", "col", "h", "w", "data").mapInArrow(squeeze, "row int, col int, data binary")
        number = F.col("row").cast("long") * columns + F.col("col")
        made.append(scratch.written(packed.select(F.lit(level).alias("level"), number.alias("n"), F.octet_length("data").cast("long").alias("size"), "data"), "slide-tiles"))
        if level + 1 < levels:
            above, current = current, scratch.written(halved(current, tile), "slide-level")
            sizes.append((-(-sizes[-1][0] // 2), -(-sizes[-1][1] // 2)))
            scratch.discard(above)
    scratch.discard(current)
    packed = made[0]
    for other in made[1:]:
        packed = packed.unionByName(other)
    index = packed.select("level", "n", "size", F.expr(f"n div {INDEX_WRITTEN}").alias("part"))
    shares = index.groupBy("level", "part").agg(F.sum(F.col("size") + F.col("size") % 2)).orderBy("level", "part").collect()
    head, tables, starts, total = _layout(shares, sizes, tile, ome_xml(w, h, 3, mpp, os.path.basename(path)), mpp, compression)
    with open(path, "wb") as f:
        f.truncate(total)
        for at, data in head:
            f.seek(at)
            f.write(data)

    def place(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        level, part = (k.as_py() for k in key)
        rows = rows.sort_by("n")
        n, size = rows.column("n").to_numpy(), rows.column("size").to_numpy()
        at = starts[level, part] + np.cumsum(size + size % 2) - (size + size % 2)
        first, count = part * INDEX_WRITTEN, -(-sizes[level][0] // tile) * -(-sizes[level][1] // tile)
        with open(path, "r+b") as f:
            for table, values in zip(tables[level], (at, size), strict=True):
                own = np.zeros(min(INDEX_WRITTEN, count - first), "<u8")
                own[n - first] = values
                f.seek(table + 8 * first)
                f.write(own.tobytes())
            f.flush()
            os.fsync(f.fileno())
        return pa.table([rows.column("level"), rows.column("n"), pa.array(at)], names=["level", "n", "at"])

    places = index.groupBy("level", "part").applyInArrow(place, "level int, n long, at long")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with open(path, "r+b") as f:
            for batch in batches:
                for at, data in zip(batch.column("at").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    f.seek(at)
                    f.write(data)
                    n += len(data)
            f.flush()
            os.fsync(f.fileno())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    # merged, as the estimate of a well-compressed index may let Spark broadcast it
    packed.hint("merge").join(places, ["level", "n"]).select("at", "data").mapInArrow(put, "n long").agg(F.sum("n")).first()
    scratch.discard(*made)
    return total


_COMPRESSIONS = {"deflate": DEFLATE, "lzw": LZW, "jpeg": JPEG}


def _layout(shares: list, sizes: list[tuple[int, int]], tile: int, description: str, mpp: tuple[float, float] | None, compression: str) -> tuple[list[tuple[int, bytes]], list[tuple[int, int]], dict[tuple[int, int], int], int]:
    """(place, bytes) of header and directories, places of each level's offsets and sizes, of the first tile of each share (level, part, bytes), and the file's length."""
    at, places = 16, {}
    for level, part, size in shares:
        places[level, part] = at
        at += size
    out, starts, tables = [], [], {}
    text = description.encode() + b"\0"
    for level in range(len(sizes) - 1, -1, -1):  # sub-levels first, as the main directory names them
        w, h = sizes[level]
        count = -(-h // tile) * -(-w // tile)
        fields: list[tuple[int, int, int, bytes]] = [
            (254, 4, 1, struct.pack("<I", int(level > 0))), (WIDTH, 4, 1, struct.pack("<I", w)), (HEIGHT, 4, 1, struct.pack("<I", h)), (BITS, 3, 3, struct.pack("<3H", 8, 8, 8)),
            (COMPRESSION, 3, 1, struct.pack("<H", _COMPRESSIONS[compression])), (PHOTOMETRIC, 3, 1, struct.pack("<H", YCBCR if compression == "jpeg" else RGB)), (SAMPLES, 3, 1, struct.pack("<H", 3)), (PLANAR, 3, 1, struct.pack("<H", 1)),
            (TILE_WIDTH, 3, 1, struct.pack("<H", tile)), (TILE_HEIGHT, 3, 1, struct.pack("<H", tile)), (TILE_OFFSETS, 16, count, b""), (TILE_SIZES, 16, count, b""),
        ]
        fields.append((SUB_SAMPLING, 3, 2, struct.pack("<2H", 1, 1)) if compression == "jpeg" else (PREDICTOR, 3, 1, struct.pack("<H", 2)))
        if mpp:
            fields += [(tag, 5, 1, struct.pack("<II", round(10000.0 / m * 10**5), 10**5)) for tag, m in zip((X_RESOLUTION, Y_RESOLUTION), mpp, strict=True)] + [(UNIT, 3, 1, struct.pack("<H", 3))]
        if level == 0:
            fields.append((DESCRIPTION, 2, len(text), text))
            if starts:
                fields.append((SUB_LEVELS, 16, len(starts), struct.pack(f"<{len(starts)}Q", *starts[::-1])))
        fields.sort()
        start, extra = at, at + 8 + 20 * len(fields) + 8
        entries, rest, own = b"", [], {}
        for tag, kind, n, data in fields:
            length = 8 * n if tag in (TILE_OFFSETS, TILE_SIZES) else len(data)
            if tag in (TILE_OFFSETS, TILE_SIZES):  # tasks put them there; without a tile they are 0
                own[tag] = extra if length > 8 else start + 8 + len(entries) + 12
            if length > 8:
                value = struct.pack("<Q", extra)
                rest.append((extra, data))
                extra += length + -length % 8
            else:
                value = data.ljust(8, b"\0")
            entries += struct.pack("<HHQ", tag, kind, n) + value
        out += [(start, struct.pack("<Q", len(fields)) + entries + struct.pack("<Q", 0)), *rest]
        tables[level] = own[TILE_OFFSETS], own[TILE_SIZES]
        at = extra
        starts.append(start)
    return [(0, struct.pack("<2sHHHQ", b"II", 43, 8, 0, starts[-1])), *out], [tables[i] for i in range(len(sizes))], places, at
