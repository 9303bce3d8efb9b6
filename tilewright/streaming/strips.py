"""Stateful blends: running sums of keys, and output blocks that leave the stream once all their tiles are there."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tilewright.config import BlendConfig
from tilewright.operators import blend, grid

_SUMS = StructType([StructField("total", DoubleType()), StructField("mass", DoubleType()), StructField("n", LongType())])
RESULT = "key string, total double, mass double, n long"


class StripSums(StatefulProcessor):
    """Running weighted sums of one key; every batch that touches the key yields its sums so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", _SUMS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        total, mass, n = self.sums.get() if self.sums.exists() else (0.0, 0.0, 0)
        for part in rows:
            total += float((part["v"] * part["w"]).sum())
            mass += float(part["w"].sum())
            n += len(part)
        self.sums.update((total, mass, n))
        yield pd.DataFrame({"key": [key[0]], "total": [total], "mass": [mass], "n": [n]})

    def close(self) -> None:
        pass


def stream_sums(contributions: DataFrame) -> DataFrame:
    """(key, v, w) to running (key, total, mass, n), in update mode; for keys that never end (see stream_blocks)."""
    return contributions.groupBy("key").transformWithStateInPandas(StripSums(), RESULT, "Update", "None")


def _reaching(total: Column, at: Column, block: int, tile: int, pitch: int) -> Column:
    """How many of ``total`` tiles along an axis reach the block at ``at``."""
    first = F.greatest(F.lit(0), F.ceil((at * block - tile + 1) / pitch))
    last = F.least(total - 1, F.floor(((at + 1) * block - 1) / pitch))
    return last - first + 1


def expected_tiles(block: int, tile: int, pitch: int) -> Column:
    """The number of a whole grid's tiles that reach a block, by total_rows, total_cols, block_row and block_col."""
    by_row = _reaching(F.col("total_rows"), F.col("block_row"), block, tile, pitch)
    return (by_row * _reaching(F.col("total_cols"), F.col("block_col"), block, tile, pitch)).cast("int")


_AT = StructType([StructField("slide", StringType()), *[StructField(c, IntegerType()) for c in ("block_row", "block_col", "row", "col")]])
_TILE = StructType([StructField("data", BinaryType()), StructField("h", IntegerType()), StructField("w", IntegerType())])
_FATES = StructType([StructField("fates", StringType()), StructField("timer", LongType())])
BLOCKS = "slide string, block_row int, block_col int, status string, n_tiles int, row int, col int, data binary"
#: Bytes of tiles, or of rows on their way out, that a bucket's call holds; what a tile takes beyond its pixels, or a row beyond its data.
HELD = 64 << 20
SENT = 4 << 20
BESIDE = 300


@dataclass
class Fate:
    """What a block still waits for: its tiles' number and those that came, None once it has left with ``n``; forgotten at ``until``."""

    n: int = 0
    until: int = -1
    expected: int = 0
    places: set[tuple[int, int]] | None = field(default_factory=set)


class FinishedBlocks(StatefulProcessor):
    """Tiles of the output blocks of one bucket, kept until all that reach a block are there or none has come for ``wait_ms`` of event time.

    A call costs far more than a block, so that one sees all blocks of a bucket; their fates are one value, with one timer for the first that expires.
    """

    def __init__(self, block: int, tile: int, pitch: int, overlap: int, sigma: float, floor: float, wait_ms: int) -> None:
        self.block, self.pitch, self.floor, self.wait_ms = block, pitch, floor, wait_ms
        self.weights = blend.kernel(tile, overlap, sigma)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tiles = handle.getMapState("tiles", _AT, _TILE)
        self.fates = handle.getValueState("fates", _FATES)

    def _load(self) -> tuple[dict[tuple, Fate], int]:
        """Fates by block, and the bucket's timer (-1: none)."""
        packed = self.fates.get()
        if packed is None:
            return {}, -1
        return {(s, r, c): Fate(n, until, expected, None if places is None else {(y, x) for y, x in places}) for s, r, c, n, until, expected, places in json.loads(packed[0])}, packed[1]

    def _save(self, fates: dict[tuple, Fate], timer: int) -> None:
        wake = min((f.until for f in fates.values()), default=-1)
        if wake != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if wake >= 0:
                self.handle.registerTimer(wake)
        if not fates:
            self.fates.clear()
            return
        rows = [(*at, f.n, f.until, f.expected, None if f.places is None else sorted(f.places)) for at, f in fates.items()]
        self.fates.update((json.dumps(rows, separators=(",", ":")), wake))

    def _keep(self, fresh: dict[tuple, dict]) -> None:
        for at, tiles in fresh.items():
            for place, tile in tiles.items():
                self.tiles.updateValue((*at, *place), tile)

    def _taken(self, at: tuple, places: set) -> dict:
        """A block's tiles out of the state, where they stay no longer."""
        found = {}
        for place in places:
            data, h, w = self.tiles.getValue((*at, *place))
            found[place] = bytes(data), h, w
            self.tiles.removeKey((*at, *place))
        return found

    def _image(self, at: tuple, status: str, tiles: dict) -> tuple:
        kept = [(*place, *tile) for place, tile in tiles.items()]
        return *at, status, len(kept), None, None, blend.blended(kept, at[1], at[2], self.block, self.pitch, self.weights, self.floor).tobytes()

    @staticmethod
    def _frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        """Rows in frames of some SENT bytes."""
        def frame() -> pd.DataFrame:
            return pd.DataFrame(held, columns=["slide", "block_row", "block_col", "status", "n_tiles", "row", "col", "data"]).astype({"row": "Int32", "col": "Int32"})

        held, size = [], 0
        for row in rows:
            held.append(row)
            size += len(row[-1] or b"") + BESIDE
            if size >= SENT:
                yield frame()
                held, size = [], 0
        if held:
            yield frame()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        return self._frames(self._blocks(rows))

    def _blocks(self, parts: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        fates, timer = self._load()
        fresh, held = {}, 0  # tiles of a block that is finished at once never reach the state
        names = ("slide", "block_row", "block_col", "row", "col", "data", "h", "w", "expected", "at_ms")
        for part in parts:
            for slide, block_row, block_col, row, col, data, h, w, expected, ms in zip(*(part[c].tolist() for c in names), strict=True):
                at, place = (slide, block_row, block_col), (row, col)
                fate = fates.get(at)
                if fate is None:
                    fate = fates[at] = Fate()
                fate.until = max(fate.until, ms + self.wait_ms)
                if fate.places is None:
                    yield *at, "late", fate.n, row, col, None
                elif place not in fate.places:
                    fate.places.add(place)
                    fate.expected = expected
                    fresh.setdefault(at, {})[place] = bytes(data), h, w
                    held += len(data) + BESIDE
                    if len(fate.places) == expected:
                        tiles = fresh.pop(at)
                        held -= sum(len(t[0]) + BESIDE for t in tiles.values())
                        yield self._image(at, "whole", self._taken(at, fate.places - tiles.keys()) | tiles)
                        fate.n, fate.places = expected, None
                    if held > HELD:
                        self._keep(fresh)
                        fresh, held = {}, 0
        self._keep(fresh)
        self._save(fates, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._frames(self._expired(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))

    def _expired(self, fired: int, watermark: int) -> Iterator[tuple]:
        fates = self._load()[0]
        for at in [at for at, f in fates.items() if f.until <= fired or f.until < watermark]:
            fate = fates.pop(at)
            if fate.places is not None:
                yield self._image(at, "partial", self._taken(at, fate.places))
        self._save(fates, -1)  # the one that fired goes by itself

    def close(self) -> None:
        pass


def stream_blocks(tiles: DataFrame, block: int, tile: int, pitch: int, overlap: int, sigma: float, floor: float = BlendConfig().weight_floor, time: str = "at", late: str = "10 minutes", wait_ms: int = 600_000, buckets: int = 1024) -> DataFrame:
    """A stream of placed tiles to blended output blocks, each once: rows (slide, block_row, block_col, status, n_tiles, row, col, data).

    Tiles are rows (slide, row, col, data, h, w, total_rows, total_cols) with an event time. Status is ``whole`` when
    the last tile that reaches the block has come, ``partial`` when the watermark has passed the block's last tile by
    ``wait_ms`` before that (what no tile covers is black), and ``late`` for a tile, by row and col and without data,
    of a block that has left; tiles behind the watermark are dropped by the stream. A tile that comes twice counts once, the first time.
    State is a block's few tiles as bytes and goes with the block; a mark of some 50 bytes stays until the watermark
    has passed it, so that late tiles are known. Blocks equal those of blend.blend_blocks byte by byte.
    Blocks are dealt to ``buckets`` by hash, fixed for a checkpoint: a batch reads and writes the marks of each bucket that it touches
    at once, and a task has one bucket's marks and 64 MB of its tiles in memory.
    """
    seen = tiles.withWatermark(time, late).withColumn("slide", F.col("slide").cast("string"))
    placed = grid.tile_block_map(seen, block, tile, pitch)
    # blocks below the image, which only a tile's padding reaches, are there in the batch form too
    rows = placed.select("slide", F.col("block_row").cast("int").alias("block_row"), F.col("block_col").cast("int").alias("block_col"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "data", F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), expected_tiles(block, tile, pitch).alias("expected"), F.unix_millis(time).alias("at_ms"), time).withColumn("bucket", F.pmod(F.xxhash64("slide", "block_row", "block_col"), F.lit(buckets)).cast("int"))
    keep = FinishedBlocks(block, tile, pitch, overlap, sigma, floor, wait_ms)
    return rows.groupBy("bucket").transformWithStateInPandas(keep, BLOCKS, "Append", "EventTime")
