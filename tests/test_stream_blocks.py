"""Blocks that leave a stream, against the batch form."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import blend, grid
from tilewright.plans.streams import _with_rocksdb
from tilewright.streaming import strips

BLOCK, TILE, PITCH, OVERLAP, SIGMA = 24, 16, 12, 4, 5.0
SCHEMA = "slide string, row int, col int, data binary, h int, w int, total_rows int, total_cols int, at timestamp"
START = dt.datetime(2024, 1, 1)


def slide(name, rows, cols, seed, minute=0):
    rng = np.random.default_rng(seed)
    at = START + dt.timedelta(minutes=minute)
    return [(name, r, c, rng.integers(0, 256, (TILE, TILE, 3), dtype=np.uint8).tobytes(), TILE, TILE, rows, cols, at) for r in range(rows) for c in range(cols)]


def streamed(spark, tmp_path, batches):
    """Rows of each batch, and the state's keys after the last."""
    feed, out, state = tmp_path / "feed", tmp_path / "out", None
    feed.mkdir()

    def run():
        tiles = spark.readStream.schema(SCHEMA).parquet(f"{feed}/*")
        made = strips.stream_blocks(tiles, BLOCK, TILE, PITCH, OVERLAP, SIGMA)
        query = made.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
        return [op for p in query.recentProgress for op in p["stateOperators"]]

    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{feed}/{n}")
        state = _with_rocksdb(spark, run)
    return spark.read.parquet(str(out)).collect(), state


def wanted(spark, rows):
    placed = grid.tile_block_map(spark.createDataFrame(rows, SCHEMA), BLOCK, TILE, PITCH)
    return {(r["slide"], r["block_row"], r["block_col"]): bytes(r["data"]) for r in blend.blend_blocks(placed, BLOCK, TILE, PITCH, OVERLAP, SIGMA).collect()}


def images(rows, status):
    return {(r["slide"], r["block_row"], r["block_col"]): bytes(r["data"]) for r in rows if r["status"] == status}


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (4, 2)])
def test_expected_tiles_are_those_that_a_grid_places(spark, shape):
    tiles = spark.createDataFrame(slide("s", *shape, 0), SCHEMA)
    placed = grid.tile_block_map(tiles, BLOCK, TILE, PITCH)
    found = placed.groupBy("block_row", "block_col").agg(F.count("*").alias("n"), F.first(strips.expected_tiles(BLOCK, TILE, PITCH)).alias("e")).collect()
    assert found and all(r["n"] == r["e"] for r in found)


def test_blocks_leave_once_and_equal_the_batch_form(spark, tmp_path):
    rows = slide("a", 3, 4, 1) + slide("b", 2, 2, 2)
    mixed = [rows[i] for i in np.random.default_rng(0).permutation(len(rows))]
    again = mixed[:3]  # a source that sends tiles twice
    partial = slide("c", 2, 3, 3)[:-1]
    flush = slide("z", 1, 1, 4, minute=600)
    out, state = streamed(spark, tmp_path, [mixed[:7], again + mixed[7:] + partial, flush])
    whole = images(out, "whole")
    assert whole | images(out, "partial") == wanted(spark, rows + partial + flush)
    assert len([r for r in out if r["status"] in ("whole", "partial")]) == len(whole) + len(images(out, "partial"))
    assert {k[0] for k in images(out, "partial")} == {"c"}
    # what is left are the tiles' marks of the last slide alone
    blocks = len([k for k in whole if k[0] == "z"])
    assert state[-1]["numRowsTotal"] <= 4 * blocks


def test_late_tiles_have_a_stated_fate(spark, tmp_path):
    rows = slide("a", 1, 1, 5)
    late = [(*rows[0][:-1], START + dt.timedelta(minutes=1))]
    gone = [(*slide("b", 1, 2, 6)[0][:-1], START)]  # behind the watermark by then
    out, _ = streamed(spark, tmp_path, [rows, late, slide("z", 1, 1, 7, minute=600), gone])
    fates = [(r["slide"], r["status"], r["row"], r["col"], r["data"] is None) for r in out if r["slide"] != "z"]
    blocks = len(wanted(spark, rows))
    assert sorted(fates, key=str) == sorted([("a", "whole", None, None, False)] * blocks + [("a", "late", 0, 0, True)] * blocks, key=str)


class Held:
    """State of one bucket in this process, and the number of calls to it."""

    def __init__(self):
        self.value, self.tiles, self.timers, self.calls = None, {}, set(), 0

    def getMapState(self, name, *_):
        return self

    def getValueState(self, name, *_):
        return self

    def _called(self, result=None):
        self.calls += 1
        return result

    def get(self):
        return self._called(self.value)

    def update(self, value):
        self.value = self._called(value)

    def clear(self):
        self.value = self._called()

    def updateValue(self, key, value):
        self.tiles[key] = self._called(value)

    def getValue(self, key):
        return self._called(self.tiles[key])

    def removeKey(self, key):
        del self.tiles[self._called(key)]

    def registerTimer(self, at):
        self.timers.add(self._called(at))

    def deleteTimer(self, at):
        self.timers.remove(self._called(at))


def held_blocks(spark, rows):
    """A bucket's processor, its state, and the rows that it gets for tiles, a minute of a slide's in milliseconds from START."""
    made, state = strips.FinishedBlocks(BLOCK, TILE, PITCH, OVERLAP, SIGMA, 1e-8, 600_000), Held()
    made.init(state)
    placed = grid.tile_block_map(spark.createDataFrame(rows, SCHEMA), BLOCK, TILE, PITCH)
    columns = ["slide", "block_row", "block_col", "row", "col", "data", "h", "w", strips.expected_tiles(BLOCK, TILE, PITCH).alias("expected"), (F.unix_millis("at") - int(START.timestamp() * 1000)).alias("at_ms")]
    return made, state, placed.select(*columns).toPandas()


def blocks_of(frames):
    return {(r.slide, r.block_row, r.block_col): (r.status, bytes(r.data)) for f in frames for r in f.itertuples(index=False)}


def test_calls_to_the_state_do_not_grow_with_the_blocks(spark):
    rows = [t for n in range(12) for t in slide(f"s{n}", 3, 4, n)]
    made, state, got = held_blocks(spark, rows)
    found = blocks_of(made.handleInputRows((0,), iter([got]), None))
    assert found == {at: ("whole", data) for at, data in wanted(spark, rows).items()} and len(found) > 50
    assert state.calls <= 3 and not state.tiles and len(state.timers) == 1


def test_tiles_beyond_what_a_call_holds_wait_in_the_state(spark, monkeypatch):
    rows = slide("a", 3, 4, 1) + slide("b", 3, 4, 2, minute=5) + slide("c", 2, 3, 3)[:-1]
    made, state, got = held_blocks(spark, rows)
    monkeypatch.setattr(strips, "HELD", 3 * TILE * TILE * 3)
    monkeypatch.setattr(strips, "SENT", 1)
    got = got.sample(frac=1, random_state=0)
    found = blocks_of(made.handleInputRows((0,), iter([got[:40], got[40:]]), None))
    assert state.calls > 20  # some did wait there
    assert {at[0] for at in found} == {"a", "b", "c"} and {s for s, _ in found.values()} == {"whole"}
    assert {k[:3] for k in state.tiles} == {at for at in wanted(spark, rows) if at not in found}

    class Fired:
        def __init__(self, at):
            self.at = at

        def getExpiryTimeInMs(self):
            return self.at

        def getCurrentWatermarkInMs(self):
            return self.at

    (first,) = state.timers
    assert first == 600_000
    state.timers.clear()
    rest = blocks_of(made.handleExpiredTimer((0,), Fired(first), Fired(first)))
    assert {s for s, _ in rest.values()} == {"partial"} and {at[0] for at in rest} == {"c"} and not state.tiles
    assert {at: data for at, (_, data) in (found | rest).items()} == wanted(spark, rows)
    assert state.timers == {900_000}  # of what came later
    late = list(made.handleInputRows((0,), iter([got[got.slide == "b"][:1]]), None))
    assert [(f.status[0], f.data[0]) for f in late] == [("late", None)]
    state.timers.clear()
    assert not list(made.handleExpiredTimer((0,), Fired(900_000), Fired(900_000))) and state.value is None and not state.timers
