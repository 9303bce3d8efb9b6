"""Connected parts of masks, their holes and their outer borders, block by block.

A mask is a table of true cells (slide, my, mx). It is painted in square blocks; what lies inside a block is
labelled or traced there, and only borders are compared: labels along a block's sides, and the ends of border pieces. No
task sees a whole slide, but a contour is one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.operators import raster
from tilewright.operators.graph import components
from tilewright.sources.scratch import written

#: Cells a side of a block.
SIDE = 1024
#: Bits of a label within its block, and of a block within its task; 18 are left for the task.
_LABEL, _BLOCK = 23, 22
_HOME = ["slide", "block_row", "block_col"]


def paint(cells: DataFrame, side: int = SIDE, halo: int = 0, dense: bool = False) -> DataFrame:
    """(slide, block_row, block_col, mask) of true cells (slide, my, mx): a byte a cell, with ``halo`` cells of the blocks around.

    Blocks without a true cell are left out, unless ``dense``: then all blocks of a slide's extent are there.
    """
    width = side + 2 * halo

    def near(at: str) -> Column:
        return F.array_distinct(F.transform(F.array(F.lit(-halo), F.lit(0), F.lit(halo)), lambda d: F.floor((F.col(at) + d) / side).cast("int")))

    placed = cells.select("slide", "my", "mx", F.explode(near("my")).alias("block_row"), near("mx").alias("columns")).withColumn("block_col", F.explode("columns"))
    y, x = F.col("my") - F.col("block_row") * side + halo, F.col("mx") - F.col("block_col") * side + halo
    kind = dict(cells.dtypes)["slide"]

    def draw(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        mask = np.zeros(width * width, np.uint8)
        mask[rows.column("at").to_numpy()] = 1
        return pa.table([*[pa.array([k.as_py()], k.type) for k in key], pa.array([mask.tobytes()], pa.binary())], names=[*_HOME, "mask"])

    blocks = placed.select(*_HOME, (y * width + x).cast("int").alias("at")).groupBy(*_HOME).applyInArrow(draw, f"slide {kind}, block_row int, block_col int, mask binary")
    if not dense:
        return blocks
    ends = cells.groupBy("slide").agg(*[F.floor(f(c) / side).cast("int").alias(f"{n}_{c}") for c in ("my", "mx") for n, f in (("low", F.min), ("high", F.max))])
    rows = ends.withColumn("block_row", F.explode(F.sequence("low_my", "high_my"))).withColumn("block_col", F.explode(F.sequence("low_mx", "high_mx")))
    empty = F.unhex(F.repeat(F.lit("00"), width * width))
    return rows.join(blocks, _HOME, "left").select(*_HOME, F.coalesce("mask", empty).alias("mask"))


def _numbered() -> Iterator[int]:
    """Numbers of a task's blocks, no two alike in a job."""
    task, n = TaskContext.get().partitionId(), 0
    while True:
        if task >= 1 << 18 or n >= 1 << _BLOCK:
            raise ValueError("too many blocks: take larger ones")
        yield (task << _BLOCK | n) << _LABEL
        n += 1


def _labels(mask: bytes, side: int, background: bool) -> np.ndarray:
    true = np.frombuffer(mask, np.uint8).reshape(side, side) > 0
    return raster.label_parts(~true, diagonal=False)[0] if background else raster.label_parts(true)[0]


_SIDES = ("top", "bottom", "left", "right")


def label_blocks(blocks: DataFrame, side: int = SIDE, background: bool = False) -> tuple[DataFrame, DataFrame]:
    """Blocks with their number and sides' labels, and (id, component) of parts that go over a block's side.

    A part's id is its block's number and its label there. True cells hang together by their eight neighbours; with
    ``background`` false ones do, by their four.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _numbered()
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("number", *_SIDES)}
            for mask in batch.column("mask").to_pylist():
                labels = _labels(mask, side, background)
                if labels.max(initial=0) >= 1 << _LABEL:
                    raise ValueError("too many parts in a block: take smaller ones")
                number = next(numbers)
                rows["number"].append(number)
                for name, line in zip(_SIDES, (labels[0], labels[-1], labels[:, 0], labels[:, -1]), strict=True):
                    rows[name].append(np.where(line > 0, line + number, 0).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows["number"], pa.int64()), *[pa.array(rows[s], pa.list_(pa.int64())) for s in _SIDES]], names=[*batch.schema.names, "number", *_SIDES])

    kind = dict(blocks.dtypes)["slide"]
    schema = f"slide {kind}, block_row int, block_col int, mask binary, number long, " + ", ".join(f"{s} array<long>" for s in _SIDES)
    labelled = written(blocks.select(*_HOME, "mask").mapInArrow(run, schema), "part-blocks")

    def meeting(own: str, down: int, right: int, other: str, pairs: Callable[[Column, Column], Column]) -> DataFrame:
        """Pairs of labels of a block's side and of the side of the block ``down`` and ``right`` of it."""
        a = labelled.select(*_HOME, F.col(own).alias("a_line"))
        b = labelled.select("slide", (F.col("block_row") - down).alias("block_row"), (F.col("block_col") - right).alias("block_col"), F.col(other).alias("b_line"))
        return a.join(b, _HOME).select(F.explode(F.array_distinct(pairs(F.col("a_line"), F.col("b_line")))).alias("e")).select("e.a", "e.b").filter("a > 0 and b > 0")

    def pair(a: Column, b: Column) -> Column:
        return F.struct(F.coalesce(a, F.lit(0).cast("long")).alias("a"), F.coalesce(b, F.lit(0).cast("long")).alias("b"))

    def along(a: Column, b: Column) -> Column:
        def shifted(k: int) -> Column:
            return F.transform(a, lambda v, i: pair(v, F.when(i + k >= 0, F.get(b, i + k))))

        return F.concat(*[shifted(k) for k in ((0,) if background else (-1, 0, 1))])

    last = F.lit(side - 1)
    edges = meeting("bottom", 1, 0, "top", along).unionByName(meeting("right", 0, 1, "left", along))
    if not background:  # corners
        edges = edges.unionByName(meeting("bottom", 1, 1, "top", lambda a, b: F.array(pair(F.get(a, last), F.get(b, F.lit(0))))))
        edges = edges.unionByName(meeting("bottom", 1, -1, "top", lambda a, b: F.array(pair(F.get(a, F.lit(0)), F.get(b, last)))))
    return labelled, components(edges, "part-edges")


def _with_names(labelled: DataFrame, names: DataFrame) -> DataFrame:
    """Blocks with what is known of their parts: ``names`` (id, value) as arrays by block."""
    block = F.shiftright("id", _LABEL)
    by = names.groupBy(F.shiftleft(block, _LABEL).alias("number")).agg(F.collect_list(F.struct("id", "value")).alias("known"))
    return labelled.select(*_HOME, "mask", "number").join(by, "number", "left")


def label_parts(cells: DataFrame, side: int = SIDE) -> DataFrame:
    """(slide, my, mx, part) of true cells: a number for each 8-connected part, no two alike in the table."""
    labelled, joined = label_blocks(paint(cells, side), side)
    kind = dict(cells.dtypes)["slide"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slide, row, column, mask, number, known in zip(*(batch.column(c).to_pylist() for c in (*_HOME, "mask", "number", "known")), strict=True):
                labels = _labels(mask, side, False)
                names = np.arange(int(labels.max(initial=0)) + 1) + number
                for e in known or ():
                    names[e["id"] - number] = e["value"]
                y, x = np.nonzero(labels)
                arrays = [pa.array((y + row * side).astype(np.int32)), pa.array((x + column * side).astype(np.int32)), pa.array(names[labels[y, x]])]
                yield pa.RecordBatch.from_arrays([pa.array([slide] * len(y), batch.column("slide").type), *arrays], names=["slide", "my", "mx", "part"])

    named = _with_names(labelled, joined.select("id", F.col("component").alias("value")))
    return named.select(*_HOME, "mask", "number", "known").mapInArrow(run, f"slide {kind}, my int, mx int, part long")


def part_stats(cells: DataFrame, side: int = SIDE) -> DataFrame:
    """(slide, first_y, first_x, cells, y1, x1, y2, x2) of each 8-connected part: its first cell in row order, size and box."""
    found = label_parts(cells, side)
    first = F.min(F.struct("my", "mx"))
    out = found.groupBy("slide", "part").agg(first.alias("first"), F.count("*").alias("cells"), F.min("my").alias("y1"), F.min("mx").alias("x1"), F.max("my").alias("y2"), F.max("mx").alias("x2"))
    return out.select("slide", F.col("first.my").alias("first_y"), F.col("first.mx").alias("first_x"), "cells", "y1", "x1", "y2", "x2")


def fill_holes(cells: DataFrame, side: int = SIDE) -> DataFrame:
    """True cells with the false ones that the outside cannot reach by their four neighbours."""
    kind = dict(cells.dtypes)["slide"]
    labelled, joined = label_blocks(paint(cells, side, dense=True), side, background=True)
    # what lies at the side of the slide's extent is outside
    ends = labelled.groupBy("slide").agg(*[f(c).alias(f"{n}_{c}") for c in ("block_row", "block_col") for n, f in (("low", F.min), ("high", F.max))])
    placed = labelled.join(F.broadcast(ends) if ends.limit(10_001).count() <= 10_000 else ends, "slide")
    none = F.array().cast("array<long>")
    at_end = [F.when(F.col(c) == F.col(f"{n}_{c}"), F.col(s)).otherwise(none) for c, n, s in (("block_row", "low", "top"), ("block_row", "high", "bottom"), ("block_col", "low", "left"), ("block_col", "high", "right"))]
    outer = placed.select(F.explode(F.array_distinct(F.concat(*at_end))).alias("id")).filter("id > 0").distinct()
    named = outer.join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    gone = written(named.select("component").distinct(), "part-outer")
    known = joined.join(gone, "component", "left_semi").select("id").unionByName(named.select("id")).distinct().withColumn("value", F.lit(1).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slide, row, column, mask, number, outside in zip(*(batch.column(c).to_pylist() for c in (*_HOME, "mask", "number", "known")), strict=True):
                labels = _labels(mask, side, True)
                inside = np.ones(int(labels.max(initial=0)) + 1, bool)
                inside[[e["id"] - number for e in outside or ()]] = False
                y, x = np.nonzero(inside[labels])  # label 0 is true itself
                arrays = [pa.array((y + row * side).astype(np.int32)), pa.array((x + column * side).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([slide] * len(y), batch.column("slide").type), *arrays], names=["slide", "my", "mx"])

    return _with_names(labelled, known).select(*_HOME, "mask", "number", "known").mapInArrow(run, f"slide {kind}, my int, mx int")


# fixed by geometry: a cell's sides clockwise from the upper one, the way along each and the way out, y down
_ALONG = np.array([(0, 1), (1, 0), (0, -1), (-1, 0)])
_OUT = np.array([(-1, 0), (0, 1), (1, 0), (0, -1)])


def _ranked(after: np.ndarray) -> np.ndarray:
    """An order in which chains lie together, each from its first link; cycles begin at their least link. ``after`` is -1 at ends."""
    n = len(after)
    at, least = np.append(np.where(after < 0, n, after), n), np.append(np.arange(n), n)
    rounds = max(1, int(n).bit_length())
    p = at.copy()
    for _ in range(rounds):
        least, p = np.minimum(least, least[p]), p[p]
    cyclic = p[:n] != n
    # a cycle is cut before its least link
    at[:n][cyclic & (least[at[:n]] == at[:n])] = n
    distance, p, end = np.append(np.ones(n, np.int64), 0), at.copy(), np.append(np.where(at[:n] == n, np.arange(n), -1), -1)
    for _ in range(rounds):
        distance = distance + np.where(p == n, 0, distance[p])
        end = np.where(end < 0, end[p], end)
        p = p[p]
    return np.lexsort((-distance[:n], end[:n]))


def _pieces(mask: np.ndarray, side: int) -> tuple[np.ndarray, ...]:
    """Border pieces of a block painted with a halo of 1: places of sides (y, x, side) in order, where pieces begin, what follows each, and which are closed."""
    inner = mask[1:-1, 1:-1]
    y, x, s = (np.concatenate(v) for v in zip(*[(*np.nonzero(inner & ~mask[1 + dy : 1 + dy + side, 1 + dx : 1 + dx + side]), np.full(int((inner & ~mask[1 + dy : 1 + dy + side, 1 + dx : 1 + dx + side]).sum()), i)) for i, (dy, dx) in enumerate(_OUT)], strict=True))
    forward, corner = _ALONG[s], _ALONG[s] + _OUT[s]
    diagonal = mask[1 + y + corner[:, 0], 1 + x + corner[:, 1]]
    straight = mask[1 + y + forward[:, 0], 1 + x + forward[:, 1]]
    # round the outside of a cell met at the corner, along the next cell, or round the own corner
    ny = y + np.where(diagonal, corner[:, 0], np.where(straight, forward[:, 0], 0))
    nx = x + np.where(diagonal, corner[:, 1], np.where(straight, forward[:, 1], 0))
    ns = (s + np.where(diagonal, 3, np.where(straight, 0, 1))) % 4
    own = (ny >= 0) & (ny < side) & (nx >= 0) & (nx < side)
    key, following = (y * side + x) * 4 + s, (ny * side + nx) * 4 + ns
    by = np.argsort(key)
    after = np.full(len(key), -1)
    after[own] = by[np.searchsorted(key[by], following[own])]
    order = _ranked(after)
    follows = np.zeros(len(order), bool)
    follows[1:] = after[order[:-1]] == order[1:]
    begins = np.flatnonzero(~follows)
    lasts = np.append(begins[1:], len(order))[: len(begins)] - 1
    # a cycle's last link leads to its first, which the order cuts
    closed = after[order[lasts]] == order[begins]
    return y[order], x[order], s[order], begins, np.stack([ny, nx, ns], 1)[order[lasts]], closed


_POINTS = "array<struct<x: double, y: double>>"


def corners_of(cells: np.ndarray) -> list[tuple[int, int]]:
    """The (x, y) corners of a closed walk over cells (y, x), from its first cell in row order; of straight runs only the ends stay."""
    new = np.ones(len(cells), bool)
    new[1:] = (cells[1:] != cells[:-1]).any(axis=1)
    walk = cells[new]
    if len(walk) > 1 and (walk[0] == walk[-1]).all():
        walk = walk[:-1]
    if len(walk) >= 3:
        step = np.roll(walk, -1, axis=0) - walk
        walk = walk[(step != np.roll(step, 1, axis=0)).any(axis=1)]
    return [(int(px), int(py)) for py, px in walk]


def trace_contours(cells: DataFrame, side: int = SIDE) -> DataFrame:
    """(slide, contour_id, contour, area): outer borders of the 8-connected parts, numbered by their first cell in row order.

    What lies in a part's holes is its inside, other parts too. A border is walked along cells' sides: each block walks
    those of its cells, and pieces that leave a block are joined by the side that comes next. Pieces of one contour meet in
    the task that makes its row.
    """
    kind = dict(cells.dtypes)["slide"]
    blocks = paint(fill_holes(cells, side), side, halo=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _numbered()
        for batch in batches:
            for slide, row, column, data in zip(*(batch.column(c).to_pylist() for c in (*_HOME, "mask")), strict=True):
                number = next(numbers)
                y, x, s, begins, after, closed = _pieces(np.frombuffer(data, np.uint8).reshape(side + 2, side + 2) > 0, side)
                n = len(begins)
                if n >= 1 << _LABEL:
                    raise ValueError("too many border pieces in a block: take smaller ones")
                if not n:
                    continue
                y, x = y + row * side, x + column * side
                after = after + np.array([row * side, column * side, 0])
                offsets = pa.array(np.append(begins, len(y)).astype(np.int32))
                heads = [v[begins] for v in (y, x, s)]
                walks = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (y, x, s)]
                values = [pa.array([slide] * n, batch.column("slide").type), pa.array(np.arange(n) + number), pa.array(closed), *[pa.array(v.astype(np.int32)) for v in (*heads, *after.T)], *walks]
                yield pa.RecordBatch.from_arrays(values, names=["slide", "id", "closed", "y", "x", "s", "ny", "nx", "ns", "ys", "xs", "ss"])

    ends = "y int, x int, s int, ny int, nx int, ns int"
    pieces = written(blocks.mapInArrow(run, f"slide {kind}, id long, closed boolean, {ends}, ys array<int>, xs array<int>, ss array<int>"), "border-pieces")
    open_ = pieces.filter("not closed")
    following = open_.select("slide", F.col("id").alias("a"), F.col("ny").alias("y"), F.col("nx").alias("x"), F.col("ns").alias("s"))
    joined = components(following.join(open_.select("slide", "y", "x", "s", F.col("id").alias("b")), ["slide", "y", "x", "s"]).select("a", "b"), "border-edges")
    placed = pieces.join(joined, "id", "left").withColumn("contour", F.coalesce("component", "id"))

    def chain(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        by = {(r["y"], r["x"], r["s"]): r for r in rows.to_pylist()}
        at, walk = next(iter(by)), []
        for _ in range(len(by)):
            r = by[at]
            walk.append(np.stack([r["ys"], r["xs"], r["ss"]], 1))
            at = r["ny"], r["nx"], r["ns"]
        sides = np.concatenate(walk)
        first = np.lexsort((sides[:, 2], sides[:, 1], sides[:, 0]))[0]  # the upper side of the first cell
        points = corners_of(np.roll(sides, -first, axis=0)[:, :2])
        p = np.array(points, float)
        after = np.roll(p, -1, axis=0)
        area = abs(float((p[:, 0] * after[:, 1] - after[:, 0] * p[:, 1]).sum())) / 2
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])), pa.float64()]
        values = (int(sides[first, 0]), int(sides[first, 1]), [{"x": float(a), "y": float(b)} for a, b in points], area)
        return pa.table([pa.array([key[0].as_py()], key[0].type), *[pa.array([v], k) for v, k in zip(values, kinds, strict=True)]], names=["slide", "first_y", "first_x", "contour", "area"])

    found = placed.select("slide", "contour", *[e.split()[0] for e in ends.split(", ")], "ys", "xs", "ss").groupBy("slide", "contour").applyInArrow(chain, f"slide {kind}, first_y int, first_x int, contour {_POINTS}, area double")
    number = F.row_number().over(Window.partitionBy("slide").orderBy("first_y", "first_x")) - 1
    return found.select("slide", number.alias("contour_id"), "contour", "area")
