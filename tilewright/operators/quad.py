"""Boxes that overlap, met in cells that follow the boxes' sizes and crowds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BOX = ("x1", "y1", "x2", "y2")

#: Boxes of one side that meet as one group at most; fuller cells are dealt in parts of about so many.
CROWD = 512

#: Full cells that are broadcast at most; more are joined.
BROADCAST_CELLS = 100_000


def settled(df: DataFrame) -> DataFrame:
    """Computed once: in the checkpoint folder if there is one, so that it survives its executors."""
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df.persist()


def _spread(boxes: DataFrame, level: str, slide: str) -> DataFrame:
    """A row for each cell of side 2^``level`` that a box reaches."""
    def reached(axis: str) -> Column:
        first, last = (F.floor(F.col("box")[c] / F.pow(F.lit(2.0), F.col(level))) for c in (f"{axis}1", f"{axis}2"))
        return F.sequence(first, last)

    columns = boxes.select(slide, F.col(level).alias("cell"), "own", "id", "box", F.explode(reached("x")).alias("cx"), reached("y").alias("__rows"))
    return columns.withColumn("cy", F.explode("__rows")).drop("__rows")


def dealt(detections: DataFrame, slide: str = "wsi_name", key: str = "instance_id", crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Residents (id_a, a) and visitors (id_b, b) by (slide, cell, cx, cy, part_a, part_b).

    A box resides in cells no smaller than its longer side, so it has at most four, and visits those of its own
    and of each greater side in use. Boxes of one slide that overlap meet as a resident and a visitor. Where a cell holds more than
    ``crowd`` of either, the residents are dealt to parts, and so are the visitors, and each part meets each.
    Boxes without area or with a null side overlap nothing and are left out. A job tells the sides in use
    (a row for each power of two) and, where a slide may have so many boxes, another the full cells.
    """
    place = [slide, "cell", "cx", "cy"]
    box = F.struct(*[F.col(c).cast("double").alias(c) for c in _BOX])
    side = F.greatest(F.col("box.x2") - F.col("box.x1"), F.col("box.y2") - F.col("box.y1"))
    boxes = detections.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).select(slide, F.col(key).alias("id"), box.alias("box"))
    boxes = boxes.withColumn("own", F.ceil(F.log2(side)).cast("int"))
    most = boxes.groupBy(slide, "own").agg(F.count("*").alias("n")).groupBy("own").agg(F.max("n").alias("n")).collect()
    used = sorted(r["own"] for r in most)
    greater = F.filter(F.array(*[F.lit(x) for x in used]).cast("array<int>"), lambda x: x >= F.col("own"))
    residents, visitors = _spread(boxes, "own", slide), _spread(boxes.withColumn("at", F.explode(greater)), "at", slide)

    full, n = None, 0
    if sum(r["n"] for r in most) > crowd:  # else no slide has so many boxes
        # a box visits each cell that it resides in, so visitors alone tell both counts
        counted = visitors.groupBy(*place).agg(F.count_if(F.col("own") == F.col("cell")).alias("n_a"), F.count("*").alias("n_b")).filter(F.col("n_b") > crowd)
        full = settled(counted.select(*place, *[F.greatest(F.ceil(F.col(f"n_{s}") / crowd), F.lit(1)).cast("int").alias(f"parts_{s}") for s in "ab"]))
        n = full.count()
    whole = F.lit(0).alias("part_a"), F.lit(0).alias("part_b")

    def side_of(rows: DataFrame, own: str, other: str) -> DataFrame:
        named = [F.col("id").alias(f"id_{own}"), F.col("box").alias(own), F.col("own").alias(f"own_{own}")]
        if n == 0:
            return rows.select(*place, *named, *whole)
        rows = rows.join(F.broadcast(full) if n <= BROADCAST_CELLS else full, place, "left")
        mine = F.pmod(F.xxhash64("id", "box"), F.coalesce(f"parts_{own}", F.lit(1))).cast("int").alias(f"part_{own}")
        return rows.select(*place, *named, mine, F.explode(F.sequence(F.lit(0), F.coalesce(f"parts_{other}", F.lit(1)) - 1)).alias(f"part_{other}"))

    return side_of(residents, "a", "b"), side_of(visitors, "b", "a")


def overlapping(detections: DataFrame, slide: str = "wsi_name", key: str = "instance_id", crowd: int = CROWD) -> DataFrame:
    """(slide, id_a, id_b, one, other) of boxes of different ids that share an area, each pair once, id_a the lesser id, the boxes in either order: an equi-join on cells.

    A pair counts in the first cell that both reach. No box is in more than four cells of a side, and no group has more than about
    ``crowd`` boxes a side, whether boxes are of one pixel or of a slide and wherever they crowd.
    """
    residents, visitors = dealt(detections, slide, key, crowd)
    pairs = residents.join(visitors, [slide, "cell", "cx", "cy", "part_a", "part_b"])
    pairs = pairs.filter(((F.col("own_a") > F.col("own_b")) & (F.col("id_a") != F.col("id_b"))) | ((F.col("own_a") == F.col("own_b")) & (F.col("id_a") < F.col("id_b"))))
    for axis in "xy":
        start = F.greatest(F.col(f"a.{axis}1"), F.col(f"b.{axis}1"))
        pairs = pairs.filter((F.floor(start / F.pow(F.lit(2.0), F.col("cell"))) == F.col(f"c{axis}")) & (start < F.least(F.col(f"a.{axis}2"), F.col(f"b.{axis}2"))))
    return pairs.select(slide, F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), F.col("a").alias("one"), F.col("b").alias("other"))
