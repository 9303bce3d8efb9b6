"""Detections: filters, overlap of boxes, greedy suppression, numbering and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.config import ScreenConfig
from tilewright.operators import quad

_BOX = ("x1", "y1", "x2", "y2")


def detection_filter(detections: DataFrame, min_score: float = ScreenConfig().min_score) -> DataFrame:
    return detections.filter(F.col("score") >= min_score)


def binarize(probability: Column, threshold: float = ScreenConfig().mask_threshold) -> Column:
    return (probability > threshold).cast("int")


def box_offset(detections: DataFrame, x: str = "off_x", y: str = "off_y") -> DataFrame:
    """Boxes in slide coordinates."""
    for c in _BOX:
        detections = detections.withColumn(c, F.col(c) + F.col(x if c[0] == "x" else y))
    return detections


def with_offsets(detections: DataFrame, tiles: DataFrame, keys: tuple[str, ...] = ("wsi_name", "tile_row", "tile_col")) -> DataFrame:
    return detections.join(tiles, list(keys))


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes (structs); null where neither has an area."""
    width = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    height = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    area = [(v["x2"] - v["x1"]) * (v["y2"] - v["y1"]) for v in (a, b)]
    return F.try_divide(width * height, area[0] + area[1] - width * height)


def iou_pairs(detections: DataFrame, slide: str = "wsi_name", key: str = "instance_id", crowd: int = quad.CROWD) -> DataFrame:
    """(slide, id_a, id_b, iou) of boxes that overlap, each pair once; they meet in cells of their size (quad.overlapping)."""
    pairs = quad.overlapping(detections, slide, key, crowd)
    return pairs.select(slide, "id_a", "id_b", iou(F.col("one"), F.col("other")).alias("iou")).filter("iou > 0")


def nms(detections: DataFrame, threshold: float = ScreenConfig().nms_iou, slide: str = "wsi_name", key: str = "instance_id") -> DataFrame:
    """Greedy suppression in each slide: by falling score (ties: key), keep a box that overlaps no kept one above ``threshold``.

    A fold over each slide's ordered boxes; the overlap of two boxes without area suppresses.
    For slides of many thousand boxes see nms_by_rounds.
    """
    box = F.struct((-F.col("score")).alias("order"), F.col(key).alias("id"), *[F.col(c).cast("double").alias(c) for c in _BOX])
    ordered = F.array_sort(F.collect_list(box))

    def step(kept: Column, b: Column) -> Column:
        clear = F.forall(kept, lambda k: F.coalesce(iou(k, b) <= threshold, F.lit(False)))
        return F.when(clear, F.concat(kept, F.array(b))).otherwise(kept)

    grouped = detections.groupBy(slide).agg(ordered.alias("boxes"))
    kept = F.aggregate("boxes", F.slice("boxes", 1, 0), step)
    return grouped.select(slide, F.explode(kept).alias("k")).select(slide, F.col("k.id").alias(key), (-F.col("k.order")).alias("score"), *[F.col(f"k.{c}") for c in _BOX])


def nms_by_rounds(detections: DataFrame, threshold: float = ScreenConfig().nms_iou, slide: str = "wsi_name", key: str = "instance_id", crowd: int = quad.CROWD) -> DataFrame:
    """nms without a fold, so that neither a crowded slide nor a crowd of boxes is one group.

    Boxes that overlap above ``threshold`` meet by an equi-join on cells, each pair from the
    better to the worse. In a round, boxes that no undecided box betters stay, and those that
    they better go; most pairs are decided in a few rounds. Of boxes without area, which suppress
    one another wherever they are, a slide's best stays.
    """
    order = F.struct((-F.col("score")).alias("order"), F.col(key).alias("id"))
    boxes = detections.select(slide, key, F.col("score").cast("double").alias("score"), *[F.col(c).cast("double").alias(c) for c in _BOX], order.alias("__order"))
    flat = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) == 0
    empty = boxes.filter(flat).groupBy(slide).agg(F.min_by(F.struct(key, "score", *_BOX), "__order").alias("b")).select(slide, "b.*")
    solid = boxes.filter(~flat)
    pairs = iou_pairs(solid, slide, "__order", crowd).filter(F.col("iou") > threshold)  # id_a is the better one
    left = quad.settled(pairs.select(slide, F.col("id_a").alias("better"), F.col("id_b").alias("worse")))
    gone = None
    while not left.isEmpty():
        best = left.join(left.select(slide, F.col("worse").alias("better")), [slide, "better"], "left_anti")
        lost = quad.settled(best.select(slide, "worse").distinct())
        gone = lost if gone is None else gone.unionByName(lost)
        # pairs of a box that went are decided, as are those of a box that stays
        last, left = left, quad.settled(left.join(lost, [slide, "worse"], "left_anti").join(lost.withColumnRenamed("worse", "better"), [slide, "better"], "left_anti"))
        left.count()
        last.unpersist()
    kept = solid if gone is None else solid.join(gone.withColumnRenamed("worse", "__order"), [slide, "__order"], "left_anti")
    return kept.select(slide, key, "score", *_BOX).unionByName(empty)


def instance_ids(detections: DataFrame, tile: tuple[str, ...], order: tuple[str, ...], keep: Column) -> DataFrame:
    """Number each tile's objects from 0 before ``keep`` removes some, so numbers have gaps."""
    numbered = detections.withColumn("instance_id", F.row_number().over(Window.partitionBy(*tile).orderBy(*order)) - 1)
    return numbered.filter(keep)


def largest_contour(contours: DataFrame, keys: tuple[str, ...], size: str = "area", tie: str = "contour_id") -> DataFrame:
    """The largest contour of each mask (ties: the least id)."""
    return contours.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in contours.columns if c not in keys]), F.struct(F.col(size), -F.col(tie))).alias("m")).select(*keys, "m.*")


def merged(parts: list[DataFrame]) -> DataFrame:
    """All tiles' detections as one table; overlaps stay (see nms)."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
