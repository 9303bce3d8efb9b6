"""Scored objects to records, summaries and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.config import ShapeConfig
from tilewright.functions import shape
from tilewright.schemas import NUCLEUS_RECORD, RECORD_LENGTHS


def scored(nuclei: DataFrame, config: ShapeConfig = ShapeConfig()) -> DataFrame:
    """Add is_abnormal (before the clamp), abnormality_score and abnormality_reasons."""
    columns = ("circularity", "aspect_ratio", "edge_roughness", "solidity")
    raw = nuclei.withColumn("__raw", shape.raw_score(*columns, config))
    return raw.withColumns({
        "is_abnormal": F.col("__raw") >= config.abnormal_score,
        "abnormality_score": F.least(F.col("__raw"), F.lit(1.0)),
        "abnormality_reasons": shape.reasons(*columns, config),
    }).drop("__raw")


def ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def screening_summary(nuclei: DataFrame, *keys: str) -> DataFrame:
    """Objects, abnormal ones and their ratio by ``keys``."""
    out = nuclei.groupBy(*keys).agg(F.count("*").alias("total_nuclei"), F.count_if("is_abnormal").alias("total_abnormal"))
    return out.withColumn("abnormal_ratio", ratio(F.col("total_abnormal"), F.col("total_nuclei")))


def tile_summary(nuclei: DataFrame, slide: str = "wsi_name") -> DataFrame:
    return nuclei.groupBy(slide, "tile_row", "tile_col").agg(F.count("*").alias("num_nuclei"), F.count_if("is_abnormal").alias("num_abnormal"))


def screening_rollup(nuclei: DataFrame, slide: str = "wsi_name") -> DataFrame:
    """Totals by slide and tile row, by slide, and over all; one pass by ROLLUP."""
    out = nuclei.rollup(slide, "tile_row").agg(F.count("*").alias("total_nuclei"), F.count_if("is_abnormal").alias("total_abnormal"))
    return out.withColumn("abnormal_ratio", ratio(F.col("total_abnormal"), F.col("total_nuclei")))


def pipeline_stats(nuclei: DataFrame, slide: str = "wsi_name") -> DataFrame:
    """The five counters of a run: tiles, detections, described objects, abnormal ones, stored records."""
    tile = F.struct(slide, "tile_row", "tile_col")
    described = F.col("described")
    return nuclei.agg(
        F.countDistinct(tile).alias("tiles_processed"),
        F.count("*").alias("nuclei_detected"),
        F.count_if(described).alias("nuclei_analyzed"),
        F.count_if(described & F.col("is_abnormal")).alias("abnormal_nuclei"),
        F.count_if(described & F.col("is_abnormal")).alias("records_stored"),
    )


def abnormal_summary(nuclei: DataFrame) -> DataFrame:
    """The abnormal objects' eight report fields."""
    return nuclei.filter("is_abnormal").select("instance_id", "centroid", "bbox", "circularity", "aspect_ratio", "edge_roughness", "abnormality_score", "abnormality_reasons")


def feature_records(nuclei: DataFrame) -> DataFrame:
    """NUCLEUS rows with wsi_name, task_id, tile_row and tile_col to store records.

    The record id is drawn from the row's place, so that a repeated run names a record alike.
    """
    place = F.concat_ws("|", "wsi_name", "task_id", "tile_row", "tile_col", "instance_id")
    flat = {
        "record_id": F.concat_ws("_", "task_id", "instance_id", F.substring(F.sha2(place, 256), 1, 8)),
        "centroid_x": F.col("centroid.x"), "centroid_y": F.col("centroid.y"),
        "bbox_x": F.col("bbox.x"), "bbox_y": F.col("bbox.y"), "bbox_w": F.col("bbox.w"), "bbox_h": F.col("bbox.h"),
        "abnormality_reasons": F.concat_ws("; ", "abnormality_reasons"),
        "polygon_coords": F.to_json(F.transform("contour", lambda p: F.array(p["x"], p["y"]))),
    }
    return nuclei.select(*[flat.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in NUCLEUS_RECORD.fields])


def overlong(records: DataFrame) -> DataFrame:
    """Records with a string beyond its column's length, and which."""
    which = F.array_compact(F.array(*[F.when(F.length(c) > n, F.lit(c)) for c, n in RECORD_LENGTHS.items()]))
    return records.select("record_id", which.alias("columns")).filter(F.size("columns") > 0)
