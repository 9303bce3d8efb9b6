"""Row schemas; every source and store uses them instead of inference."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


_S, _I, _L, _D, _F = StringType(), IntegerType(), LongType(), DoubleType(), FloatType()

POINT = _struct(x=_D, y=_D)
CONTOUR = ArrayType(POINT)

TILE = _struct(tile_id=_S, wsi_path=_S, x=_I, y=_I, width=_I, height=_I, level=_I, row=_I, col=_I, total_rows=_I, total_cols=_I)
TILE_DATA = StructType([*TILE.fields, StructField("data", BinaryType()), StructField("shape", ArrayType(_I)), StructField("dtype", _S)])
DETECTION = _struct(wsi_name=_S, task_id=_S, tile_row=_I, tile_col=_I, instance_id=_I, x1=_D, y1=_D, x2=_D, y2=_D, score=_D, label=_I, contour=CONTOUR)
NUCLEUS = _struct(
    instance_id=_I, contour=CONTOUR, bbox=_struct(x=_I, y=_I, w=_I, h=_I), centroid=POINT, area=_D, perimeter=_D, circularity=_D, aspect_ratio=_D,
    major_axis_length=_D, minor_axis_length=_D, eccentricity=_D, edge_roughness=_D, solidity=_D, convexity=_D, form_factor=_D, roundness=_D,
    is_abnormal=BooleanType(), abnormality_score=_D, abnormality_reasons=ArrayType(_S), feature_vector=ArrayType(_F),
)
NUCLEUS_RECORD = _struct(
    record_id=_S, wsi_name=_S, task_id=_S, tile_row=_I, tile_col=_I, centroid_x=_F, centroid_y=_F, bbox_x=_I, bbox_y=_I, bbox_w=_I, bbox_h=_I,
    area=_F, perimeter=_F, circularity=_F, aspect_ratio=_F, edge_roughness=_F, solidity=_F, convexity=_F, eccentricity=_F,
    abnormality_score=_F, abnormality_reasons=_S, feature_vector=ArrayType(_F), polygon_coords=_S,
)
#: Longest strings that a record may hold, in characters.
RECORD_LENGTHS = {"record_id": 128, "wsi_name": 256, "task_id": 128, "abnormality_reasons": 512, "polygon_coords": 4096}
TASK = _struct(task_id=_S, name=_S, state=_S, batch_idx=_I, total_batches=_I, progress=_D, error=_S, seq=_L)
