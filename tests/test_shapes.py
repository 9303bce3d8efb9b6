import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import geometry, shape
from tilewright.operators import report


def polygon(spark, points):
    return spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in points],)], "contour array<struct<x: double, y: double>>")


def ring(n, rx, ry=None, turn=0.0):
    a = np.arange(n) * 2 * np.pi / n
    x, y = rx * np.cos(a), (ry or rx) * np.sin(a)
    return np.stack([x * np.cos(turn) - y * np.sin(turn) + 300, x * np.sin(turn) + y * np.cos(turn) + 300], 1)


SQUARE, L_SHAPE = [(0, 0), (10, 0), (10, 10), (0, 10)], [(0, 0), (20, 0), (20, 10), (10, 10), (10, 20), (0, 20)]


@pytest.mark.parametrize(("points", "area", "perimeter", "centroid"), [(SQUARE, 100, 40, (5, 5)), (L_SHAPE, 300, 80, (25 / 3, 25 / 3)), ([(0, 0), (4, 0), (0, 3)], 6, 12, (4 / 3, 1))])
def test_measures_of_exact_shapes(spark, points, area, perimeter, centroid):
    row = polygon(spark, points).select(geometry.polygon_area("contour").alias("a"), geometry.polygon_perimeter("contour").alias("p"), geometry.polygon_centroid("contour").alias("c"), geometry.polygon_bbox("contour").alias("b")).first()
    assert row["a"] == pytest.approx(area)
    assert row["p"] == pytest.approx(perimeter)
    assert (row["c"]["x"], row["c"]["y"]) == pytest.approx(centroid)
    assert row["b"]["w"] == max(x for x, _ in points) + 1


def test_degenerate_polygons(spark):
    row = polygon(spark, [(1, 1), (1, 1)]).select(geometry.polygon_area("contour").alias("a"), geometry.polygon_centroid("contour").alias("c"), geometry.convex_hull("contour").alias("h"), geometry.ellipse_axes("contour").alias("e")).first()
    assert row["a"] == 0 and row["c"] is None and row["h"]["area"] == 0 and row["e"]["major"] == 0


def test_hull_of_l_shape():
    hull = geometry.hull_points(np.array(L_SHAPE, float))
    area, perimeter = geometry.ring_measures(hull)
    assert len(hull) == 5 and area == pytest.approx(350) and perimeter < 80


@pytest.mark.parametrize("turn", [0.0, 0.4, 1.3])
def test_ellipse_axes_are_found_whatever_the_turn(turn):
    major, minor = geometry.ellipse_axes_of(ring(40, 80, 30, turn))
    assert major == pytest.approx(160, rel=1e-6) and minor == pytest.approx(60, rel=1e-6)
    assert geometry.ellipse_axes_of(np.array(SQUARE, float)) == (0.0, 0.0)


def test_simplified_counts():
    square = [(x, 0) for x in range(10)] + [(10, y) for y in range(10)] + [(x, 10) for x in range(10, 0, -1)] + [(0, y) for y in range(10, 0, -1)]
    assert geometry.simplified(np.array(square, float), 0.5) == 4
    assert geometry.simplified(np.array([(0, 0), (1, 1)], float), 0.5) == 2


def test_ratios_keep_guard_values(spark):
    zero = spark.range(1).select(F.lit(0.0).alias("a"), F.lit(0.0).alias("p"))
    row = zero.select(shape.circularity("a", "p").alias("c"), shape.aspect_ratio("a", "p").alias("r"), shape.eccentricity("a", "p").alias("e"), shape.roundness("a", "p").alias("o"), shape.share("a", "p").alias("s")).first()
    assert tuple(row) == (0.0, 1.0, 0.0, 0.0, 0.0)


def test_circle_is_round_and_normal(spark):
    circle = polygon(spark, ring(200, 80)).withColumn("area", geometry.polygon_area("contour")).withColumn("perimeter", geometry.polygon_perimeter("contour")).withColumn("hull", geometry.convex_hull("contour"))
    row = report.scored(circle.select(shape.circularity("area", "perimeter").alias("circularity"), F.lit(1.0).alias("aspect_ratio"), F.lit(0.1).alias("edge_roughness"), shape.share("area", "hull.area").alias("solidity"))).first()
    assert row["circularity"] > 0.99 and row["solidity"] == pytest.approx(1) and not row["is_abnormal"] and row["abnormality_reasons"] == []


def test_score_counts_before_the_clamp_and_names_reasons(spark):
    rows = spark.createDataFrame([(0.0, 9.0, 1.0, 0.0), (0.55, 3.0, 0.4, 0.7), (0.0625, 1.0, 0.0, 1.0)], "circularity double, aspect_ratio double, edge_roughness double, solidity double")
    worst, edge, low = report.scored(rows).collect()
    assert worst["abnormality_score"] == pytest.approx(1.0) and worst["is_abnormal"] and len(worst["abnormality_reasons"]) == 4
    assert edge["abnormality_score"] == 0.0 and edge["abnormality_reasons"] == []
    assert low["abnormality_reasons"] == ["low_circularity(0.062)"]


def test_vector_is_ten_floats(spark):
    row = spark.range(1).select(shape.feature_vector(*[F.lit(x) for x in (5000.0, 260.0, 0.9, 11.0, 0.1, 0.98, 0.99, 0.1, 0.9, 0.95)]).alias("v")).first()
    assert len(row["v"]) == 10 and row["v"][3] == 1.0 and row["v"][0] == pytest.approx(math.log1p(5000))
