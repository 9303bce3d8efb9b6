"""Pairs of boxes of any size and crowd, against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from tilewright.operators import detect, quad

SCHEMA = "wsi_name string, instance_id int, score double, x1 double, y1 double, x2 double, y2 double"


def all_pairs(rows):
    return {
        (a[0], a[1], b[1]) for a in rows for b in rows
        if a[0] == b[0] and a[1] < b[1] and min(a[5], b[5]) > max(a[3], b[3]) and min(a[6], b[6]) > max(a[4], b[4])
    }


def found(df, crowd=quad.CROWD):
    rows = [tuple(r) for r in quad.overlapping(df, crowd=crowd).select("wsi_name", "id_a", "id_b").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def mixed(n=240, seed=4):
    """Sides from a sixteenth of a pixel to the whole slide, some at or left of 0."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        w, h = 2.0 ** rng.integers(-4, 13, 2)
        x, y = rng.uniform(-500, 4000, 2)
        rows.append((f"s{i % 2}", i, float(rng.random()), float(x), float(y), float(x + w), float(y + h)))
    return rows


def test_boxes_of_all_sizes_equal_all_pairs(spark):
    rows = mixed()
    df = spark.createDataFrame(rows, SCHEMA)
    want = all_pairs(rows)
    assert want and found(df) == want
    assert found(df, crowd=3) == want  # every cell is full


def test_a_box_is_in_few_cells_whatever_its_size(spark):
    df = spark.createDataFrame([("s", 0, 1.0, 0.0, 0.0, 1e6, 1e6), ("s", 1, 1.0, 7.0, 7.0, 8.0, 8.0)], SCHEMA)
    residents, visitors = quad.dealt(df)
    assert residents.count() <= 8 and visitors.count() <= 12
    assert found(df) == {("s", 0, 1)}


def test_a_crowd_in_one_cell_is_dealt_evenly(spark):
    rng = np.random.default_rng(0)
    rows = [("s", i, 0.5, float(x), float(y), float(x + 0.51), float(y + 0.51)) for i, (x, y) in enumerate(rng.uniform(0, 0.4, (600, 2)))]
    df = spark.createDataFrame(rows, SCHEMA)
    residents, visitors = quad.dealt(df, crowd=50)
    for side in (residents, visitors):
        sizes = np.array([r["count"] for r in side.groupBy("cell", "cx", "cy", "part_a", "part_b").count().collect()])
        assert len(sizes) >= 144 and sizes.max() <= 3 * np.median(sizes)
    assert found(df, crowd=50) == all_pairs(rows)


def test_what_overlaps_nothing_has_no_pair(spark):
    rows = [("s", 1, 0.5, 0.0, 0.0, 4.0, 4.0), ("s", 2, 0.5, 4.0, 0.0, 8.0, 4.0), ("s", 3, 0.5, 1.0, 1.0, 1.0, 3.0), ("s", 4, 0.5, 3.0, 3.0, 1.0, 1.0), ("s", 5, 0.5, None, 0.0, 4.0, 4.0), ("s", 1, 0.5, 0.0, 0.0, 64.0, 64.0), (None, 6, 0.5, 0.0, 0.0, 4.0, 4.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == {("s", 1, 2)}  # the great box of id 1; equal ids are no pair
    assert quad.overlapping(df.limit(0)).count() == 0


def test_suppression_over_crowds_equals_the_fold(spark):
    rows = [(s, i, score, *(8 * c for c in at)) for s, i, score, *at in mixed(150, 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(r["wsi_name"], r["instance_id"]) for r in detect.nms(df, 0.1).collect()}
    assert {(r["wsi_name"], r["instance_id"]) for r in detect.nms_by_rounds(df, 0.1, crowd=4).collect()} == want


def test_no_plan_has_a_cartesian_product(spark):
    plan = quad.overlapping(spark.createDataFrame(mixed(40), SCHEMA).withColumn("extra", F.lit(1)))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
