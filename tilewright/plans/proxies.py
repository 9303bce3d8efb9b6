"""Stand-ins for slides, tiles, objects, vectors and tasks, derived from the driver's tables.

Each has a DataFrame form and the same derivation as a DuckDB common table expression.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geometry, shape
from tilewright.operators import report


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores: a table of few bytes is read by few tasks, whatever its rows cost."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


def once(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` computed once a row; the optimizer would put their expressions in place of each of their uses."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode(F.array(F.struct(*columns))).alias("__once")).select(*[F.col(f"__once.{c}").alias(c) if c in columns else c for c in df.columns])


def nuclei(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    rows = t.select(
        F.concat(F.lit("slide_"), "l_suppkey").alias("wsi_name"),
        (F.col("l_orderkey") % 8).cast("int").alias("tile_row"),
        (F.col("l_partkey") % 8).cast("int").alias("tile_col"),
        F.col("l_linenumber").alias("instance_id"),
        F.col("l_orderkey").alias("source_id"),
        (q * q * 25.0).alias("area"),
        (q * 5.0 * math.sqrt(12.566) * (F.lit(1.0) + (F.col("l_orderkey") % 40) / 10.0)).alias("perimeter"),
        (F.lit(1.0) + F.col("l_discount") * 60.0).alias("aspect_ratio"),
        (F.col("l_tax") * 12.0).alias("edge_roughness"),
        (F.lit(0.1) + (F.col("l_partkey") % 90) / 100.0).alias("solidity"),
    )
    return rows.withColumn("circularity", shape.circularity("area", "perimeter"))


NUCLEI = """
nuclei AS (
    SELECT *, CASE WHEN area > 0 AND perimeter > 0 THEN least(4 * pi() * area / (perimeter * perimeter), 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS circularity
    FROM (
        SELECT 'slide_' || l_suppkey AS wsi_name, CAST(l_orderkey % 8 AS INTEGER) AS tile_row, CAST(l_partkey % 8 AS INTEGER) AS tile_col, l_linenumber AS instance_id, l_orderkey AS source_id,
               l_quantity * l_quantity * 25.0::DOUBLE AS area,
               l_quantity * 5.0::DOUBLE * sqrt(12.566::DOUBLE) * (1.0::DOUBLE + (l_orderkey % 40) / 10.0::DOUBLE) AS perimeter,
               1.0::DOUBLE + l_discount * 60.0::DOUBLE AS aspect_ratio, l_tax * 12.0::DOUBLE AS edge_roughness,
               0.1::DOUBLE + (l_partkey % 90) / 100.0::DOUBLE AS solidity
        FROM lineitem
    )
)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gated and scored nuclei."""
    return report.scored(nuclei(spark, sf_dir).filter(shape.gate("area", "perimeter")))


SCORED = (
    NUCLEI
    + """,
raw AS (
    SELECT *, CASE WHEN circularity < 0.55 THEN (0.55::DOUBLE - circularity) / 0.55::DOUBLE * 0.35::DOUBLE ELSE 0.0::DOUBLE END
            + CASE WHEN aspect_ratio > 3 THEN least((aspect_ratio - 3.0::DOUBLE) / 3.0::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE ELSE 0.0::DOUBLE END
            + CASE WHEN edge_roughness > 0.4 THEN least((edge_roughness - 0.4::DOUBLE) / (1.0::DOUBLE - 0.4::DOUBLE), 1.0::DOUBLE) * 0.25::DOUBLE ELSE 0.0::DOUBLE END
            + CASE WHEN solidity < 0.7 THEN (0.7::DOUBLE - solidity) / 0.7::DOUBLE * 0.15::DOUBLE ELSE 0.0::DOUBLE END AS s
    FROM nuclei WHERE area BETWEEN 100 AND 50000 AND perimeter > 0
),
scored AS (
    SELECT *, s >= 0.6::DOUBLE AS is_abnormal, least(s, 1.0::DOUBLE) AS abnormality_score,
           concat_ws('; ', CASE WHEN circularity < 0.55 THEN printf('low_circularity(%.3f)', circularity) END,
                           CASE WHEN aspect_ratio > 3 THEN printf('high_aspect_ratio(%.2f)', aspect_ratio) END,
                           CASE WHEN edge_roughness > 0.4 THEN printf('high_edge_roughness(%.3f)', edge_roughness) END,
                           CASE WHEN solidity < 0.7 THEN printf('low_solidity(%.3f)', solidity) END) AS reasons
    FROM raw
)"""
)


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", "p_size",
        F.concat(F.lit("s"), "p_partkey").alias("stem"), F.concat(F.lit("/slides/s"), "p_partkey", F.lit(".svs")).alias("wsi_path"), F.concat(F.lit("s"), "p_partkey").alias("wsi_name"),
        (F.col("p_size") * 97 + 400).alias("w"), (F.col("p_size") * 61 + 300).alias("h"),
        (F.col("p_partkey") % 7 * 16).cast("int").alias("x0"), (F.col("p_partkey") % 5 * 16).cast("int").alias("y0"),
    )


SLIDES = """
slides AS (
    SELECT p_partkey, p_size, 's' || p_partkey AS stem, '/slides/s' || p_partkey || '.svs' AS wsi_path, 's' || p_partkey AS wsi_name, p_size * 97 + 400 AS w, p_size * 61 + 300 AS h,
           CAST(p_partkey % 7 * 16 AS INTEGER) AS x0, CAST(p_partkey % 5 * 16 AS INTEGER) AS y0
    FROM part
)"""

GRID = (
    SLIDES
    + """,
counted AS (SELECT *, CAST(greatest(1, ceil((h - 64) / 448)) AS INTEGER) AS total_rows, CAST(greatest(1, ceil((w - 64) / 448)) AS INTEGER) AS total_cols FROM slides),
placed AS (
    SELECT c.*, CAST(r.i AS INTEGER) AS row, CAST(k.i AS INTEGER) AS col, greatest(x0, x0 + k.i * 448 - 32) AS x, greatest(y0, y0 + r.i * 448 - 32) AS y
    FROM counted c, LATERAL unnest(range(total_rows)) r(i), LATERAL unnest(range(total_cols)) k(i)
),
tiles AS (
    SELECT printf('%s_r%04d_c%04d', stem, row, col) AS tile_id, wsi_path, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y,
           CAST(least(512, x0 + w - x) AS INTEGER) AS width, CAST(least(512, y0 + h - y) AS INTEGER) AS height, 0 AS level, row, col, total_rows, total_cols
    FROM placed
)"""
)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    x1, y1 = (i * 37 % 400).cast("double"), (i * 91 % 400).cast("double")
    return e.select(
        F.concat(F.lit("u"), "user_id").alias("wsi_name"), i.alias("instance_id"), F.col("value").alias("score"),
        (i % 4).cast("int").alias("tile_row"), (i % 3).cast("int").alias("tile_col"),
        x1.alias("x1"), y1.alias("y1"), (x1 + 20 + i % 60).alias("x2"), (y1 + 20 + i % 45).alias("y2"),
    )


DETECTIONS = """
detections AS (
    SELECT 'u' || user_id AS wsi_name, event_id AS instance_id, value AS score, CAST(event_id % 4 AS INTEGER) AS tile_row, CAST(event_id % 3 AS INTEGER) AS tile_col,
           CAST(event_id * 37 % 400 AS DOUBLE) AS x1, CAST(event_id * 91 % 400 AS DOUBLE) AS y1,
           CAST(event_id * 37 % 400 + 20 + event_id % 60 AS DOUBLE) AS x2, CAST(event_id * 91 % 400 + 20 + event_id % 45 AS DOUBLE) AS y2
    FROM events
)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    k = (i % 97).cast("double")
    return e.select(
        (F.col("user_id") % 10).alias("slide"), (i * 7 % 64).cast("int").alias("y"), (i * 13 % 61).cast("int").alias("x"), i.alias("event_id"),
        F.col("value").alias("v"), F.exp(-(k * k) / 800.0).alias("weight_in"),
        (i * 37 % 256).cast("int").alias("r"), (i * 91 % 256).cast("int").alias("g"), (i * 53 % 256).cast("int").alias("b"),
    )


PIXELS = """
pixels AS (
    SELECT user_id % 10 AS slide, CAST(event_id * 7 % 64 AS INTEGER) AS y, CAST(event_id * 13 % 61 AS INTEGER) AS x, event_id, value AS v,
           exp(-(CAST(event_id % 97 AS DOUBLE) * CAST(event_id % 97 AS DOUBLE)) / 800.0::DOUBLE) AS weight_in,
           CAST(event_id * 37 % 256 AS INTEGER) AS r, CAST(event_id * 91 % 256 AS INTEGER) AS g, CAST(event_id * 53 % 256 AS INTEGER) AS b
    FROM events
)"""


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")), F.col("p_size") + 5
    angle = lambda i: i * (2 * math.pi) / n
    radius = lambda i: (F.lit(20) + F.pmod(i * 7 + F.col("p_partkey"), F.lit(5))).cast("double")
    points = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((radius(i) * F.cos(angle(i)) + 100.0).alias("x"), (radius(i) * F.sin(angle(i)) + 100.0).alias("y")))
    return once(p.select("p_partkey", n.alias("n"), points.alias("contour")), "contour")


POLYGONS = """
vertices AS (
    SELECT p_partkey, p_size + 5 AS n, i, CAST(20 + (7 * i + p_partkey) % 5 AS DOUBLE) * cos(i * (2 * pi()) / (p_size + 5)) + 100 AS x,
           CAST(20 + (7 * i + p_partkey) % 5 AS DOUBLE) * sin(i * (2 * pi()) / (p_size + 5)) + 100 AS y
    FROM part, LATERAL unnest(range(p_size + 5)) u(i)
),
edges AS (SELECT a.p_partkey, a.n, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM vertices a JOIN vertices b ON a.p_partkey = b.p_partkey AND b.i = (a.i + 1) % a.n)"""


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons with area and perimeter."""
    return once(polygons(spark, sf_dir).withColumn("area", geometry.polygon_area("contour")).withColumn("perimeter", geometry.polygon_perimeter("contour")), "area", "perimeter")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, s = table(spark, sf_dir, "orders"), F.col("o_orderstatus")
    state = F.when(s == "F", "SUCCESS").when(s == "O", "PROGRESS").when(s == "P", "PENDING").otherwise("FAILURE")
    return o.select(
        F.concat(F.lit("t"), "o_orderkey").alias("task_id"), state.alias("state"), (F.col("o_custkey") % 4).alias("worker"), F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("c"), "o_custkey").alias("job_id"), (F.col("o_orderkey") % 32).cast("int").alias("batch_idx"), F.lit(32).alias("total_batches"), F.col("o_totalprice").alias("size"),
    )


TASKS = """
tasks AS (
    SELECT 't' || o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'PROGRESS' WHEN 'P' THEN 'PENDING' ELSE 'FAILURE' END AS state, o_custkey % 4 AS worker,
           o_orderkey AS seq, 'c' || o_custkey AS job_id, CAST(o_orderkey % 32 AS INTEGER) AS batch_idx, 32 AS total_batches, o_totalprice AS size
    FROM orders
)"""


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    error = F.col("l_tax") + F.col("l_discount") + 0.01
    return t.select(F.col("l_linenumber").alias("epoch"), (F.col("l_orderkey") % 50).alias("batch"), (F.col("l_partkey") % 20).alias("image"), F.col("l_tax").alias("g_loss"), F.col("l_discount").alias("d_loss"), (error * error).alias("squared_error"))


LOSSES = """
losses AS (
    SELECT l_linenumber AS epoch, l_orderkey % 50 AS batch, l_partkey % 20 AS image, l_tax AS g_loss, l_discount AS d_loss,
           (l_tax + l_discount + 0.01::DOUBLE) * (l_tax + l_discount + 0.01::DOUBLE) AS squared_error
    FROM lineitem
)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("record_id"), F.concat(F.lit("slide_"), "label").alias("wsi_name"), F.col("embedding").alias("feature_vector"))


def probe_vector(dim: int = 64) -> list[float]:
    """A fixed query vector."""
    return [((i * 7) % 13 - 6) / 6.0 for i in range(dim)]


PROBE = "[" + ", ".join(repr(x) for x in probe_vector()) + "]::DOUBLE[]"
