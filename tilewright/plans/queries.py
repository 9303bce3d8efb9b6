"""Named queries over the driver's tables, each beside its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geometry, shape
from tilewright.operators import area, blend, detect, grid, jobs, metrics, parts, raster, report, resample, search, shapes, tissue
from tilewright.plans import proxies as P
from tilewright.schemas import NUCLEUS_RECORD
from tilewright.sources import scratch, slides, tiff
from tilewright.sources.slides import admissible
from tilewright.sources.store import FeatureStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with SQL that yields the same rows if there is any."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to fixed digits, so that the order of sums does not show."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# -- slides, regions, sinks

_LEVELS = """
levels AS (SELECT s.*, CAST(l.i AS INTEGER) AS level, pow(2.0::DOUBLE, l.i) * (1 + (p_size % 3) * 0.5::DOUBLE) AS downsample FROM slides s, LATERAL unnest(range(4)) l(i))"""


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.slides(spark, sf_dir).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return s.withColumn("downsample", F.pow(F.lit(2.0), F.col("level")) * (F.lit(1.0) + (F.col("p_size") % 3) * 0.5))


@query(f"WITH {P.SLIDES}, {_LEVELS} SELECT wsi_path, level, CAST(floor(w / downsample) AS INTEGER) AS level_w, CAST(floor(h / downsample) AS INTEGER) AS level_h, downsample, 4::BIGINT AS level_count FROM levels")
def slide_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).select("wsi_path", "level", F.floor(F.col("w") / F.col("downsample")).cast("int").alias("level_w"), F.floor(F.col("h") / F.col("downsample")).cast("int").alias("level_h"), "downsample", F.lit(4).cast("long").alias("level_count"))


@query(f"WITH {P.SLIDES}, {_LEVELS} SELECT wsi_path, coalesce(max_by(level, downsample) FILTER (WHERE downsample <= 1 + p_size % 9), 0) AS best_level FROM levels GROUP BY wsi_path")
def best_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.col("p_size") % 9 + 1
    return _levels(spark, sf_dir).groupBy("wsi_path").agg(F.coalesce(F.max_by("level", F.when(F.col("downsample") <= wanted, F.col("downsample"))), F.lit(0)).alias("best_level"))


_MPP = "CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN '-0.5' ELSE CAST(p_size / 100.0::DOUBLE AS VARCHAR) END"


@query(f"""WITH {P.SLIDES}, m AS (SELECT wsi_path, try_cast({_MPP} AS DOUBLE) AS x FROM slides)
SELECT wsi_path, CASE WHEN x > 0 THEN x END AS mpp_x, CASE WHEN x > 0 THEN x END AS mpp_y, round(coalesce(CASE WHEN x > 0 THEN (x + x) / 2 / 0.25::DOUBLE END, 1.0::DOUBLE), 6) AS scaling FROM m""")
def mpp_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_size") % 5
    text = F.when(kind == 0, "").when(kind == 1, "n/a").when(kind == 2, "-0.5").otherwise((F.col("p_size") / 100.0).cast("string"))
    mpp = slides.mpp_of(text)
    return rounded(P.slides(spark, sf_dir).select("wsi_path", mpp.alias("mpp_x"), mpp.alias("mpp_y"), F.coalesce((mpp + mpp) / 2 / 0.25, F.lit(1.0)).alias("scaling")))


@query(f"WITH {P.PIXELS} SELECT slide, y, x, event_id, r, g, b FROM pixels WHERE x BETWEEN 8 AND 39 AND y BETWEEN 16 AND 47")
def region_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.region_scan(P.pixels(spark, sf_dir), 8, 16, 32, 32).select("slide", "y", "x", "event_id", "r", "g", "b")


@query(f"WITH {P.PIXELS} SELECT slide, CAST(floor(y / 8) AS INTEGER) AS y, CAST(floor(x / 8) AS INTEGER) AS x, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM pixels GROUP BY ALL")
def thumbnail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.thumbnail(P.pixels(spark, sf_dir), 8))


@query(f"""WITH {P.PIXELS}, o AS (SELECT slide, r, g, b, oy.i AS oy, ox.i AS ox, least((y + 1) * 27, (oy.i + 1) * 64) - greatest(y * 27, oy.i * 64) AS ay, least((x + 1) * 40, (ox.i + 1) * 61) - greatest(x * 40, ox.i * 61) AS ax
    FROM pixels, LATERAL unnest(range(27)) oy(i), LATERAL unnest(range(40)) ox(i) WHERE oy.i * 64 < (y + 1) * 27 AND (oy.i + 1) * 64 > y * 27 AND ox.i * 61 < (x + 1) * 40 AND (ox.i + 1) * 61 > x * 40)
SELECT slide, CAST(oy AS INTEGER) AS y, CAST(ox AS INTEGER) AS x, round(sum(r * ay * ax) / sum(ay * ax), 6) AS r, round(sum(g * ay * ax) / sum(ay * ax), 6) AS g, round(sum(b * ay * ax) / sum(ay * ax), 6) AS b FROM o GROUP BY ALL""")
def area_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides of 64 x 61 pixels at 27 x 40."""
    return rounded(resample.area_means(P.pixels(spark, sf_dir), (64, 61), (27, 40)))


@query(f"WITH {P.TASKS} SELECT task_id, state, batch_idx, total_batches, round(size, 6) AS size FROM tasks")
def run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.tasks(spark, sf_dir)
    document = F.to_json(F.struct("state", "batch_idx", "total_batches", "size"))
    parsed = F.from_json(document, "state string, batch_idx int, total_batches int, size double")
    return rounded(t.select("task_id", parsed.alias("m")).select("task_id", "m.*"))


@query(f"""WITH {P.PIXELS}, l0 AS (SELECT slide, y, x, avg(v) AS v FROM pixels GROUP BY ALL),
l1 AS (SELECT slide, CAST(floor(y / 2) AS INTEGER) AS y, CAST(floor(x / 2) AS INTEGER) AS x, avg(v) AS v FROM l0 GROUP BY ALL),
l2 AS (SELECT slide, CAST(floor(y / 2) AS INTEGER) AS y, CAST(floor(x / 2) AS INTEGER) AS x, avg(v) AS v FROM l1 GROUP BY ALL),
l3 AS (SELECT slide, CAST(floor(y / 2) AS INTEGER) AS y, CAST(floor(x / 2) AS INTEGER) AS x, avg(v) AS v FROM l2 GROUP BY ALL)
SELECT slide, 0 AS level, y, x, round(v, 9) AS v FROM l0 UNION ALL SELECT slide, 1, y, x, round(v, 9) FROM l1 UNION ALL SELECT slide, 2, y, x, round(v, 9) FROM l2 UNION ALL SELECT slide, 3, y, x, round(v, 9) FROM l3""")
def pyramid_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = P.pixels(spark, sf_dir).groupBy("slide", "y", "x").agg(F.avg("v").alias("v"))
    return rounded(blend.pyramid_levels(base), 9)


@query(f"WITH {P.SLIDES} SELECT wsi_path, round(CAST(w AS DOUBLE) * h * 3 / 2.0::DOUBLE / 1073741824.0::DOUBLE, 9) AS estimated_gib FROM slides")
def file_size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.file_size_estimate(P.slides(spark, sf_dir)), 9)


@query(f"WITH {P.SCORED} SELECT wsi_name, count(*) AS inserted FROM scored WHERE is_abnormal GROUP BY wsi_name")
def insert_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.scored(spark, sf_dir).filter("is_abnormal")
    given = {"record_id": F.concat_ws("_", "wsi_name", "source_id", "instance_id"), "feature_vector": F.array_repeat(F.lit(0.0), 10)}
    made = [given.get(f.name, F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in NUCLEUS_RECORD.fields]
    store = FeatureStore(spark, scratch.place(spark, "store"))
    store.create()
    store.insert(found.select(*made))
    return store.records().groupBy("wsi_name").agg(F.count("*").alias("inserted"))


@query("SELECT page_id, lower(regexp_extract(url, '\\.[^./]+$', 0)) AS suffix, CAST(length(html) AS BIGINT) AS size FROM pages WHERE lower(regexp_extract(url, '\\.[^./]+$', 0)) IN ('.html', '.com', '.org', '.net', '.tif') AND length(html) <= 20000")
def upload_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = P.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.length("html").cast("long").alias("length"))
    return admissible(pages, (".html", ".com", ".org", ".net", ".tif"), 20000, r"\.[^./]+$").select("page_id", "suffix", F.col("length").alias("size"))


# -- projections, filters, predicates


@query(f"WITH {P.DETECTIONS} SELECT wsi_name, instance_id, round(score, 6) AS score FROM detections WHERE score >= 50")
def detection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(detect.detection_filter(P.detections(spark, sf_dir), 50.0).select("wsi_name", "instance_id", "score"))


@query(f"WITH {P.PIXELS} SELECT slide, count(*) AS pixels, CAST(sum(CASE WHEN v / 100.0::DOUBLE > 0.5::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS set_pixels FROM pixels GROUP BY slide")
def mask_binarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pixels(spark, sf_dir).groupBy("slide").agg(F.count("*").alias("pixels"), F.sum(detect.binarize(F.col("v") / 100.0)).alias("set_pixels"))


@query(f"WITH {P.NUCLEI} SELECT wsi_name, count(*) AS kept FROM nuclei WHERE area BETWEEN 100 AND 50000 AND perimeter > 0 GROUP BY wsi_name")
def area_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.nuclei(spark, sf_dir).filter(shape.gate("area", "perimeter")).groupBy("wsi_name").agg(F.count("*").alias("kept"))


@query(f"WITH {P.SCORED} SELECT wsi_name, tile_row, tile_col, source_id, instance_id, round(abnormality_score, 6) AS abnormality_score FROM scored WHERE is_abnormal")
def abnormal_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.scored(spark, sf_dir).filter("is_abnormal").select("wsi_name", "tile_row", "tile_col", "source_id", "instance_id", "abnormality_score"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.slides(spark, sf_dir)
    cells = s.withColumn("my", F.explode(F.sequence(F.lit(0), F.ceil(F.col("h") / 128).cast("int")))).withColumn("mx", F.explode(F.sequence(F.lit(0), F.ceil(F.col("w") / 128).cast("int"))))
    return cells.select(F.col("wsi_path").alias("slide"), "my", "mx", F.when((F.col("my") * 7 + F.col("mx") * 13 + F.col("p_partkey")) % 10 < 2, 255).otherwise(0).alias("mask"))


_SIDE = 32


def _mask_blocks(s: DataFrame) -> DataFrame:
    """The cells of _cells in blocks."""
    rows, columns = (F.ceil(F.col(c) / 128).cast("int") + 1 for c in ("h", "w"))
    blocks = s.select(F.col("wsi_path").alias("slide"), "p_partkey", rows.alias("rows"), columns.alias("columns"), F.explode(F.sequence(F.lit(0), F.floor((rows - 1) / _SIDE).cast("int"))).alias("block_row"))
    blocks = blocks.withColumn("block_col", F.explode(F.sequence(F.lit(0), F.floor((F.col("columns") - 1) / _SIDE).cast("int"))))
    y, x = F.col("block_row") * _SIDE, F.col("block_col") * _SIDE
    blocks = blocks.withColumn("h", F.least(F.lit(_SIDE), F.col("rows") - y)).withColumn("w", F.least(F.lit(_SIDE), F.col("columns") - x))
    # along a row, cells repeat every ten: cell x is true where (7 my + p_partkey + 3 x) % 10 < 2, and 3 * 7 is 1 modulo 10
    ten = "".join("01" if 3 * i % 10 < 2 else "00" for i in range(10))
    row = lambda i: F.substring(F.lit(ten * (_SIDE // 10 + 2)), ((((y + i) * 7 + F.col("p_partkey")) * 7 + x) % 10 * 2 + 1).cast("int"), F.col("w") * 2)
    mask = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.col("h") - 1), row), ""))
    return blocks.select("slide", "block_row", "block_col", "h", "w", mask.alias("mask"))


_CELLS = """
cells AS (
    SELECT wsi_path AS slide, CAST(a.i AS INTEGER) AS my, CAST(b.i AS INTEGER) AS mx, CASE WHEN (a.i * 7 + b.i * 13 + p_partkey) % 10 < 2 THEN 255 ELSE 0 END AS mask
    FROM slides, LATERAL unnest(range(CAST(ceil(h / 128) AS BIGINT) + 1)) a(i), LATERAL unnest(range(CAST(ceil(w / 128) AS BIGINT) + 1)) b(i)
)"""


@query(f"""WITH {P.GRID}, {_CELLS}
SELECT t.wsi_path, t.tile_id, round(avg(CASE WHEN mask > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS tissue_ratio
FROM tiles t JOIN cells c ON c.slide = t.wsi_path AND c.my BETWEEN floor(t.y / 128) AND greatest(floor(t.y / 128), floor((t.y + t.height) / 128) - 1) AND c.mx BETWEEN floor(t.x / 128) AND greatest(floor(t.x / 128), floor((t.x + t.width) / 128) - 1)
GROUP BY t.wsi_path, t.tile_id HAVING avg(CASE WHEN mask > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) > 0.1::DOUBLE""")
def tissue_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.spread(P.slides(spark, sf_dir))
    return rounded(area.tissue_tiles(grid.tile_grid(s), _mask_blocks(s), (_SIDE, _SIDE), 128))


@query(f"WITH {P.PIXELS} SELECT slide, y, x, event_id, CASE WHEN (r + g + b) / 3.0::DOUBLE < 120 THEN 1 ELSE 0 END AS mask FROM pixels")
def tissue_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tissue.tissue_mask(P.pixels(spark, sf_dir), 120.0).select("slide", "y", "x", "event_id", "mask")


_RECORDS = "records AS (SELECT concat_ws('_', wsi_name, source_id, instance_id, CAST(round(area) AS BIGINT), CAST(round(solidity * 100) AS BIGINT), CAST(round(edge_roughness * 100) AS BIGINT), CAST(round(aspect_ratio * 100) AS BIGINT)) AS record_id, wsi_name, CAST(abnormality_score AS FLOAT) AS abnormality_score, CAST(circularity AS FLOAT) AS circularity, reasons FROM scored)"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.scored(spark, sf_dir)
    whole = [F.round(F.col("area")).cast("long"), *[F.round(F.col(c) * 100).cast("long") for c in ("solidity", "edge_roughness", "aspect_ratio")]]
    return s.select(F.concat_ws("_", "wsi_name", "source_id", "instance_id", *[w.cast("string") for w in whole]).alias("record_id"), "wsi_name", F.col("abnormality_score").cast("float").alias("abnormality_score"), F.col("circularity").cast("float").alias("circularity"), F.concat_ws("; ", "abnormality_reasons").alias("abnormality_reasons"))


@query(f"WITH {P.SCORED}, {_RECORDS} SELECT record_id, wsi_name, round(CAST(abnormality_score AS DOUBLE), 6) AS abnormality_score, reasons AS abnormality_reasons FROM records WHERE abnormality_score >= 0.6::DOUBLE ORDER BY records.abnormality_score DESC, record_id LIMIT 100")
def query_abnormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    empty = [F.lit(None).cast("float").alias(c) for c in search.QUERY_FIELDS if c not in r.columns]
    found = search.query_abnormal(r.select("*", *empty))
    return found.select("record_id", "wsi_name", F.round(F.col("abnormality_score").cast("double"), 6).alias("abnormality_score"), "abnormality_reasons")


_SCREEN = """
screen AS (
    SELECT wsi_name, CAST(r.i AS INTEGER) AS off_y, CAST(c.i AS INTEGER) AS off_x, CAST(least(2048, h - r.i) AS INTEGER) AS tile_h, CAST(least(2048, w - c.i) AS INTEGER) AS tile_w
    FROM slides, LATERAL unnest(range(0, h, 1920)) r(i), LATERAL unnest(range(0, w, 1920)) c(i) WHERE least(2048, h - r.i) >= 64 AND least(2048, w - c.i) >= 64
)"""


@query(f"WITH {P.SLIDES}, {_SCREEN} SELECT *, CAST(floor(off_y / 2048) AS INTEGER) AS tile_row, CAST(floor(off_x / 2048) AS INTEGER) AS tile_col FROM screen")
def screen_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.screen_tiles(P.slides(spark, sf_dir))


@query(f"WITH {P.TASKS} SELECT task_id, batch_idx FROM tasks WHERE state = 'SUCCESS'")
def completed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.tasks(spark, sf_dir).withColumn("status", jobs.state_name())
    return jobs.completed_batches(t).select("task_id", "batch_idx")


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons as described objects with all the fields that records need."""
    m = P.measured(spark, sf_dir)
    k = F.col("p_partkey")
    m = m.withColumns({
        "wsi_name": F.concat(F.lit("slide_"), k % 10), "task_id": F.concat(F.lit("task_"), k % 3), "tile_row": (k % 4).cast("int"), "tile_col": (k % 5).cast("int"), "instance_id": k.cast("int"),
        "bbox": geometry.polygon_bbox("contour"), "centroid": geometry.polygon_centroid("contour"), "circularity": shape.circularity("area", "perimeter"),
        "aspect_ratio": F.lit(1.0) + (k % 50) / 10.0, "edge_roughness": (k % 11) / 10.0, "solidity": F.lit(0.1) + (k % 9) / 10.0, "convexity": F.lit(0.5) + (k % 5) / 10.0, "eccentricity": (k % 10) / 10.0,
    })
    m = report.scored(m)
    zero = F.lit(0.0)
    return m.withColumn("feature_vector", shape.feature_vector("area", "perimeter", "circularity", "aspect_ratio", "edge_roughness", "solidity", "convexity", "eccentricity", zero, zero))


_OBJECTS = (
    P.POLYGONS
    + """,
geo AS (
    SELECT p_partkey, any_value(n) AS n, abs(sum(px * qy - qx * py)) / 2 AS area, sum(sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py))) AS perimeter,
           sum((px + qx) * (px * qy - qx * py)) / (3 * sum(px * qy - qx * py)) AS cx, sum((py + qy) * (px * qy - qx * py)) / (3 * sum(px * qy - qx * py)) AS cy,
           CAST(floor(min(px)) AS INTEGER) AS left_x, CAST(floor(min(py)) AS INTEGER) AS top_y, CAST(floor(max(px)) - floor(min(px)) + 1 AS INTEGER) AS bw, CAST(floor(max(py)) - floor(min(py)) + 1 AS INTEGER) AS bh
    FROM edges GROUP BY p_partkey
),
objects AS (
    SELECT *, 'slide_' || p_partkey % 10 AS wsi_name, 'task_' || p_partkey % 3 AS task_id, CAST(p_partkey % 4 AS INTEGER) AS tile_row, CAST(p_partkey % 5 AS INTEGER) AS tile_col, CAST(p_partkey AS INTEGER) AS instance_id,
           least(4 * pi() * area / (perimeter * perimeter), 1.0::DOUBLE) AS circularity, 1.0::DOUBLE + (p_partkey % 50) / 10.0::DOUBLE AS aspect_ratio, (p_partkey % 11) / 10.0::DOUBLE AS edge_roughness,
           0.1::DOUBLE + (p_partkey % 9) / 10.0::DOUBLE AS solidity, 0.5::DOUBLE + (p_partkey % 5) / 10.0::DOUBLE AS convexity, (p_partkey % 10) / 10.0::DOUBLE AS eccentricity
    FROM geo
),
judged AS (
    SELECT *, CASE WHEN circularity < 0.55 THEN (0.55::DOUBLE - circularity) / 0.55::DOUBLE * 0.35::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN aspect_ratio > 3 THEN least((aspect_ratio - 3.0::DOUBLE) / 3.0::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE ELSE 0.0::DOUBLE END
            + CASE WHEN edge_roughness > 0.4::DOUBLE THEN least((edge_roughness - 0.4::DOUBLE) / (1.0::DOUBLE - 0.4::DOUBLE), 1.0::DOUBLE) * 0.25::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN solidity < 0.7::DOUBLE THEN (0.7::DOUBLE - solidity) / 0.7::DOUBLE * 0.15::DOUBLE ELSE 0.0::DOUBLE END AS s
    FROM objects
)"""
)


@query(f"""WITH {_OBJECTS} SELECT task_id || '_' || instance_id || '_' || substr(sha256(concat_ws('|', wsi_name, task_id, tile_row, tile_col, instance_id)), 1, 8) AS record_id, wsi_name, tile_row, tile_col, left_x AS bbox_x, top_y AS bbox_y, bw AS bbox_w, bh AS bbox_h,
round(cx, 3) AS centroid_x, round(cy, 3) AS centroid_y, round(least(s, 1.0::DOUBLE), 5) AS abnormality_score, CAST(n AS BIGINT) AS points FROM judged WHERE s >= 0.6::DOUBLE""")
def feature_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = report.feature_records(_objects(spark, sf_dir).filter("is_abnormal"))
    points = F.size(F.from_json("polygon_coords", "array<array<double>>")).cast("long").alias("points")
    wide = [F.round(F.col(c).cast("double"), d).alias(c) for c, d in (("centroid_x", 3), ("centroid_y", 3), ("abnormality_score", 5))]
    return records.select("record_id", "wsi_name", "tile_row", "tile_col", "bbox_x", "bbox_y", "bbox_w", "bbox_h", *wide, points)


@query(f"WITH {_OBJECTS} SELECT instance_id, round(cx, 4) AS centroid_x, round(cy, 4) AS centroid_y, bw AS bbox_w, bh AS bbox_h, round(circularity, 6) AS circularity, round(least(s, 1.0::DOUBLE), 6) AS abnormality_score FROM judged WHERE s >= 0.6::DOUBLE")
def abnormal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = report.abnormal_summary(_objects(spark, sf_dir))
    return s.select("instance_id", F.round("centroid.x", 4).alias("centroid_x"), F.round("centroid.y", 4).alias("centroid_y"), F.col("bbox.w").alias("bbox_w"), F.col("bbox.h").alias("bbox_h"), F.round("circularity", 6).alias("circularity"), F.round("abnormality_score", 6).alias("abnormality_score"))


@query(f"WITH {P.DETECTIONS} SELECT wsi_name, instance_id, x1 + tile_col * 1920 AS x1, y1 + tile_row * 1920 AS y1, x2 + tile_col * 1920 AS x2, y2 + tile_row * 1920 AS y2 FROM detections")
def box_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.detections(spark, sf_dir).withColumn("off_x", F.col("tile_col") * 1920).withColumn("off_y", F.col("tile_row") * 1920)
    return detect.box_offset(d).select("wsi_name", "instance_id", "x1", "y1", "x2", "y2")


@query(f"WITH {_OBJECTS} SELECT p_partkey, left_x + tile_col * 1920 AS x, top_y + tile_row * 1920 AS y, round(cx + tile_col * 1920, 4) AS centroid_x, round(cy + tile_row * 1920, 4) AS centroid_y FROM judged")
def nucleus_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    ox, oy = F.col("tile_col") * 1920, F.col("tile_row") * 1920
    return _objects(spark, sf_dir).select("p_partkey", (F.col("bbox.x") + ox).alias("x"), (F.col("bbox.y") + oy).alias("y"), F.round(F.col("centroid.x") + ox, 4).alias("centroid_x"), F.round(F.col("centroid.y") + oy, 4).alias("centroid_y"))


# -- joins


@query(f"""WITH {P.DETECTIONS}, offs AS (SELECT DISTINCT wsi_name, tile_row, tile_col, tile_row * 1920 AS off_y, tile_col * 1920 AS off_x FROM detections)
SELECT wsi_name, tile_row, tile_col, instance_id, off_y, off_x FROM detections JOIN offs USING (wsi_name, tile_row, tile_col)""")
def detections_with_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.detections(spark, sf_dir)
    offsets = d.select("wsi_name", "tile_row", "tile_col").distinct().withColumn("off_y", F.col("tile_row") * 1920).withColumn("off_x", F.col("tile_col") * 1920)
    return detect.with_offsets(d, offsets).select("wsi_name", "tile_row", "tile_col", "instance_id", "off_y", "off_x")


@query("SELECT l.l_orderkey AS tile_id, count(*) AS results, any_value(o.o_orderpriority) AS callback FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY l.l_orderkey")
def callback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = P.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tile_id")).agg(F.count("*").alias("results"))
    callbacks = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tile_id"), F.col("o_orderpriority").alias("callback"))
    return results.join(callbacks, "tile_id")


@query("SELECT 'c' || c_custkey AS task_id, n AS results FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def results_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = P.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("task_id"))
    results = P.tasks(spark, sf_dir).groupBy(F.col("job_id").alias("task_id")).agg(F.count("*").alias("results"))
    return jobs.results_or_null(asked, results)


_PAIRS = """
pairs AS (
    SELECT a.wsi_name, a.instance_id AS id_a, b.instance_id AS id_b,
           (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS total
    FROM detections a JOIN detections b ON a.wsi_name = b.wsi_name AND a.instance_id < b.instance_id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2
)"""


@query(f"WITH {P.DETECTIONS}, {_PAIRS} SELECT wsi_name, id_a, id_b, round(inter / (total - inter), 6) AS iou FROM pairs WHERE inter > 0")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(detect.iou_pairs(P.detections(spark, sf_dir)))


_MIXED = "mixed AS (SELECT wsi_name, instance_id, x1, y1, x1 + (x2 - x1) * (CASE instance_id % 9 WHEN 0 THEN 16.0::DOUBLE WHEN 1 THEN 0.125::DOUBLE ELSE 1.0::DOUBLE END) AS x2, y1 + (y2 - y1) * (CASE instance_id % 7 WHEN 0 THEN 8.0::DOUBLE WHEN 1 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END) AS y2 FROM detections)"


@query(f"WITH {P.DETECTIONS}, {_MIXED}, {_PAIRS.replace('detections', 'mixed')} SELECT wsi_name, id_a, id_b, round(inter / (total - inter), 6) AS iou FROM pairs WHERE inter > 0")
def mixed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping boxes of very unlike sides and shapes."""
    i = F.col("instance_id")
    wide = F.when(i % 9 == 0, 16.0).when(i % 9 == 1, 0.125).otherwise(1.0)
    tall = F.when(i % 7 == 0, 8.0).when(i % 7 == 1, 0.25).otherwise(1.0)
    boxes = P.detections(spark, sf_dir).withColumns({"x2": F.col("x1") + (F.col("x2") - F.col("x1")) * wide, "y2": F.col("y1") + (F.col("y2") - F.col("y1")) * tall})
    return rounded(detect.iou_pairs(boxes))


@query(f"""WITH {P.GRID} SELECT wsi_path, row, col, CAST(r.i AS INTEGER) AS block_row, CAST(c.i AS INTEGER) AS block_col
FROM tiles, LATERAL unnest(range(CAST(floor(row * 1792 / 2048) AS BIGINT), CAST(floor((row * 1792 + 2047) / 2048) AS BIGINT) + 1)) r(i), LATERAL unnest(range(CAST(floor(col * 1792 / 2048) AS BIGINT), CAST(floor((col * 1792 + 2047) / 2048) AS BIGINT) + 1)) c(i)""")
def tile_block_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = grid.tile_grid(P.slides(spark, sf_dir)).select("wsi_path", "row", "col")
    return grid.tile_block_map(tiles, 2048, 2048, 1792)


_SIMILAR = f"SELECT vec_id AS record_id, 'slide_' || label AS wsi_name, round(list_cosine_similarity(embedding::DOUBLE[], {P.PROBE}), 6) AS distance FROM embeddings"


@query(f"{_SIMILAR} ORDER BY list_cosine_similarity(embedding::DOUBLE[], {P.PROBE}) DESC, vec_id LIMIT 20")
def search_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.search_similar(P.vectors(spark, sf_dir), P.probe_vector()).drop("feature_vector"))


@query(f"{_SIMILAR} WHERE label = 3 ORDER BY list_cosine_similarity(embedding::DOUBLE[], {P.PROBE}) DESC, vec_id LIMIT 20")
def search_similar_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.search_similar(P.vectors(spark, sf_dir), P.probe_vector(), where=F.col("wsi_name") == "slide_3").drop("feature_vector"))


@query("SELECT 'c' || c_custkey AS task_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def tasks_with_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = P.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("task_id"))
    return jobs.with_results(asked, P.tasks(spark, sf_dir).filter("state = 'SUCCESS'").select(F.col("job_id").alias("task_id")))


@query("SELECT 'c' || c_custkey AS task_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def tasks_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = P.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("task_id"))
    return jobs.pending(asked, P.tasks(spark, sf_dir).filter("state = 'SUCCESS'").select(F.col("job_id").alias("task_id")))


# -- aggregations


@query(f"WITH {P.SCORED} SELECT wsi_name, count(*) AS total_nuclei, count(*) FILTER (WHERE is_abnormal) AS total_abnormal, round(count(*) FILTER (WHERE is_abnormal) / greatest(1, count(*)), 6) AS abnormal_ratio FROM scored GROUP BY wsi_name")
def screening_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.screening_summary(P.scored(spark, sf_dir), "wsi_name"))


@query(f"WITH {P.SCORED} SELECT wsi_name, tile_row, tile_col, count(*) AS num_nuclei, count(*) FILTER (WHERE is_abnormal) AS num_abnormal FROM scored GROUP BY ALL")
def tile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.tile_summary(P.scored(spark, sf_dir))


@query(f"""WITH {P.SCORED}, gates AS (SELECT count(*) AS nuclei_detected, count(DISTINCT (wsi_name, tile_row, tile_col)) AS tiles_processed FROM nuclei)
SELECT tiles_processed, nuclei_detected, (SELECT count(*) FROM scored) AS nuclei_analyzed, (SELECT count(*) FROM scored WHERE is_abnormal) AS abnormal_nuclei, (SELECT count(*) FROM scored WHERE is_abnormal) AS records_stored FROM gates""")
def pipeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = report.scored(P.nuclei(spark, sf_dir)).withColumn("described", shape.gate("area", "perimeter"))
    return report.pipeline_stats(n)


@query(f"""WITH {P.SCORED} SELECT wsi_name, tile_row, count(*) AS total_nuclei, count(*) FILTER (WHERE is_abnormal) AS total_abnormal, round(count(*) FILTER (WHERE is_abnormal) / greatest(1, count(*)), 6) AS abnormal_ratio
FROM scored GROUP BY ROLLUP (wsi_name, tile_row)""")
def screening_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.screening_rollup(P.scored(spark, sf_dir)))


_BLEND = "CAST(trunc(least(greatest(sum(v * weight_in) / greatest(sum(weight_in), 1e-8::DOUBLE), 0.0::DOUBLE), 255.0::DOUBLE)) AS INTEGER) AS pixel, round(sum(weight_in), 6) AS weight"


@query(f"WITH {P.PIXELS} SELECT slide, y, x, {_BLEND} FROM pixels GROUP BY ALL")
def weighted_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(blend.weighted_blend(P.pixels(spark, sf_dir), ("slide", "y", "x"), weight="weight_in"))


@query(f"WITH {P.PIXELS} SELECT slide, y, x, CAST(floor(y / 16) AS INTEGER) AS strip, {_BLEND} FROM pixels GROUP BY ALL")
def strip_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(blend.strip_blend(P.pixels(spark, sf_dir), 16, weight="weight_in"))


@query(f"""WITH RECURSIVE {P.DETECTIONS}, ordered AS (SELECT *, row_number() OVER (PARTITION BY wsi_name ORDER BY score DESC, instance_id) AS n FROM detections),
fold AS (
    SELECT wsi_name, n, [{{'id': instance_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM ordered WHERE n = 1
    UNION ALL
    SELECT o.wsi_name, o.n, CASE WHEN len(list_filter(f.kept, lambda k: greatest(least(k.x2, o.x2) - greatest(k.x1, o.x1), 0) * greatest(least(k.y2, o.y2) - greatest(k.y1, o.y1), 0)
        > 0.5::DOUBLE * ((k.x2 - k.x1) * (k.y2 - k.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - greatest(least(k.x2, o.x2) - greatest(k.x1, o.x1), 0) * greatest(least(k.y2, o.y2) - greatest(k.y1, o.y1), 0)))) = 0
        THEN list_append(f.kept, {{'id': o.instance_id, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) ELSE f.kept END
    FROM fold f JOIN ordered o ON o.wsi_name = f.wsi_name AND o.n = f.n + 1
),
final AS (SELECT wsi_name, max_by(kept, n) AS kept FROM fold GROUP BY wsi_name)
SELECT wsi_name, k.id AS instance_id, k.x1 AS x1, k.y1 AS y1 FROM final, LATERAL unnest(kept) u(k)""")
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.nms(P.detections(spark, sf_dir)).select("wsi_name", "instance_id", "x1", "y1")


@query(ORACLES["nms"])
def nms_by_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.nms_by_rounds(P.detections(spark, sf_dir)).select("wsi_name", "instance_id", "x1", "y1")


@query(f"WITH {P.DETECTIONS} SELECT wsi_name, tile_row, max_by(instance_id, ((x2 - x1) * (y2 - y1), -instance_id)) AS contour_id, max((x2 - x1) * (y2 - y1)) AS area FROM detections GROUP BY wsi_name, tile_row")
def largest_contour(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.detections(spark, sf_dir).select("wsi_name", "tile_row", F.col("instance_id").alias("contour_id"), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"))
    return detect.largest_contour(c, ("wsi_name", "tile_row"))


@query(f"""WITH {P.SLIDES}, {_CELLS}, hit AS (SELECT slide, min(mx) AS lx, max(mx) AS hx, min(my) AS ly, max(my) AS hy FROM cells WHERE mask > 0 GROUP BY slide)
SELECT wsi_path AS slide, CAST(coalesce(lx * 128, 0) AS INTEGER) AS x, CAST(coalesce(ly * 128, 0) AS INTEGER) AS y, CAST(coalesce((hx - lx) * 128, w) AS INTEGER) AS w, CAST(coalesce((hy - ly) * 128, h) AS INTEGER) AS h FROM slides LEFT JOIN hit ON slide = wsi_path""")
def tissue_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.slides(spark, sf_dir).select(F.col("wsi_path").alias("slide"), "w", "h", F.lit(128.0).alias("downsample"))
    return tissue.tissue_bbox(_cells(spark, sf_dir), s)


@query(f"WITH {P.PIXELS}, canvas AS (SELECT slide, y, x, sum(weight_in) AS weight FROM pixels GROUP BY ALL) SELECT slide, round(count(*) FILTER (WHERE weight > 1e-3::DOUBLE) * 100.0::DOUBLE / count(*), 6) AS filled_percent FROM canvas GROUP BY slide")
def fill_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    canvas = P.pixels(spark, sf_dir).groupBy("slide", "y", "x").agg(F.sum("weight_in").alias("weight"))
    return rounded(blend.fill_progress(canvas.withColumn("weight", F.col("weight") - 1e-3)))


@query(f"WITH {P.TASKS} SELECT job_id, round(count(*) FILTER (WHERE state = 'SUCCESS') / 32.0::DOUBLE * 100, 6) AS percent FROM tasks GROUP BY job_id")
def tile_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.tasks(spark, sf_dir).withColumn("processed", F.col("state") == "SUCCESS")
    return rounded(blend.tile_progress(t, ("job_id",), F.col("total_batches")))


@query(f"WITH {P.TASKS} SELECT task_id, batch_idx, round((batch_idx + 1) / 32.0::DOUBLE * 100, 6) AS progress FROM tasks")
def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(jobs.batch_progress(P.tasks(spark, sf_dir)).select("task_id", "batch_idx", "progress"))


@query(f"WITH {P.LOSSES}, b AS (SELECT epoch, batch, avg(g_loss) AS g, avg(d_loss) AS d FROM losses GROUP BY ALL) SELECT epoch, round(avg(g), 6) AS mean_g_loss, round(avg(d), 6) AS mean_d_loss FROM b GROUP BY epoch")
def epoch_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.epoch_losses(P.losses(spark, sf_dir), ("g_loss", "d_loss")))


_PSNR = f"{P.LOSSES}, i AS (SELECT epoch, batch, image, avg(squared_error) AS mse FROM losses GROUP BY ALL), b AS (SELECT epoch, batch, avg(CASE WHEN mse = 0 THEN 'inf'::DOUBLE ELSE -10 * log10(mse) END) AS psnr FROM i GROUP BY ALL), e AS (SELECT epoch, avg(psnr) AS psnr FROM b GROUP BY epoch)"


@query(f"WITH {_PSNR} SELECT epoch, round(psnr, 6) AS psnr FROM e")
def psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.psnr(P.losses(spark, sf_dir)))


@query(f"WITH {_PSNR} SELECT epoch, round(psnr, 6) AS psnr, psnr > greatest(coalesce(max(psnr) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS is_best, (epoch + 1) % 10 = 0 AS is_periodic FROM e")
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.best_checkpoints(metrics.psnr(P.losses(spark, sf_dir))))


@query(f"WITH {P.TASKS} SELECT worker, count(*) AS total_tasks, count(DISTINCT state) AS states, count(*) FILTER (WHERE state = 'SUCCESS') AS completed_tasks FROM tasks GROUP BY worker")
def worker_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.worker_stats(P.tasks(spark, sf_dir))


# -- windows, order, sets


@query(f"WITH {P.GRID} SELECT wsi_path, row, col, CAST(row_number() OVER (PARTITION BY wsi_path ORDER BY row, col) - 1 AS INTEGER) AS tile_index, CAST(floor((row_number() OVER (PARTITION BY wsi_path ORDER BY row, col) - 1) / 32) AS INTEGER) AS batch_idx FROM tiles")
def tile_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.tile_batches(grid.tile_grid(P.slides(spark, sf_dir)), whole=True).select("wsi_path", "row", "col", "tile_index", "batch_idx")


@query(f"WITH {P.DETECTIONS}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY wsi_name, tile_row, tile_col ORDER BY instance_id) - 1 AS INTEGER) AS i FROM detections) SELECT wsi_name, tile_row, tile_col, instance_id AS source_id, i AS instance_id FROM n WHERE score >= 50")
def instance_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.detections(spark, sf_dir).withColumnRenamed("instance_id", "source_id")
    return detect.instance_ids(d, ("wsi_name", "tile_row", "tile_col"), ("source_id",), F.col("score") >= 50).select("wsi_name", "tile_row", "tile_col", "source_id", "instance_id")


@query(f"WITH {P.GRID}, s AS (SELECT wsi_path, row, col, CAST(floor(row / 2) AS INTEGER) AS strip FROM tiles) SELECT *, coalesce(lag(strip) OVER (PARTITION BY wsi_path ORDER BY row, col) <> strip, true) AS starts_strip FROM s")
def strip_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = grid.tile_grid(P.slides(spark, sf_dir)).select("wsi_path", "row", "col", F.floor(F.col("row") / 2).cast("int").alias("strip"))
    return grid.strip_boundaries(tiles, rows=2)


@query("SELECT p_partkey, p_size * 20 AS epoch, round(0.0001::DOUBLE * pow(0.5::DOUBLE, floor(p_size * 20 / 100)), 12) AS learning_rate FROM part")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 20).alias("epoch"))
    return rounded(p.withColumn("learning_rate", metrics.learning_rate(F.col("epoch"))), 12)


@query(f"WITH {P.GRID} SELECT wsi_path, row, col, tile_id FROM tiles ORDER BY wsi_path, row, col")
def tiles_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.tile_grid(P.slides(spark, sf_dir)).select("wsi_path", "row", "col", "tile_id").orderBy("wsi_path", "row", "col")


@query(f"""WITH {P.TASKS}, both_ AS (SELECT task_id, worker, 'active' AS status FROM tasks WHERE state = 'PROGRESS' UNION ALL SELECT task_id, worker, 'scheduled' FROM tasks WHERE state = 'PENDING')
SELECT * FROM both_ ORDER BY status, task_id LIMIT 50""")
def list_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.tasks(spark, sf_dir)
    return jobs.list_tasks(t.filter("state = 'PROGRESS'").select("task_id", "worker"), t.filter("state = 'PENDING'").select("task_id", "worker"))


@query(f"WITH {P.DETECTIONS} SELECT wsi_name, instance_id, tile_row, tile_col FROM detections")
def merged_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.detections(spark, sf_dir).select("wsi_name", "instance_id", "tile_row", "tile_col")
    return detect.merged([d.filter(F.col("tile_row") == i) for i in range(4)])


@query(f"WITH {P.TASKS} SELECT job_id AS task_id, max_by(state, seq) AS state, round(max_by((batch_idx + 1) / 32.0::DOUBLE * 100, seq), 6) AS progress FROM tasks GROUP BY job_id")
def task_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = jobs.batch_progress(P.tasks(spark, sf_dir)).select(F.col("job_id").alias("task_id"), "state", "progress", "seq")
    return rounded(jobs.task_status(log))


# -- scalars: shapes


@query(f"WITH {P.POLYGONS} SELECT p_partkey, round(abs(sum(px * qy - qx * py)) / 2, 6) AS area FROM edges GROUP BY p_partkey")
def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.polygons(spark, sf_dir).select("p_partkey", geometry.polygon_area("contour").alias("area")))


@query(f"WITH {P.POLYGONS} SELECT p_partkey, round(sum(sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py))), 6) AS perimeter FROM edges GROUP BY p_partkey")
def polygon_perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.polygons(spark, sf_dir).select("p_partkey", geometry.polygon_perimeter("contour").alias("perimeter")))


@query(f"WITH {_OBJECTS} SELECT p_partkey, left_x AS x, top_y AS y, bw AS w, bh AS h FROM geo")
def polygon_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.polygons(spark, sf_dir).select("p_partkey", geometry.polygon_bbox("contour").alias("b")).select("p_partkey", "b.*")


@query(f"WITH {_OBJECTS} SELECT p_partkey, round(cx, 5) AS x, round(cy, 5) AS y FROM geo")
def polygon_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.polygons(spark, sf_dir).select("p_partkey", geometry.polygon_centroid("contour").alias("c")).select("p_partkey", "c.*"), 5)


@query(f"""WITH {P.NUCLEI}, axes AS (SELECT *, perimeter / 3 AS major, perimeter / 3 / aspect_ratio AS minor FROM nuclei)
SELECT wsi_name, count(*) AS n, round(sum(circularity), 4) AS circularity, round(sum(CASE WHEN area > 0 AND perimeter > 0 THEN 4 * pi() * area / (perimeter * perimeter) ELSE 0 END), 4) AS form_factor,
       round(sum(CASE WHEN minor > 0 THEN major / minor ELSE 1 END), 4) AS aspect, round(sum(CASE WHEN major > 0 THEN sqrt(greatest(1 - (minor / major) * (minor / major), 0)) ELSE 0 END), 4) AS eccentricity,
       round(sum(CASE WHEN major > 0 AND area > 0 THEN 4.0::DOUBLE * area / (pi() * major * major) ELSE 0 END), 4) AS roundness FROM axes GROUP BY wsi_name""")
def shape_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.nuclei(spark, sf_dir).withColumn("major", F.col("perimeter") / 3).withColumn("minor", F.col("perimeter") / 3 / F.col("aspect_ratio"))
    sums = {"circularity": F.col("circularity"), "form_factor": shape.form_factor("area", "perimeter"), "aspect": shape.aspect_ratio("major", "minor"), "eccentricity": shape.eccentricity("major", "minor"), "roundness": shape.roundness("area", "major")}
    return rounded(n.groupBy("wsi_name").agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()]), 4)


@query(f"""WITH {P.POLYGONS}, hull AS (
    SELECT a.p_partkey, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM vertices a JOIN vertices b ON a.p_partkey = b.p_partkey AND a.i <> b.i
    WHERE NOT EXISTS (SELECT 1 FROM vertices c WHERE c.p_partkey = a.p_partkey AND c.i <> a.i AND c.i <> b.i AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0)
),
own AS (SELECT p_partkey, abs(sum(px * qy - qx * py)) / 2 AS area, sum(sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py))) AS perimeter FROM edges GROUP BY p_partkey),
h AS (SELECT p_partkey, abs(sum(px * qy - qx * py)) / 2 AS area, sum(sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py))) AS perimeter FROM hull GROUP BY p_partkey)
SELECT p_partkey, round(h.area, 5) AS hull_area, round(h.perimeter, 5) AS hull_perimeter, round(own.area / h.area, 5) AS solidity, round(h.perimeter / own.perimeter, 5) AS convexity FROM own JOIN h USING (p_partkey)""")
def convex_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.measured(spark, sf_dir).withColumn("hull", geometry.convex_hull("contour"))
    return rounded(m.select("p_partkey", F.col("hull.area").alias("hull_area"), F.col("hull.perimeter").alias("hull_perimeter"), shape.share("area", "hull.area").alias("solidity"), shape.share("hull.perimeter", "perimeter").alias("convexity")), 5)


@query()
def ellipse_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.measured(spark, sf_dir).withColumn("axes", geometry.ellipse_axes("contour"))
    return rounded(m.select("p_partkey", F.col("axes.major").alias("major"), F.col("axes.minor").alias("minor"), shape.aspect_ratio("axes.major", "axes.minor").alias("aspect_ratio"), shape.roundness("area", "axes.major").alias("roundness")))


@query()
def edge_roughness(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.measured(spark, sf_dir).withColumn("hull", geometry.convex_hull("contour")).withColumn("kept", geometry.simplified_count("contour", F.col("perimeter") * 0.02))
    return rounded(m.select("p_partkey", "n", "kept", shape.edge_roughness("n", "kept", "perimeter", "hull.perimeter").alias("edge_roughness")))


@query(f"""WITH {P.NUCLEI}, v AS (SELECT wsi_name, ln(1 + area) AS a, ln(1 + perimeter) AS p, circularity AS c, least(aspect_ratio, 10) / 10 AS r FROM nuclei)
SELECT wsi_name, round(sum(CAST(CAST(a AS FLOAT) AS DOUBLE)), 2) AS log_area, round(sum(CAST(CAST(p AS FLOAT) AS DOUBLE)), 2) AS log_perimeter, round(sum(CAST(CAST(c AS FLOAT) AS DOUBLE)), 3) AS circularity, round(sum(CAST(CAST(r AS FLOAT) AS DOUBLE)), 3) AS aspect FROM v GROUP BY wsi_name""")
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0.0)
    n = P.nuclei(spark, sf_dir).withColumn("v", shape.feature_vector("area", "perimeter", "circularity", "aspect_ratio", "edge_roughness", "solidity", zero, zero, zero, zero))
    part = lambda i: F.sum(F.element_at("v", i).cast("double"))
    return n.groupBy("wsi_name").agg(F.round(part(1), 2).alias("log_area"), F.round(part(2), 2).alias("log_perimeter"), F.round(part(3), 3).alias("circularity"), F.round(part(4), 3).alias("aspect"))


@query(f"WITH {P.SCORED} SELECT wsi_name, source_id, instance_id, round(abnormality_score, 6) AS abnormality_score, is_abnormal FROM scored")
def abnormality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.scored(spark, sf_dir).select("wsi_name", "source_id", "instance_id", "abnormality_score", "is_abnormal"))


@query(f"WITH {P.SCORED} SELECT wsi_name, source_id, instance_id, reasons FROM scored")
def abnormality_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.scored(spark, sf_dir).select("wsi_name", "source_id", "instance_id", F.concat_ws("; ", "abnormality_reasons").alias("reasons"))


@query(f"WITH {P.POLYGONS} SELECT p_partkey, count(*) AS points, round(sum(x), 5) AS sum_x, round(sum(y), 5) AS sum_y FROM vertices GROUP BY p_partkey")
def polygon_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = P.polygons(spark, sf_dir).select("p_partkey", geometry.polygon_json("contour").alias("polygon"))
    parsed = text.select("p_partkey", F.explode(F.from_json("polygon", "array<array<double>>")).alias("p"))
    return rounded(parsed.groupBy("p_partkey").agg(F.count("*").alias("points"), F.sum(F.col("p")[0]).alias("sum_x"), F.sum(F.col("p")[1]).alias("sum_y")), 5)


# -- scalars: grid and raster


@query(f"WITH {P.GRID} SELECT * FROM tiles")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.tile_grid(P.slides(spark, sf_dir))


@query(f"WITH {P.SLIDES} SELECT wsi_path, CAST(ceil(w / 448) * 448 * 4 AS INTEGER) AS out_w, CAST(ceil(h / 448) * 448 * 4 AS INTEGER) AS out_h, x0 * 4 AS out_x, y0 * 4 AS out_y FROM slides")
def output_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.output_dims(P.slides(spark, sf_dir))


@query("""WITH tiles AS (SELECT p_partkey AS tile_id, 2 + p_size % 6 AS w, 2 + p_size % 7 AS h FROM part)
SELECT tile_id, CAST(y.i AS INTEGER) AS y, CAST(x.i AS INTEGER) AS x, CAST(CASE WHEN y.i < h AND x.i < w THEN 1 + (tile_id + y.i * 3 + x.i) % 255 ELSE 0 END AS BIGINT) AS v FROM tiles, LATERAL unnest(range(8)) y(i), LATERAL unnest(range(8)) x(i)""")
def pad_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tile_id"), (F.col("p_size") % 6 + 2).alias("w"), (F.col("p_size") % 7 + 2).alias("h"))
    pixels = tiles.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    pixels = pixels.select("tile_id", "y", "x", ((F.col("tile_id") + F.col("y") * 3 + F.col("x")) % 255 + 1).alias("v"))
    return raster.pad_tile(tiles, pixels, 8).withColumn("v", F.col("v").cast("long")).select("tile_id", "y", "x", "v")


@query("""WITH tiles AS (SELECT p_partkey AS tile_id, 1 + p_size % 6 AS w, 1 + p_size % 7 AS h FROM part),
p AS (SELECT tile_id, w, h, CAST(y.i AS INTEGER) AS y, CAST(x.i AS INTEGER) AS x FROM tiles, LATERAL unnest(range(10)) y(i), LATERAL unnest(range(10)) x(i)),
m AS (SELECT *, y % greatest(2 * (h - 1), 1) AS my, x % greatest(2 * (w - 1), 1) AS mx FROM p)
SELECT tile_id, y, x, CAST(CASE WHEN h = 1 THEN 0 WHEN my >= h THEN 2 * (h - 1) - my ELSE my END AS INTEGER) AS src_y, CAST(CASE WHEN w = 1 THEN 0 WHEN mx >= w THEN 2 * (w - 1) - mx ELSE mx END AS INTEGER) AS src_x FROM m""")
def reflect_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tile_id"), (F.col("p_size") % 6 + 1).alias("tile_w"), (F.col("p_size") % 7 + 1).alias("tile_h"))
    return raster.reflect_pad(tiles, 10).select("tile_id", "y", "x", "src_y", "src_x")


_MASKED = "masked AS (SELECT DISTINCT slide, y AS my, x AS mx FROM pixels WHERE (r + g + b) / 3.0::DOUBLE < 230)"


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tissue.tissue_mask(P.pixels(spark, sf_dir), 230.0).filter("mask = 1").select("slide", F.col("y").alias("my"), F.col("x").alias("mx")).distinct()


_ALL_FIVE = "(SELECT {c}.slide, {c}.my, {c}.mx FROM {c} JOIN {c} u ON u.slide = {c}.slide AND u.mx = {c}.mx AND u.my = {c}.my - 1 JOIN {c} d ON d.slide = {c}.slide AND d.mx = {c}.mx AND d.my = {c}.my + 1 JOIN {c} l ON l.slide = {c}.slide AND l.my = {c}.my AND l.mx = {c}.mx - 1 JOIN {c} r ON r.slide = {c}.slide AND r.my = {c}.my AND r.mx = {c}.mx + 1)"
_ANY = "(SELECT DISTINCT slide, my + dy AS my, mx + dx AS mx FROM {c}, (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) v(dy, dx))"


_DENSE = "dense AS (SELECT DISTINCT CAST(l_suppkey % 3 AS VARCHAR) AS slide, CAST(l_orderkey % 40 AS INTEGER) AS my, CAST((l_linenumber * 7 + l_partkey) % 40 AS INTEGER) AS mx FROM lineitem)"


@query(f"WITH {_DENSE}, e AS {_ALL_FIVE.format(c='dense')}, e2 AS {_ALL_FIVE.format(c='e')}, o AS {_ANY.format(c='e2')}, o2 AS {_ANY.format(c='o')} SELECT slide, my, mx FROM o2")
def binary_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    cells = P.table(spark, sf_dir, "lineitem").select((c("l_suppkey") % 3).cast("string").alias("slide"), (c("l_orderkey") % 40).cast("int").alias("my"), ((c("l_linenumber") * 7 + c("l_partkey")) % 40).cast("int").alias("mx"))
    return tissue.binary_opening(cells)


@query(f"""WITH RECURSIVE {P.PIXELS}, {_MASKED},
box AS (SELECT slide, min(my) - 1 AS y0, max(my) + 1 AS y1, min(mx) - 1 AS x0, max(mx) + 1 AS x1 FROM masked GROUP BY slide),
grid AS (SELECT slide, y0, x0, y.i AS my, x.i AS mx FROM box, LATERAL unnest(range(y0, y1 + 1)) y(i), LATERAL unnest(range(x0, x1 + 1)) x(i)),
free AS (SELECT * FROM grid g WHERE NOT EXISTS (SELECT 1 FROM masked m WHERE m.slide = g.slide AND m.my = g.my AND m.mx = g.mx)),
reach AS (
    SELECT slide, my, mx FROM free WHERE my = y0 AND mx = x0
    UNION SELECT f.slide, f.my, f.mx FROM (SELECT slide, my + dy AS my, mx + dx AS mx FROM reach, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) v(dy, dx)) r JOIN free f ON f.slide = r.slide AND f.my = r.my AND f.mx = r.mx
)
SELECT slide, CAST(my AS INTEGER) AS my, CAST(mx AS INTEGER) AS mx FROM grid g WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.slide = g.slide AND r.my = g.my AND r.mx = g.mx)""")
def fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.fill_holes(_masked(spark, sf_dir), 32)


@query("""WITH p AS (SELECT DISTINCT CAST(p_size AS INTEGER) AS y, CAST((p_partkey * 7) % 64 AS INTEGER) AS x FROM part),
k AS (SELECT y, x, exp(-((y - 32.0::DOUBLE) * (y - 32.0::DOUBLE) + (x - 32.0::DOUBLE) * (x - 32.0::DOUBLE)) / (2 * 16.0::DOUBLE * 16.0::DOUBLE)) * pow(sin(pi() / 2 * least(1.0::DOUBLE, least(y, x, 63 - y, 63 - x) / 4.0::DOUBLE)), 2) AS w FROM (SELECT * FROM p UNION SELECT 32, 32))
SELECT p.y, p.x, round(w, 6) AS weight FROM p JOIN k USING (y, x)""")
def blend_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = P.table(spark, sf_dir, "part").select(F.col("p_size").alias("y"), (F.col("p_partkey") * 7 % 64).cast("int").alias("x")).distinct()
    return rounded(blend.blend_kernel(at, 64, 4, 16.0))


@query("""SELECT event_id, round((event_id % 256) / 127.5::DOUBLE - 1, 6) AS normalized, CAST(trunc(least(greatest(((value - 50) / 50 + 1) * 127.5::DOUBLE, 0.0::DOUBLE), 255.0::DOUBLE)) AS INTEGER) AS restored FROM events""")
def normalize_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.table(spark, sf_dir, "events")
    return rounded(e.select("event_id", raster.normalize(F.col("event_id") % 256).alias("normalized"), raster.denormalize((F.col("value") - 50) / 50).alias("restored")))


@query("""WITH p AS (SELECT user_id AS image, event_id, CASE WHEN user_id % 2 = 0 THEN value ELSE (event_id % 11) / 10.0::DOUBLE END AS v FROM events), m AS (SELECT image, max(v) AS top FROM p GROUP BY image)
SELECT image, event_id, round(CASE WHEN top > 1 THEN v / 255.0::DOUBLE ELSE v END, 6) AS v FROM p JOIN m USING (image)""")
def normalize_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.table(spark, sf_dir, "events").select(F.col("user_id").alias("image"), "event_id", F.when(F.col("user_id") % 2 == 0, F.col("value")).otherwise((F.col("event_id") % 11) / 10.0).alias("v"))
    return rounded(raster.normalize_adaptive(e, ("image",)))


@query("""WITH shapes AS (
    SELECT p_partkey AS id, 'w' || (p_partkey % 50) AS wsi_name, (p_partkey // 50) * 7 % 200 AS x, (p_partkey // 50) * 11 % 150 AS y, 4 + p_size % 12 AS w, 3 + p_size % 7 AS h, p_size % 3 AS cut FROM part
),
cells AS (SELECT id, wsi_name, y + i AS cy, x + j AS cx FROM shapes, LATERAL unnest(range(h)) a(i), LATERAL unnest(range(w)) b(j) WHERE NOT (cut > 0 AND i >= cut AND j >= cut)),
sizes AS (SELECT id, count(*) AS n FROM cells GROUP BY id),
met AS (SELECT a.wsi_name, a.id AS id_a, b.id AS id_b, count(*) AS shared FROM cells a JOIN cells b ON a.wsi_name = b.wsi_name AND a.cy = b.cy AND a.cx = b.cx AND a.id < b.id GROUP BY ALL)
SELECT wsi_name, id_a, id_b, shared, a.n AS pixels_a, b.n AS pixels_b, round(shared / (a.n + b.n - shared), 6) AS iou FROM met JOIN sizes a ON a.id = id_a JOIN sizes b ON b.id = id_b""")
def shape_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels shared by true shapes: rectangles and angles, whose boxes overlap more often than they do."""
    k, size = F.col("p_partkey"), F.col("p_size")
    x, y = (F.floor(k / 50) * 7 % 200).cast("int"), (F.floor(k / 50) * 11 % 150).cast("int")
    w, h, cut = (4 + size % 12).cast("int"), (3 + size % 7).cast("int"), (size % 3).cast("int")
    point = lambda a, b: F.struct((x + a).cast("double").alias("x"), (y + b).cast("double").alias("y"))
    zero, right, low = F.lit(0), w - 1, h - 1
    whole = F.array(point(zero, zero), point(right, zero), point(right, low), point(zero, low))
    angle = F.array(point(zero, zero), point(right, zero), point(right, cut - 1), point(cut - 1, cut - 1), point(cut - 1, low), point(zero, low))
    objects = P.spread(P.table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(F.concat(F.lit("w"), k % 50).alias("wsi_name"), k.alias("id"), F.when(cut > 0, angle).otherwise(whole).alias("contour"))
    return rounded(shapes.shape_pairs(objects, "wsi_name", "id"))


@query(f"""WITH RECURSIVE {P.PIXELS},
m AS (SELECT DISTINCT slide, y, x FROM pixels WHERE (r + g + b) / 3.0::DOUBLE < 95),
reach AS (
    SELECT slide, y, x, y AS fy, x AS fx FROM m
    UNION SELECT r.slide, m.y, m.x, r.fy, r.fx FROM reach r JOIN m ON m.slide = r.slide AND m.y BETWEEN r.y - 1 AND r.y + 1 AND m.x BETWEEN r.x - 1 AND r.x + 1
),
named AS (SELECT slide, y, x, min(fy * 1000 + fx) AS part FROM reach GROUP BY ALL)
SELECT slide, CAST(part // 1000 AS INTEGER) AS first_y, CAST(part % 1000 AS INTEGER) AS first_x, count(*) AS cells, min(y) AS y1, min(x) AS x1, max(y) AS y2, max(x) AS x2 FROM named GROUP BY slide, part""")
def mask_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a sparse mask, by their first pixel, with sizes and boxes."""
    cells = tissue.tissue_mask(P.pixels(spark, sf_dir), 95.0).filter("mask = 1").select("slide", F.col("y").alias("my"), F.col("x").alias("mx")).distinct()
    return parts.part_stats(cells, 32)


@query()
def extract_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parts.trace_contours(_masked(spark, sf_dir), 32)
    return rounded(found.select("slide", "contour_id", F.size("contour").alias("points"), "area"))


@query(f"""WITH {P.SLIDES}, m AS (SELECT wsi_path, CAST(w AS DOUBLE) * h * 16 AS whole, CAST(w AS DOUBLE) * 4096 * 16 AS strip, CAST(w AS DOUBLE) * h AS px FROM slides)
SELECT wsi_path, round(px * 12 / 1048576, 6) AS output_image_mb, round(px * 4 / 1048576, 6) AS weight_map_mb, round(whole / 1048576 + 50, 6) AS estimated_total_mb, round(strip / 1048576, 6) AS strip_gpu_mb,
       round((strip * 5 + 16777216) / 1048576, 6) AS peak_gpu_mb, round(whole / 1048576, 6) AS cpu_mb, round((strip * 5 + 16777216 + whole) / 1073741824, 6) AS total_gb FROM m""")
def memory_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.memory_estimate(P.slides(spark, sf_dir)))


@query(f"WITH {P.SLIDES} SELECT wsi_path, CAST(ceil(ceil(h / 448) * 1792 / 1792) AS INTEGER) AS total_rows, CAST(ceil(ceil(w / 448) * 1792 / 1792) AS INTEGER) AS total_cols, 28672 AS strip_height FROM slides")
def strip_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.strip_plan(grid.output_dims(P.slides(spark, sf_dir)))


@query("""WITH numbered AS (SELECT *, p_partkey AS k FROM part)
SELECT CAST(k // 64 AS INTEGER) AS row, CAST(k % 64 AS INTEGER) AS col, CAST(k * 7 % 256 AS INTEGER) AS r, CAST(k * 13 % 256 AS INTEGER) AS g, CAST(p_size AS INTEGER) AS b FROM numbered""")
def slide_file_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of a tile for each part, each of one colour, written with LZW and read back."""
    k = F.col("p_partkey").cast("long")
    colours = [F.lpad(F.hex(c), 2, "0") for c in (k * 7 % 256, k * 13 % 256, F.col("p_size").cast("long"))]
    cells = F.floor(k / 64).cast("int").alias("row"), (k % 64).cast("int").alias("col")
    part = P.table(spark, sf_dir, "part")
    tiles = P.spread(part).select(*cells, F.lit(16).alias("h"), F.lit(16).alias("w"), F.unhex(F.repeat(F.concat(*colours), 256)).alias("data"))
    path = scratch.place(spark, "slide-file").removeprefix("file:")
    rows = part.agg(F.max(cells[0])).first()[0] + 1
    tiff.write_pyramid(tiles, path, 64 * 16, rows * 16, 16, compression="lzw")
    spark.dataSource.register(tiff.SlideSource)  # the session may be any
    found = spark.read.format("slide").option("rowsPerPartition", max(1, rows // 32)).load(path).filter("h = 16 and w = 16")
    parts = [F.conv(F.hex(F.substring("data", i + 1, 1)), 16, 10).cast("int").alias(c) for i, c in enumerate("rgb")]
    # tiles of one colour: the first pixel's bytes, repeated, are all of them
    whole = F.unhex(F.repeat(F.hex(F.substring("data", 1, 3)), 256)) == F.col("data")
    # merged: the estimate of a table of few columns lets Spark broadcast all its keys
    return found.filter(whole).select("row", "col", *parts).join(part.select(*cells).hint("merge"), ["row", "col"], "left_semi")


@query("""SELECT p_partkey, CAST(i AS INTEGER) AS block, CAST(CASE i WHEN 0 THEN p_size WHEN 1 THEN p_partkey % 256 WHEN 2 THEN (p_partkey * 7 + p_size) % 256 ELSE 255 END AS INTEGER) AS level
FROM part, LATERAL unnest(range(4)) u(i)""")
def jpeg_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of four grey blocks for each part as a JPEG stream without loss of its means, decoded again."""
    k = F.col("p_partkey").cast("int")
    levels = F.array(F.col("p_size").cast("int"), k % 256, (k * 7 + F.col("p_size").cast("int")) % 256, F.lit(255))
    streams = slides.encode_jpeg_blocks(P.spread(P.table(spark, sf_dir, "part").select("p_partkey", levels.alias("levels"))), "p_partkey")
    decoded = streams.select("p_partkey", slides.decode_image("content").alias("image"))
    first = lambda i: F.conv(F.hex(F.substring("image.data", (i % 2 * 8 + F.floor(i / 2) * 8 * 16).cast("int") * 3 + 1, 1)), 16, 10).cast("int")
    return decoded.select("p_partkey", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), first(F.lit(i)).alias("level")) for i in range(4)])).alias("e")).select("p_partkey", "e.block", "e.level")


@query("""SELECT page_id, regexp_extract(url, '([^/]+)$', 1) AS name, regexp_replace(regexp_extract(url, '([^/]+)$', 1), '\\.[^.]+$', '') AS stem, lower(regexp_extract(url, '\\.[^./]+$', 0)) AS suffix, printf('p_%04d', page_id % 10000) AS padded, replace(url, '_super_resolved', '') AS plain, concat_ws('; ', 'page', CAST(page_id AS VARCHAR)) AS joined FROM pages""")
def string_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_extract("url", "([^/]+)$", 1)
    return P.table(spark, sf_dir, "pages").select(
        "page_id",
        name.alias("name"),
        F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"),
        F.lower(F.regexp_extract("url", r"\.[^./]+$", 0)).alias("suffix"),
        F.format_string("p_%04d", F.col("page_id") % 10000).alias("padded"),
        F.replace("url", F.lit("_super_resolved"), F.lit("")).alias("plain"),
        F.concat_ws("; ", F.lit("page"), F.col("page_id").cast("string")).alias("joined"),
    )


@query()
def ann_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest records of every twentieth one; 12 of 16 lists reach a recall above 0.9 (README)."""
    v = P.vectors(spark, sf_dir)
    centres = search.coarse_centroids(v, lists=16)
    return rounded(search.search_lists_each(search.index_lists(v, centres), centres, v.filter("record_id % 20 = 0"), probes=12))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_daily_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")
