"""Vector search and predicate queries over stored records."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.config import StoreConfig

# fixed values: the fields that a predicate query returns
QUERY_FIELDS = (
    "record_id", "wsi_name", "task_id", "centroid_x", "centroid_y", "bbox_x", "bbox_y", "bbox_w", "bbox_h",
    "circularity", "aspect_ratio", "edge_roughness", "abnormality_score", "abnormality_reasons", "polygon_coords",
)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine of a vector column and a literal one, in doubles; 0 where either has no length."""
    v, q = vector.cast("array<double>"), F.array(*[F.lit(float(x)) for x in query])
    norm = F.sqrt(_dot(v, v)) * float(np.sqrt(sum(float(x) ** 2 for x in query)))
    return F.when(norm > 0, _dot(v, q) / norm).otherwise(F.lit(0.0))


def search_similar(records: DataFrame, query: Sequence[float], top_k: int = StoreConfig().top_k, where: Column | None = None, vector: str = "feature_vector", key: str = "record_id") -> DataFrame:
    """The ``top_k`` most similar records (ties: key), each partition keeping its own best first."""
    rows = records if where is None else records.filter(where)
    return rows.withColumn("distance", cosine(F.col(vector), query)).orderBy(F.desc("distance"), key).limit(top_k)


def query_abnormal(records: DataFrame, min_score: float = 0.6, wsi_name: str = "", limit: int = StoreConfig().limit) -> DataFrame:
    """Records at or above a score, worst first; an empty slide name means all slides."""
    where = F.col("abnormality_score") >= F.lit(min_score)
    if wsi_name:
        where = where & (F.col("wsi_name") == F.lit(wsi_name))
    return records.filter(where).select(*QUERY_FIELDS).orderBy(F.desc("abnormality_score"), "record_id").limit(limit)


def coarse_centroids(records: DataFrame, lists: int, sample: int = 5000, rounds: int = 8, seed: int = 1, vector: str = "feature_vector", key: str = "record_id") -> np.ndarray:
    """Unit centroids of spherical k-means over at most ``sample`` records (least hashes of the key)."""
    rows = records.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(key)).limit(sample).select(vector).collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.array([r[0] for r in rows], float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = x[np.random.default_rng(seed).permutation(len(x))[: min(lists, len(x))]]
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres


def _nearest(vector: Column, centres: np.ndarray) -> Column:
    """Number of the most similar centroid (ties: the least number), 0 for no vector or no centroid."""
    if not len(centres):
        return F.lit(0)
    scores = F.transform(_table(centres), lambda c: _dot(vector.cast("array<double>"), c))
    return F.coalesce(F.array_position(scores, F.array_max(scores)) - 1, F.lit(0)).cast("int")


def _table(centres: np.ndarray) -> Column:
    """The centroids as one literal, whatever their number."""
    return F.from_json(F.lit(json.dumps(centres.tolist())), "array<array<double>>")


def index_lists(records: DataFrame, centres: np.ndarray, vector: str = "feature_vector") -> DataFrame:
    """Every record with its ``list``; written partitioned by it, a probe prunes to a few lists."""
    return records.withColumn("list", _nearest(F.col(vector), centres))


def search_lists(indexed: DataFrame, centres: np.ndarray, query: Sequence[float], probes: int, top_k: int = StoreConfig().top_k, **kw) -> DataFrame:
    """search_similar within the ``probes`` lists nearest to the query."""
    order = np.argsort(-(centres @ np.asarray(query, float)), kind="stable")[:probes]
    return search_similar(indexed.filter(F.col("list").isin([int(i) for i in order])), query, top_k, **kw)


#: Records of one list, and queries that probe it, that a task compares at a time.
BLOCK = 2048


def search_lists_each(indexed: DataFrame, centres: np.ndarray, queries: DataFrame, probes: int, top_k: int = StoreConfig().top_k, vector: str = "feature_vector", key: str = "record_id") -> DataFrame:
    """search_lists for every row of ``queries``, by its ``key`` as query_id; the vector is not returned.

    Lists and the queries that probe them meet in blocks, each of which keeps a query's
    best; cosines are compared to 12 digits (ties: key).
    """
    def blocks(lists: DataFrame) -> Column:
        sizes = {r["list"]: r["n"] for r in lists.groupBy("list").agg(F.count("*").alias("n")).collect()}
        return F.array(*[F.lit(max(1, -(-sizes.get(i, 0) // BLOCK))) for i in range(len(centres))])

    v = F.col(vector).cast("array<double>")
    order = F.array_sort(F.transform(_table(centres), lambda c, i: F.struct((-_dot(v, c)).alias("far"), i.alias("list"))))
    asked = queries.filter(F.col(vector).isNotNull()).select(F.col(key).alias("query_id"), F.col(vector).alias("query"), F.explode(F.slice(order, 1, probes)["list"]).alias("list"))
    n_records, n_queries = blocks(indexed), blocks(asked)
    at = F.col("list") + 1
    dealt = indexed.filter(F.col(vector).isNotNull())
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(key), F.element_at(n_records, at)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.element_at(n_queries, at) - 1)))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.element_at(n_queries, at)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.element_at(n_records, at) - 1)))
    keep = [c for c in indexed.columns if c != vector]

    def best(records: pa.Table, asking: pa.Table) -> pa.Table:
        records = records.sort_by(key)
        x, q = (np.array(c.to_pylist(), float).reshape(len(c), len(centres[0])) for c in (records.column(vector), asking.column("query")))
        chosen, by, cosines = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(x):
            for low in range(0, len(q), 256):
                some = q[low : low + 256]
                norm = np.linalg.norm(some, axis=1)[:, None] * np.linalg.norm(x, axis=1)
                likeness = np.round(np.where(norm > 0, some @ x.T / np.where(norm > 0, norm, 1), 0.0), 12)
                last = np.partition(likeness, max(0, len(x) - top_k), axis=1)[:, max(0, len(x) - top_k)]
                row, col = np.nonzero(likeness >= last[:, None])
                sort = np.lexsort((col, -likeness[row, col], row))
                row, col = row[sort], col[sort]
                first = np.searchsorted(row, np.arange(len(some)))
                near = np.arange(len(row)) - first[row] < top_k
                chosen.append(col[near])
                by.append(row[near] + low)
                cosines.append(likeness[row[near], col[near]])
        out = records.select(keep).take(pa.array(np.concatenate(chosen)))
        found = asking.column("query_id").take(pa.array(np.concatenate(by)))
        return pa.Table.from_arrays([found, *out.columns, pa.array(np.concatenate(cosines))], names=["query_id", *keep, "distance"])

    kinds = dict(indexed.dtypes)
    fields = ", ".join([f"query_id {kinds[key]}", *[f"`{c}` {kinds[c]}" for c in keep], "distance double"])
    cell = ["list", "block", "part"]
    near = dealt.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(best, fields)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("distance"), key))
    return near.withColumn("place", place).filter(F.col("place") <= top_k).drop("place")
