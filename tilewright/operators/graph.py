"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.sources.scratch import discard, written


def components(edges: DataFrame, label: str) -> DataFrame:
    """(id, component) of each id in the undirected ``edges`` (a, b long): the least id it is connected to.

    Alternating large-star and small-star rounds; each aggregates before it
    shuffles, joins on the centre (which adaptive execution splits where it is hot)
    and is written, so that no round depends on an executor's memory.
    """
    def least(u: str, v: str, rows: DataFrame) -> DataFrame:
        # written, so that the join has two plain inputs, of which adaptive execution splits a hot centre
        own = written(rows.groupBy(u).agg(F.min(v).alias("m")).select(u, F.least(u, "m").alias("m")), label)
        parts.append(own)
        return rows.join(own, u)

    edges = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before, parts = None, []
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = written(least("a", "b", both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), label)
        parts.append(large)
        small = least("a", "b", large)
        small = small.select(F.col("b").alias("x"), "m").unionByName(small.select(F.col("a").alias("x"), "m")).filter("x != m")
        last, edges = edges, written(small.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), label)
        discard(last, *parts)
        parts.clear()
        # stars only, and the same as before: settled
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
