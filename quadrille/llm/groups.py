"""Connected components of an edge table, and joins of texts with small tables of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.shared import cut

#: Ids that may be broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least v of each u: a join, which AQE splits where one u has most edges."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the smallest node it is connected with, for the nodes of edges (a, b); a component's own smallest
    node is included.

    Alternating large-star and small-star steps; every step is a grouping by node, and each round is written to the
    shared folder. Self-loops and nulls are ignored.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).withColumn("m", F.least("m", "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_least(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def by_id(docs: DataFrame, ids: DataFrame, how: str, on: str = "doc_id") -> DataFrame:
    """docs joined with a table of ids: broadcast while that has few rows, shuffled beyond."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, on, how)
