"""Connected components of an edge table, entirely as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aligner.session import stage


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One round of star edges: the neighbours of every node are linked to the smallest node among them and itself.

    ``larger_only`` links the larger neighbours of each node, otherwise its smaller ones and itself.
    """
    if larger_only:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(smallest, "u")
    if larger_only:
        linked = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(smallest.select("u", F.col("m").alias("v")))
    return linked.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``u, v`` (longs) that isn't a root itself; a root is its component's smallest node.

    Alternates the two kinds of stars until the edges stay the same; a round shrinks the distance to the root by a constant
    factor or better. Each round is a written table. Self-loops and repeated edges are allowed, edges with a null end are not
    edges; no edges give an empty table.
    """
    edges = stage(edges.where("u is not null and v is not null and u != v").select("u", "v").distinct(), "edges")
    before = None
    while True:
        edges = stage(_star(_star(edges, True), False), "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
