"""Connected components of an edge table by alternating star contraction, in joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex moves to the smallest of the vertex and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of a vertex, and itself, move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b") -> Saved:
    """(doc_id, component_id) of each vertex that has an edge to another, component_id being its least vertex.

    Self edges and repeated edges are ignored; an empty table gives an empty one. A hub of any degree meets its
    minimum by a partial aggregate and a join that can be split, so no vertex's neighbours gather in one task.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    edges = Saved(pairs.select(u.cast("long").alias("u"), v.cast("long").alias("v")).where("u > v").distinct(), "edges")
    mark = None
    while True:
        nxt = Saved(_small_star(_large_star(edges.df)), "edges")
        edges.drop()
        edges = nxt
        row = edges.df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (row["n"], row["s"]) == mark:
            break
        mark = (row["n"], row["s"])
    roots = edges.df.select(F.col("v").alias("doc_id"), F.col("v").alias("component_id")).distinct()
    out = Saved(edges.df.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id")).unionByName(roots), "components")
    edges.drop()
    return out
