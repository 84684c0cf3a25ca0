"""Edge tables: ``(u, v)`` longs, undirected; a self-edge declares a vertex and is no neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reverse(edges: DataFrame) -> DataFrame:
    """Each edge the other way round."""
    return edges.select(F.col("v").alias("u"), F.col("u").alias("v"))


def proper(edges: DataFrame) -> DataFrame:
    """Edges between two different vertices."""
    return edges.select("u", "v").where("u <> v")


def self_edges(edges: DataFrame) -> DataFrame:
    """Vertex declarations."""
    return edges.select("u", "v").where("u = v").distinct()


def oriented(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, the smaller endpoint first; duplicates and reversals collapse."""
    return proper(edges).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def symmetrized(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once. Duplicates collapse before the directions double them."""
    once = oriented(edges)
    return once.unionByName(reverse(once))


def vertices(edges: DataFrame) -> DataFrame:
    """Every id that an edge or a declaration mentions."""
    return edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def degree(edges: DataFrame) -> DataFrame:
    """``id, degree``: distinct neighbours of each vertex; declared vertices have 0."""
    counted = symmetrized(edges).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"))
    return vertices(edges).join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """``id, neighbors``: the sorted distinct neighbours of each vertex."""
    near = symmetrized(edges).groupBy(F.col("u").alias("id")).agg(F.sort_array(F.collect_set("v")).alias("neighbors"))
    return vertices(edges).join(near, "id", "left").select("id", F.coalesce("neighbors", F.array().cast("array<bigint>")).alias("neighbors"))


def singletons(edges: DataFrame) -> DataFrame:
    """Vertices without neighbours."""
    joined = proper(edges).select(F.explode(F.array("u", "v")).alias("id"))
    return vertices(edges).join(joined, "id", "left_anti")


def without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges of which no endpoint is among the ids of ``gone``."""
    left = edges.join(gone.select(F.col("id").alias("u")), "u", "left_anti")
    return left.join(gone.select(F.col("id").alias("v")), "v", "left_anti").select("u", "v")


def sampled(edges: DataFrame, p: float, seed: int) -> DataFrame:
    """Each undirected edge with probability ``p``; the same edges in every run, whatever the partitioning."""
    if not 0 <= p <= 1:
        raise ValueError("p must be from 0 to 1")
    digits = F.substring(F.md5(F.concat_ws(" ", "u", "v", F.lit(int(seed)))), 1, 13)  # 52 bits
    draw = F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))
    return oriented(edges).where(draw < p)
