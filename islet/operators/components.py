"""Connected components by alternating large-star and small-star contraction.

The method of Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014): each round
ties neighbourhoods to their least vertex, and after about log² rounds every vertex is tied to the
least of its component. Rounds are two aggregations and joins with map-side minima, so a vertex with
a large share of all edges is never gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from islet.operators.edges import oriented, vertices
from islet.storage import drop, stage

MOST_ROUNDS = 200
#: Edges (16 bytes each) that one task may finish by itself; their number is checked first.
LOCAL_EDGES = 2_000_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex's larger neighbours are tied to the least of its neighbourhood. Edges are (larger, smaller)."""
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # the larger neighbours of u are the edges that have u as their smaller end
    return edges.select(F.col("u").alias("big"), F.col("v").alias("u")).join(least, "u").select(F.col("big").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex and its smaller neighbours are tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` written, with their number and hash sum, taken as they are written."""
    seen = Observation()
    table = stage(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "stars")
    return table, (seen.get["n"], seen.get["h"])


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges (a, b) and the least vertex of each one's component."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    head = np.arange(len(ids))
    while len(a):
        high, low = np.maximum(head[a], head[b]), np.minimum(head[a], head[b])
        open_ = high != low
        a, b, high, low = a[open_], b[open_], high[open_], low[open_]
        np.minimum.at(head, high, low)
        while not np.array_equal(up := head[head], head):
            head = up
    return ids, ids[head]


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        ids, least = least_labels(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        other = ids != least
        yield pa.RecordBatch.from_arrays([pa.array(ids[other]), pa.array(least[other])], ["u", "v"])


def stars(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``u, v``: every vertex that is not the least of its component, and the least.

    Each round is written to shared storage and its predecessor deleted; the rounds end when the
    edges stay as they are (count and hash sum), or when they number ``local_edges`` at most, which
    one task finishes: a round costs a small graph more than all of its work.
    """
    now, state = _settled(oriented(edges).select(F.col("v").cast("long").alias("u"), F.col("u").cast("long").alias("v")))
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            return now
        if state[0] <= local_edges:
            return now.coalesce(1).mapInArrow(_finished, "u long, v long")
        last = state
        new, state = _settled(_small_star(_large_star(now)))
        drop(now)
        now = new
        if state == last:
            return now
    raise RuntimeError("components did not settle")


def labels(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``id, comp``: each vertex and the least id of its component; isolated vertices are their own."""
    tied = stars(edges, local_edges).select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return vertices(edges).join(tied, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
