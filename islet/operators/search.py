"""Breadth-first search, from one vertex or from the least vertex of every component at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from islet.operators import components
from islet.operators.components import LOCAL_EDGES
from islet.operators.edges import oriented, reverse, vertices
from islet.storage import drop, gather, stage

MOST_LEVELS = 100_000
TREE = "id long, root long, parent long, level long"


def flooded(u: np.ndarray, v: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """``id, root, parent, level`` of each level of the search from ``starts`` over the directed edges u - v."""
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    ids = np.unique(np.concatenate([u, starts]))
    first, to = np.searchsorted(u, ids), np.searchsorted(ids, v)
    last = np.searchsorted(u, ids, "right")
    root = np.full(len(ids), -1, np.int64)
    now = np.searchsorted(ids, starts)
    root[now] = starts
    out = [(starts, starts, starts, np.zeros(len(starts), np.int64))]
    while len(now):
        many = last[now] - first[now]
        edge = np.repeat(first[now] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        source, target = np.repeat(now, many), to[edge]
        fresh = root[target] < 0
        source, target = source[fresh], target[fresh]
        order = np.lexsort((source, target))  # positions follow ids, so the least source is the least parent
        source, target = source[order], target[order]
        new = np.ones(len(target), bool)
        new[1:] = target[1:] != target[:-1]
        source, target = source[new], target[new]
        root[target] = root[source]
        out.append((ids[target], root[target], ids[source], np.full(len(target), len(out), np.int64)))
        now = target
    return out


def _flooded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[b.column(i).to_numpy() for i in range(3)] for b in batches]
    if parts:
        u, v, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        mine = start == 1
        for level in flooded(np.concatenate([u[~mine], v[~mine]]), np.concatenate([v[~mine], u[~mine]]), np.unique(u[mine])):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in level], ["id", "root", "parent", "level"])


def levels(edges: DataFrame, roots: DataFrame | None = None, local: int = LOCAL_EDGES) -> DataFrame:
    """``id, root, parent, level``: the search tree of each root; without ``roots(id)``, of every component's least id.

    One frontier for all roots: the number of steps is the largest depth, whatever the number of
    components. ``parent`` is the least neighbour on the level before (the root's own id for a root),
    so the tree doesn't depend on the order of arrival. Roots in one component must not be mixed.
    Vertices that no root reaches are left out.

    Each level is written, a job each, and the result is one scan of all levels. At most ``local``
    edges, counted first, are searched by one task: a level costs a small graph more than its work.
    """
    once, seen = oriented(edges), Observation()
    once = stage(once.observe(seen, F.count("*").alias("n")), "edges")
    if roots is None:
        start = components.labels(edges, local).where("id = comp").select("id")
    else:
        start = roots.select("id").join(vertices(edges), "id", "left_semi").distinct()
    if seen.get["n"] <= local:
        alone = once.select("u", "v", F.lit(0).alias("start")).unionByName(start.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(1).alias("start")))
        return stage(alone.coalesce(1).mapInArrow(_flooded, TREE), "levels")
    sym = stage(once.unionByName(reverse(once)), "both-ways")
    drop(once)
    frontier = stage(start.select("id", F.col("id").alias("root"), F.col("id").alias("parent"), F.lit(0).cast("long").alias("level")), "frontier")
    done = [frontier]
    before = None
    for level in range(1, MOST_LEVELS):
        step = frontier.select(F.col("id").alias("u"), "root").join(sym, "u").groupBy(F.col("v").alias("id")).agg(F.min("root").alias("root"), F.min("u").alias("parent"))
        # neighbours lie on the level before, the same or the next: only two levels need to be looked at
        step = step.join(frontier.select("id"), "id", "left_anti")
        if before is not None:
            step = step.join(before.select("id"), "id", "left_anti")
        found = Observation()
        step = stage(step.select("id", "root", "parent", F.lit(level).cast("long").alias("level")).observe(found, F.count("*").alias("n")), "frontier")
        if not found.get["n"]:
            drop(step, sym)
            return gather(done)
        before, frontier = frontier, step
        done.append(step)
    raise RuntimeError(f"the search did not end within {MOST_LEVELS} levels")


def children(tree: DataFrame) -> DataFrame:
    """``id, children``: how many vertices of the tree have each as their parent; leaves have 0."""
    counted = tree.where("id <> parent").groupBy(F.col("parent").alias("_of")).agg(F.count("*").alias("children"))
    return tree.select("id").join(counted, F.col("id") == F.col("_of"), "left").select("id", F.coalesce("children", F.lit(0)).cast("long").alias("children"))


def rounds(tree: DataFrame) -> DataFrame:
    """``r``: broadcast and echo steps of a search one component after the other: 1 for a lone vertex, else twice the depth and 2."""
    depth = tree.groupBy("root").agg(F.max("level").alias("d"))
    return depth.agg(F.coalesce(F.sum(F.when(F.col("d") == 0, 1).otherwise(2 * F.col("d") + 2)), F.lit(0)).cast("long").alias("r"))


def subtrees(tree: DataFrame) -> DataFrame:
    """``id, subtree``: vertices at and below each vertex of the tree, summed level by level from the deepest.

    The tree is written in ranges of levels, so that a level's scan skips the row groups of others;
    a level of most vertices is several ranges. The result is one scan of all levels.
    """
    kept = stage(tree.select("id", "parent", "level").repartitionByRange("level", "id").sortWithinPartitions("level"), "tree")
    deepest = kept.agg(F.max("level")).first()[0]
    if deepest is None:
        return kept.select("id", F.lit(1).cast("long").alias("subtree")).limit(0)
    counted = stage(kept.where(F.col("level") == deepest).select("id", "parent", F.lit(1).cast("long").alias("subtree")), "subtree")
    done = [counted]
    for level in range(deepest - 1, -1, -1):
        below = counted.groupBy(F.col("parent").alias("id")).agg(F.sum("subtree").alias("n"))
        counted = stage(kept.where(F.col("level") == level).join(below, "id", "left").select("id", "parent", (F.coalesce("n", F.lit(0)) + 1).cast("long").alias("subtree")), "subtree")
        done.append(counted)
    drop(kept)
    return gather(done).select("id", "subtree")
