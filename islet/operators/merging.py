"""Components by merging along least outgoing edges, phase by phase (Borůvka's method).

Edges are ordered by (smaller endpoint, larger endpoint). In a phase every component picks its
least edge to another component, all components hook along theirs at once, and each group of hooked
components takes the label that its core keeps: the two components that picked the same edge are
the core, and the smaller endpoint of that edge becomes the label. The picked edges are the minimum
spanning forest under the order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from islet.operators.components import LOCAL_EDGES
from islet.operators.edges import oriented, vertices
from islet.storage import drop, stage

MOST_PHASES = 64


@dataclass
class Merged:
    """``labels(id, comp, root)``, ``forest(phase, lo, hi)`` and the number of phases."""

    labels: DataFrame
    forest: DataFrame
    phases: int


def least_edges(edges: DataFrame) -> DataFrame:
    """``cu, lo, hi, cv``: for each component the least edge that leaves it, and where it leads.

    ``edges``: lo, hi and the labels clo, chi of their ends, each undirected edge once. The minimum
    is taken map-side first, so a component with most of the edges is one row a task.
    """
    sides = F.explode(F.array(F.struct(F.col("clo").alias("cu"), F.col("chi").alias("cv")), F.struct(F.col("chi").alias("cu"), F.col("clo").alias("cv"))))
    both = edges.where("clo <> chi").select("lo", "hi", sides.alias("s")).select("s.cu", "s.cv", "lo", "hi")
    return both.groupBy("cu").agg(F.min(F.struct("lo", "hi", "cv")).alias("m")).select("cu", "m.lo", "m.hi", "m.cv")


def core_edges(least: DataFrame) -> DataFrame:
    """Edges picked by both of their components: ``lo, hi, a, b`` with the components in order."""
    other = least.select(F.col("cu").alias("cv"), F.col("cv").alias("cu"), F.col("lo").alias("lo2"))
    return least.join(other, ["cu", "cv"]).where("lo = lo2 and cu < cv").select("lo", "hi", F.col("cu").alias("a"), F.col("cv").alias("b"))


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[b.column(i).to_numpy() for i in range(4)] for b in batches]
    if parts:
        cu, lo, hi, cv = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(cu)
        cu, lo, hi, cv = (x[order] for x in (cu, lo, hi, cv))
        head = np.searchsorted(cu, cv)
        core = (cv[head] == cu) & (lo[head] == lo) & (hi[head] == hi)
        head = np.where(core, np.arange(len(cu)), head)
        while not np.array_equal(up := head[head], head):
            head = up
        yield pa.RecordBatch.from_arrays([pa.array(cu), pa.array(lo[head])], ["cu", "root"])


def _roots(least: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """``cu, root``: the new label of each component. Chains of hooks end at a core and are halved each step.

    At most ``local`` components, counted first, are followed by one task.
    """
    if least.count() <= local:
        return least.select("cu", "lo", "hi", "cv").coalesce(1).mapInArrow(_rooted, "cu long, root long")
    pointed = least.withColumn("_both", F.struct(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")))
    core = core_edges(least).select(F.explode(F.array("a", "b")).alias("cu"), F.col("lo").alias("root"), F.lit(True).alias("done"))
    start = pointed.join(core, "cu", "left").select("cu", F.when(F.col("done"), F.col("root")).otherwise(F.col("cv")).alias("to"), F.coalesce("done", F.lit(False)).alias("done"))
    now = stage(start, "hooks")
    while now.where("not done").limit(1).count():
        ahead = now.select(F.col("cu").alias("to"), F.col("to").alias("next"), F.col("done").alias("ends"))
        settled = now.where("done")
        moved = now.where("not done").join(ahead, "to").select("cu", F.col("next").alias("to"), F.col("ends").alias("done"))
        new = stage(settled.unionByName(moved), "hooks")
        drop(now)
        now = new
    return now.select("cu", F.col("to").alias("root"))


def phased(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Ids of the edges (u, v), u < v, the root of each, and the edges picked in each phase."""
    order = np.lexsort((v, u))  # edges are numbered in their order
    u, v = u[order], v[order]
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    root, picked = np.arange(len(ids)), []
    left = np.arange(len(u))
    a, b = ends[: len(u)], ends[len(u) :]
    while True:
        x, y = root[a[left]], root[b[left]]
        left, x, y = (k[x != y] for k in (left, x, y))
        if not len(left):
            return ids, ids[root], picked
        least = np.full(len(ids), len(u), np.int64)
        np.minimum.at(least, x, left)
        np.minimum.at(least, y, left)
        has = np.flatnonzero(least < len(u))
        edge = least[has]
        p, q = root[a[edge]], root[b[edge]]
        head = np.arange(len(ids))
        head[has] = np.where(p == has, q, p)
        core = has[least[head[has]] == edge]
        head[core] = core
        while not np.array_equal(up := head[head], head):
            head = up
        label = np.arange(len(ids))
        label[has] = a[least[head[has]]]  # the smaller end of the core's edge
        root = label[root]
        chosen = np.unique(edge)
        picked.append((u[chosen], v[chosen]))


def _phased(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[b.column(i).to_numpy() for i in range(2)] for b in batches]
    if parts:
        ids, root, picked = phased(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        names = ["phase", "a", "b"]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int32)), pa.array(ids), pa.array(root)], names)
        for k, (lo, hi) in enumerate(picked):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lo), k + 1, np.int32)), pa.array(lo), pa.array(hi)], names)


def _merged_in_one(once: DataFrame, edges: DataFrame) -> Merged:
    """What ``merge`` returns, by one task."""
    found, seen = once.coalesce(1).mapInArrow(_phased, "phase int, a long, b long"), Observation()
    found = stage(found.observe(seen, F.max("phase").alias("last")), "phases")
    roots = found.where("phase = 0").select(F.col("a").alias("id"), F.col("b").alias("root"))
    comps = roots.groupBy("root").agg(F.min("id").alias("comp"))
    joined = roots.join(comps, "root").select("id", "comp", "root")
    alone = vertices(edges).select("id").join(roots, "id", "left_anti").select("id", F.col("id").alias("comp"), F.col("id").alias("root"))
    last = seen.get["last"]
    return Merged(joined.unionByName(alone), found.where("phase > 0").select("phase", F.col("a").alias("lo"), F.col("b").alias("hi")), last + 1 if last else 0)


def phase_metrics(merged: Merged) -> DataFrame:
    """``phase, picked, components``: forest edges of each phase, and the components with neighbours that are left after it."""
    picked = merged.forest.groupBy("phase").agg(F.count("*").alias("picked"))
    joined = merged.forest.select(F.explode(F.array("lo", "hi")).alias("id")).distinct().count()
    later = picked.select(F.col("phase").alias("_p"), F.col("picked").alias("_n"))
    upto = picked.join(later, F.col("_p") <= F.col("phase")).groupBy("phase", "picked").agg(F.sum("_n").alias("_all"))
    return upto.select("phase", "picked", (F.lit(joined) - F.col("_all")).cast("long").alias("components"))


def merge(edges: DataFrame, local: int = LOCAL_EDGES) -> Merged:
    """Components of ``edges(u, v)`` with roots, forest and phases; ``comp`` is the least id of a component.

    Isolated vertices never enter the phases. Phases count one that finds nothing to merge at the
    end, and are 0 where no edge joins two vertices. Edges inside a component are dropped as soon as
    it has formed. At most ``local`` edges, counted first, are merged by one task.
    """
    spark, seen = edges.sparkSession, Observation()
    once = stage(oriented(edges).observe(seen, F.count("*").alias("n")), "edges")
    if seen.get["n"] <= local:
        return _merged_in_one(once, edges)
    live = stage(once.select(F.col("u").alias("lo"), F.col("v").alias("hi"), F.col("u").alias("clo"), F.col("v").alias("chi")), "live")
    drop(once)
    ids = stage(vertices(edges).select("id"), "vertices")
    labels = ids.select("id", F.col("id").alias("root"))
    forest = spark.createDataFrame([], "phase int, lo long, hi long")
    phases = 0
    for phase in range(1, MOST_PHASES + 1):
        least = stage(least_edges(live), "least")
        if least.isEmpty():
            phases = phase if phase > 1 else 0
            break
        roots = stage(_roots(least, local), "roots")
        forest = forest.unionByName(least.select(F.lit(phase).alias("phase"), "lo", "hi").distinct())
        to = roots.select(F.col("cu").alias("root"), F.col("root").alias("_new"))
        last = labels
        labels = stage(labels.join(to, "root", "left").select("id", F.coalesce("_new", "root").alias("root")), "labels")
        if phase > 1:
            drop(last)
        a, b = (roots.select(F.col("cu").alias(c), F.col("root").alias(f"_{c}")) for c in ("clo", "chi"))
        # an end whose component picked no edge keeps its label; edges with such ends are gone already
        old = live
        live = stage(live.join(a, "clo").join(b, "chi").where("_clo <> _chi").select("lo", "hi", F.col("_clo").alias("clo"), F.col("_chi").alias("chi")), "live")
        drop(old, roots)
    else:
        raise RuntimeError("phases did not end")
    comps = labels.groupBy("root").agg(F.min("id").alias("comp"))
    return Merged(labels.join(comps, "root").select("id", "comp", "root"), forest, phases)
