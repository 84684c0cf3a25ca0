"""Component census and run summaries."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from islet.operators import components, merging, search
from islet.operators.edges import vertices
from islet.storage import stage

#: Fixed value: the least population that an empty graph reports.
NO_COMPONENT = 2147483648


def sizes(labels: DataFrame) -> DataFrame:
    """``iC, nC``: each component's label and population."""
    return labels.groupBy(F.col("comp").alias("iC")).agg(F.count("*").alias("nC"))


def stats(listing: DataFrame) -> DataFrame:
    """``n, f, cl, cm, cu, cv``: vertices, components, and least, mean, largest and population variance of ``nC``."""
    none = F.lit(0)
    return listing.agg(
        F.coalesce(F.sum("nC"), none).cast("long").alias("n"),
        F.count("*").alias("f"),
        F.coalesce(F.min("nC"), F.lit(NO_COMPONENT)).cast("long").alias("cl"),
        F.coalesce(F.avg("nC"), none).cast("double").alias("cm"),
        F.coalesce(F.max("nC"), none).cast("long").alias("cu"),
        F.coalesce(F.var_pop("nC"), none).cast("double").alias("cv"),
    )


def histogram(listing: DataFrame) -> DataFrame:
    """``nC, components``: components of each size."""
    return listing.groupBy("nC").agg(F.count("*").alias("components"))


def largest(listing: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest components; the smaller label first where sizes tie."""
    return listing.orderBy(F.desc("nC"), "iC").limit(k)


def summary(edges: DataFrame, engine: str = "stars") -> DataFrame:
    """One row ``n, k, M, p, r, Tp, Tc, f, cl, cm, cu, cv`` for a run over ``edges``.

    ``engine``: ``stars``, ``merging`` (p phases) or ``search`` (r rounds). ``k``: the edges' partitions.
    ``Tp`` and ``Tc``: nanoseconds to load and to search. ``M`` is a cost of message passing that
    this engine doesn't have, and is null, as are p and r where an engine has none.
    """
    spark: SparkSession = edges.sparkSession
    began = time.perf_counter_ns()
    loaded = stage(edges.select("u", "v"), "edges")
    partitions = loaded.rdd.getNumPartitions()
    ready = time.perf_counter_ns()
    p = r = None
    if engine == "merging":
        found = merging.merge(loaded)
        labels, p = found.labels, found.phases
    elif engine == "search":
        tree = search.levels(loaded)
        labels, r = tree.select("id", F.col("root").alias("comp")), search.rounds(tree).first()["r"]
    elif engine == "stars":
        labels = components.labels(loaded)
    else:
        raise ValueError("engine is stars, merging or search")
    row = stats(sizes(labels)).first()
    done = time.perf_counter_ns()
    schema = "n long, k int, M long, p long, r long, Tp long, Tc long, f long, cl long, cm double, cu long, cv double"
    return spark.createDataFrame([(row["n"], partitions, None, p, r, ready - began, done - ready, row["f"], row["cl"], row["cm"], row["cu"], row["cv"])], schema)


def checked(labels: DataFrame, edges: DataFrame) -> None:
    """Raise AssertionError unless ``labels`` is a labelling of ``edges`` by least ids."""
    tests: list[tuple[str, Callable[[], bool]]] = [
        ("each vertex once", lambda: labels.count() == vertices(edges).count() == labels.select("id").distinct().count()),
        ("ends of an edge agree", lambda: edges.join(labels.select(F.col("id").alias("u"), F.col("comp").alias("a")), "u").join(labels.select(F.col("id").alias("v"), F.col("comp").alias("b")), "v").where("a <> b").isEmpty()),
        ("labels are least ids", lambda: labels.groupBy("comp").agg(F.min("id").alias("m")).where("comp <> m").isEmpty()),
    ]
    for name, holds in tests:
        if not holds():
            raise AssertionError(name)
