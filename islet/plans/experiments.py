"""Experiments: generate graphs of a sweep, run engines over partition counts, roll the summaries up."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from islet.operators import census, generators
from islet.storage import drop, stage

SAMPLERS = {"exact": generators.exact, "monte_carlo": generators.monte_carlo}


def run(spark: SparkSession, sweep: DataFrame, engines: Iterable[str] = ("stars",), partitions: Iterable[int] = (8,)) -> DataFrame:
    """Run summaries of every graph of ``sweep`` (see ``reports.sweep``), engine and number of partitions.

    The sweep is a short list of parameters and is walked on the driver; each run is distributed.
    """
    out = None
    for g in sweep.collect():
        graph = stage(SAMPLERS[g["sampler"]](spark, g["n"], g["p"], g["seed"]), "sweep")
        for engine in engines:
            for k in partitions:
                row = census.summary(graph.repartition(k), engine)
                row = row.withColumns({"k": F.lit(k), "engine": F.lit(engine), "regime": F.lit(g["regime"]), "sampler": F.lit(g["sampler"]), "trial": F.lit(g["trial"])})
                out = row if out is None else out.unionByName(row)
        drop(graph)
    if out is None:
        raise ValueError("the sweep is empty")
    return out


def write(summaries: DataFrame, path: str) -> None:
    """One folder an engine, sampler and regime; rows in the order of n and k."""
    summaries.repartition("engine", "sampler", "regime").sortWithinPartitions("n", "k").write.mode("overwrite").partitionBy("engine", "sampler", "regime").csv(path, header=True)


def rolled(spark: SparkSession, path: str, **of: str) -> DataFrame:
    """Summaries below ``path`` of the given engine, sampler or regime; other folders are not read."""
    rows = spark.read.csv(path, header=True, inferSchema=True)
    for column, value in of.items():
        rows = rows.where(F.col(column) == value)
    return rows.orderBy("n", "k")
