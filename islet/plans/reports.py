"""Reports over run summaries: scaling regressions, speed-ups and the generator's sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from islet.functions.scalars import REGIMES, regime_probability
from islet.storage import stage


def regressions(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least squares of ``y`` on ``x`` and of their logarithms, for each group: slope, intercept, r2 and log_ ones."""
    ln = lambda c: F.when(F.col(c) > 0, F.log(c))
    made = points.withColumns({"_x": F.col(x).cast("double"), "_y": F.col(y).cast("double"), "_lx": ln(x), "_ly": ln(y)})
    fit = lambda a, b, p: [F.regr_slope(a, b).alias(f"{p}slope"), F.regr_intercept(a, b).alias(f"{p}intercept"), F.regr_r2(a, b).alias(f"{p}r2")]
    return made.groupBy(*by).agg(F.count("*").alias("points"), *fit("_y", "_x", ""), *fit("_ly", "_lx", "log_"))


def speedups(summaries: DataFrame) -> DataFrame:
    """``n, k, Tc, speedup``: median search time and how many times faster than on the fewest partitions."""
    median = summaries.groupBy("n", "k").agg(F.median("Tc").alias("Tc"))
    return median.withColumn("speedup", F.first("Tc").over(Window.partitionBy("n").orderBy("k")) / F.col("Tc"))


def scatter(summaries: DataFrame, x: str, ys: tuple[str, ...]) -> DataFrame:
    """``x, y, of``: a point for each summary and each column of ``ys``."""
    points = F.explode(F.array(*(F.struct(F.col(y).cast("double").alias("y"), F.lit(y).alias("of")) for y in ys)))
    return summaries.select(F.col(x).alias("x"), points.alias("p")).select("x", "p.y", "p.of")


def running_moments(listing: DataFrame) -> DataFrame:
    """``iC, nC, mean, variance`` of the populations of all components up to each label."""
    # sums run inside ranges of labels, and over the ranges' totals, of which there are few
    n = F.col("nC").cast("decimal(38,0)")
    parted = listing.select("iC", "nC").repartitionByRange("iC").withColumn("_part", F.spark_partition_id())
    parted = stage(parted.select("iC", "nC", "_part", n.alias("s"), (n * n).cast("decimal(38,0)").alias("q")), "ranges")
    totals = parted.groupBy("_part").agg(F.count("*").alias("_m"), F.sum("s").alias("_s"), F.sum("q").alias("_q"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_m", "_s", "_q")))
    upto = Window.partitionBy("_part").orderBy("iC")
    sums = parted.withColumns({"m": F.row_number().over(upto), "s": F.sum("s").over(upto), "q": F.sum("q").over(upto)}).join(F.broadcast(totals), "_part")
    m, s, q = ((F.col(c) + F.col(f"_{c}")).cast(k) for c, k in (("m", "double"), ("s", "decimal(38,0)"), ("q", "decimal(38,0)")))
    mean = s.cast("double") / m
    # exact in decimals before the division, so that large populations cancel nothing
    spread = (q * m.cast("decimal(18,0)")).cast("decimal(38,0)") - (s * s).cast("decimal(38,0)")
    return sums.select("iC", "nC", mean.alias("mean"), (spread.cast("double") / (m * m)).alias("variance"))


def sweep(spark: SparkSession, exponents=range(10, 21), trials: int = 3, seed: int = 0) -> DataFrame:
    """``n, regime, p, sampler, trial, seed`` of a generator sweep."""
    rows = [
        (1 << e, g, regime_probability(g, 1 << e), s, t, seed + t)
        for e in exponents
        for g in REGIMES
        for s in ("exact", "monte_carlo")
        for t in range(1, trials + 1)
    ]
    return spark.createDataFrame(rows, "n long, regime string, p double, sampler string, trial int, seed long")
