"""Seeded Erdős–Rényi random graphs G(n, p) as edge tables; each vertex also declares itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def declarations(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """A self-edge for each vertex from 0 to n - 1."""
    return spark.range(0, n, 1, partitions).select(F.col("id").alias("u"), F.col("id").alias("v"))


#: Edges that a block is expected to have. Blocks depend on n and p alone, so graphs don't depend on partitions.
PER_BLOCK = 1 << 17


def _blocks(spark: SparkSession, many: int, partitions: int | None) -> DataFrame:
    """Numbers of the blocks, dealt out over partitions."""
    return spark.range(0, many, 1, max(1, min(many, partitions or 4 * spark.sparkContext.defaultParallelism)))


def _rows(u: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"u": u.astype(np.int64), "v": v.astype(np.int64)})


def _subset(rng: np.random.Generator, size: int, many: int) -> np.ndarray:
    """``many`` of the numbers below ``size``, each subset with the same odds, sorted."""
    if many > size // 2:
        return np.setdiff1d(np.arange(size), _subset(rng, size, size - many), assume_unique=True)
    out = np.zeros(0, np.int64)
    while len(out) < many:
        out = np.union1d(out, rng.integers(0, size, many - len(out)))
    return out


def _pair(k: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pair u < v < n at each place of the list of all pairs, by u and then v."""
    place = k.astype(np.uint64)
    side = np.longdouble(2 * n - 1)
    u = np.floor((side - np.sqrt(np.maximum(side * side - 8 * place.astype(np.longdouble), 0))) / 2)
    u = np.clip(u, 0, n - 2).astype(np.uint64)

    def start(u: np.ndarray) -> np.ndarray:  # pairs before those of u: u (2n - u - 1) / 2, the even factor halved first
        other = np.uint64(2 * n - 1) - u
        even = u % np.uint64(2) == 0
        return np.where(even, u // np.uint64(2) * other, u * (other // np.uint64(2)))

    while (high := start(u) > place).any():
        u = u - high.astype(np.uint64)
    while (low := start(u + np.uint64(1)) <= place).any():
        u = u + low.astype(np.uint64)
    return u, u + np.uint64(1) + place - start(u)


def _exact(n: int, p: float, seed: int, block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number in batch["id"]:
                size = min(block, n * (n - 1) // 2 - int(number) * block)
                rng = np.random.default_rng([seed, int(number), 1])
                chosen = _subset(rng, size, size if p >= 1 else int(rng.binomial(size, p)))
                yield _rows(*_pair(chosen + int(number) * block, n))

    return run


def exact(spark: SparkSession, n: int, p: float, seed: int, partitions: int | None = None) -> DataFrame:
    """G(n, p): every pair is an edge with probability p.

    The list of all pairs is cut into blocks of ``PER_BLOCK / p``; a block draws how many of its
    pairs are edges and then which, so the work is the edges. The same n, p and seed give the same
    graph on any number of partitions.
    """
    _valid(n, p)
    own, pairs = declarations(spark, n, partitions), n * (n - 1) // 2
    if p == 0 or not pairs:
        return own
    block = pairs if p * pairs <= PER_BLOCK else max(1, int(PER_BLOCK / p))
    return own.unionByName(_blocks(spark, -(-pairs // block), partitions).mapInPandas(_exact(n, p, seed, block), "u long, v long"))


def _drawn(n: int, p: float, seed: int, distinct: bool, block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number in batch["id"]:
                us = np.arange(int(number) * block, min(n, (int(number) + 1) * block))
                left = n - 1 - us
                rng = np.random.default_rng([seed, int(number), 2])
                many = rng.binomial(left, p)
                if distinct:
                    for u, size, k in zip(us, left, many, strict=True):
                        if k:
                            step = _subset(rng, int(size), int(k))
                            yield _rows(np.full(len(step), u), u + 1 + step)
                    continue
                ends = np.cumsum(many)
                for at in range(0, int(ends[-1]), 8 * PER_BLOCK):  # one vertex may draw more than fits
                    row = np.searchsorted(ends, np.arange(at, min(at + 8 * PER_BLOCK, int(ends[-1]))), "right")
                    yield _rows(us[row], us[row] + 1 + (rng.random(len(row)) * left[row]).astype(np.int64))

    return run


def monte_carlo(spark: SparkSession, n: int, p: float, seed: int, partitions: int | None = None, distinct: bool = False) -> DataFrame:
    """Each vertex draws a binomial number of larger neighbours, then the neighbours with replacement.

    Fast and approximate: an edge may come twice, and p = 1 need not give the complete graph.
    ``distinct`` draws without replacement, which makes it G(n, p); the draws of one vertex are then
    held together. The same arguments give the same graph on any number of partitions.
    """
    _valid(n, p)
    own = declarations(spark, n, partitions)
    if not n:
        return own
    block = max(1, min(n, int(PER_BLOCK / max(p * n, 1.0))))
    return own.unionByName(_blocks(spark, -(-n // block), partitions).mapInPandas(_drawn(n, p, seed, distinct, block), "u long, v long"))


def _valid(n: int, p: float) -> None:
    if n < 0 or n > 1 << 32 or not 0 <= p <= 1:
        raise ValueError("n must be from 0 to 2**32, p from 0 to 1")
