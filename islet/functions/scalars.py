"""Scalar functions on vertices and edges."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the Mersenne prime of the universal hash.
PRIME = 2**61 - 1


def machine_hash(vertex: Column, a: int, b: int, machines: int) -> Column:
    """((a v + b) mod (2**61 - 1)) mod machines, without the overflow that 64 bits would have."""
    wide = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    if not (0 <= a < PRIME and 0 <= b < PRIME):
        raise ValueError("a and b must be below 2**61 - 1")
    # (a * v) can have 94 bits: split a so that no product passes 38 digits
    high, low = a >> 31, a & 0x7FFFFFFF
    v = vertex.cast("decimal(20,0)")
    prime = wide(PRIME)
    top = F.pmod((v * F.lit(str(high)).cast("decimal(10,0)")).cast("decimal(38,0)"), prime).cast("decimal(20,0)")
    shifted = F.pmod((top * F.lit(str(1 << 31)).cast("decimal(10,0)")).cast("decimal(38,0)"), prime)
    bottom = F.pmod((v * F.lit(str(low)).cast("decimal(10,0)")).cast("decimal(38,0)"), prime)
    total = F.pmod((shifted + bottom + wide(b)).cast("decimal(38,0)"), prime)
    return F.pmod(total, wide(machines)).cast("long")


#: How far from the thresholds the regimes lie.
EPSILON = 0.2
REGIMES = ("1-", "1", "1+", "L-", "L", "L+")


def regime_probability(regime: str, n: int) -> float:
    """Edge probability of a regime: 1/n or ln(n)/n, times 1, 0.8 or 1.2."""
    if regime not in REGIMES or n < 2:
        raise ValueError("unknown regime or n below 2")
    base = (math.log(n) if regime[0] == "L" else 1.0) / n
    return base * {"": 1.0, "-": 1 - EPSILON, "+": 1 + EPSILON}[regime[1:]]
