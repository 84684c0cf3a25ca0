"""Entropy balancing of sources to token targets, rounded into copies of documents."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from islet.storage import drop, stage

WORD = r"[^\x20\x09-\x0D]+"
#: Sources that the driver holds a row of, and rounds of Newton's method; beyond either, ``mix`` raises.
MOST_SOURCES, MOST_ROUNDS = 100_000, 100
#: Places of the order in which documents take their spare copy, and the part of it that one look settles, in bits.
PLACE_BITS, LOOK_BITS = 44, 11


def word_count(text: str = "text") -> Column:
    """Words of the whole text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[float], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Shares of all sizes by weight, none above ``most`` times its source's size; excess is shared again by weight."""
    left, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        for i in over or open_:
            out[i] = most * sizes[i] if over else unit * weights[i]
        if not over:
            break
        left, open_ = left - sum(out[i] for i in over), open_ - over
    return out


def _rate(most: float) -> Column:
    """Copies that a document of ``size`` words is due: tilted by its size, ``most`` at most."""
    return F.round(F.least(F.lit(float(most)), F.exp(F.least(F.lit(50.0), F.col("tilt") * F.col("size")))), 12)


def _balance(bins: DataFrame, sources: list, goal: list[float], most: float, close: float = 1e-9) -> list[float]:
    """The dual's multiplier of each source: Newton steps, each round one aggregation over the bins.

    The primal is the least relative entropy of document rates to 1 under one token constraint a
    source and rates of at most ``most``; rates are then min(most, exp(multiplier * size / mean)).
    A round takes Newton's step from both ends of a bracket around each root, and looks at points
    spread over the bracket as well, which shrinks at least to a fifth; so the rounds end.
    """
    spark, mean = bins.sparkSession, [s["words"] / s["docs"] if s["words"] else 1.0 for s in sources]
    bracket = [(-700.0 * m, math.log(most) * m / s["least"] if s["words"] else 0.0) for m, s in zip(mean, sources, strict=True)]
    at, tries = [0.0] * len(sources), {}
    for i, s in enumerate(sources):
        if s["words"] and goal[i] >= most * s["words"] * (1 - 1e-12):  # the target at the bound: every rate is at the bound
            at[i] = bracket[i][1]
        elif s["words"]:
            tries[i] = [0.0, *(x for k in range(-6, 6) for x in (2.0**k, -(2.0**k)))]
    for _ in range(MOST_ROUNDS):
        if not tries:
            return [a / m for a, m in zip(at, mean, strict=True)]
        state = spark.createDataFrame([(i, t, t / mean[i]) for i, own in sorted(tries.items()) for t in sorted(own) if bracket[i][0] <= t <= bracket[i][1]], "sid long, at double, tilt double")
        rate = F.least(F.lit(float(most)), F.exp(F.least(F.lit(50.0), F.col("tilt") * F.col("size"))))
        slope = F.when(rate < most, rate * F.col("size")).otherwise(0.0)
        sums = bins.join(F.broadcast(state), "sid").groupBy("sid", "at").agg(F.sum(F.col("n") * F.col("size") * rate).alias("g"), F.sum(F.col("n") * F.col("size") * slope).alias("h"))
        seen: dict[int, list] = {i: [] for i in tries}
        for r in sums.collect():
            seen[r["sid"]].append((r["at"], r["g"] - goal[r["sid"]], r["h"]))
        for i, own in seen.items():
            own.sort()
            best = min(own, key=lambda x: abs(x[1]))
            below, above = [x for x in own if x[1] <= 0], [x for x in own if x[1] > 0]
            low, high = max([bracket[i][0], *(x[0] for x in below)]), min([bracket[i][1], *(x[0] for x in above)])
            bracket[i], at[i] = (low, high), best[0]
            if abs(best[1]) <= close * max(goal[i], 1.0) or high - low <= 1e-15 * max(abs(high), abs(low)):
                del tries[i]
                continue
            newton = [x[0] - x[1] * mean[i] / x[2] for x in (*below[-1:], *above[:1]) if x[2] > 0]
            tries[i] = list({x for x in (*newton, *(low + (high - low) * k / 5 for k in range(1, 5))) if low < x < high})
            if not tries[i]:  # no number lies between
                del tries[i]
    raise RuntimeError("the multipliers did not settle")


def _rounded(most: float) -> dict[str, Column]:
    """``whole`` copies of a document, and its ``place`` among those that take one more (null: it can't)."""
    rate = _rate(most)
    whole = F.floor(rate)
    even = F.shiftrightunsigned("_hash", 11) / F.lit(float(1 << 53))
    place = F.floor((even - (rate - whole) + 1) * float(1 << (PLACE_BITS - 1))).cast("long")
    return {"rate": rate, "whole": whole, "place": F.when((F.col("size") > 0) & (whole + 1 <= most), place)}


def _limits(light: DataFrame, names: DataFrame, most: float) -> DataFrame:
    """``names`` with ``limit``: documents of a source whose place is below it take one more copy.

    Places run from documents whose rate lacks little to the next whole number to those that lack
    much, in a hashed order, so every document keeps its rate on average. The words of a source come
    nearest to its target where the running sum over places crosses it. That place is found digit
    by digit: each look sums the words of all documents at the digits found so far by the next one,
    at most 2048 rows a source, so no documents are sorted.
    """
    spark = light.sparkSession
    placed = light.withColumnRenamed("_source", "_of").join(F.broadcast(names), F.col("_of").eqNullSafe(F.col("_source"))).withColumns(_rounded(most))
    placed = stage(placed.select("sid", "size", "whole", "place", "target"), "places")
    gaps = placed.groupBy("sid").agg((F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("gap"), F.sum(F.when(F.col("place").isNotNull(), F.col("size"))).alias("spare"))
    state = {r["sid"]: (0, r["gap"]) for r in gaps.collect() if r["spare"] and r["gap"] > 0}  # digits found, words still to add
    limits = {r: 0 for r in state}
    for bits in range(PLACE_BITS - LOOK_BITS, -1, -LOOK_BITS):
        if not state:
            break
        found = spark.createDataFrame([(i, at, float(gap)) for i, (at, gap) in sorted(state.items())], "sid long, at long, gap double")
        digit = F.shiftright("place", bits)
        inside = placed.where("place is not null").join(F.broadcast(found), "sid").where(F.shiftright(digit, LOOK_BITS) == F.col("at"))
        sums = inside.groupBy("sid", digit.alias("digit")).agg(F.sum("size").alias("words"), F.max("gap").alias("gap"))
        upto = F.sum("words").over(Window.partitionBy("sid").orderBy("digit"))
        crossed = sums.withColumn("upto", upto).where(F.col("upto") >= F.col("gap")).groupBy("sid").agg(F.min(F.struct("digit", "upto", "words", "gap")).alias("x")).select("sid", "x.*")
        rows = {r["sid"]: r for r in crossed.collect()}
        for i in list(state):
            if i not in rows:  # all of them are wanted: only at the first look
                limits[i] = 1 << PLACE_BITS
                del state[i]
                continue
            r = rows[i]
            left = r["gap"] - (r["upto"] - r["words"])
            if bits:
                state[i] = (r["digit"], left)
            else:  # the last place: with it or without, whatever comes nearer
                limits[i] = r["digit"] + (r["upto"] - r["gap"] <= left)
    drop(placed)
    return names.join(F.broadcast(spark.createDataFrame(sorted(limits.items()), "sid long, limit long")), "sid", "left").na.fill(0, ["limit"])


def mix(docs: DataFrame, carry: Sequence[str] = ("doc_id",), weights: Sequence[float] = (5, 2, 1), most: float = 3.0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The columns ``carry`` of every document with size, source_size, target, rate, copies and taken.

    ``size``: words of the whole text. Sources in code-point order, null last as a source of its
    own, weigh ``weights`` in turn; ``target``: see ``targets``. Rates come from ``_balance``; a
    document has as many copies as the whole number in its rate, and one more if ``_limits`` says
    so, which brings each source's words to its target within half of the document at the limit.
    ``taken`` = copies * size, and copies never exceed ``most``. Reruns agree, whatever the
    partitioning. ``docs`` is read twice and never moved: only sizes and hashes are written, only
    sums by source and size are shuffled.

    Null and empty texts have size 0 and one copy, which takes nothing. Rows of one doc_id are told
    apart by their text; equal rows have equal copies. Very long texts are counted whole. The driver
    holds a row a source and raises beyond ``MOST_SOURCES``. No rows: an empty table. ValueError if
    ``carry`` has a name of the added columns.
    """
    clash = {c.lower() for c in carry} & {"size", "source_size", "target", "rate", "copies", "taken"}
    if clash:
        raise ValueError(f"carried columns are named like added ones: {sorted(clash)}")
    spark = docs.sparkSession
    keys = F.xxhash64(F.lit("mix"), F.col(f"`{key}`"), F.col(f"`{text}`"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("_row"), F.col(f"`{source}`").cast("string").alias("_of"), word_count(f"`{text}`").alias("size"), keys.alias("_hash"))
    light = stage(rows.select(F.col("_of").alias("_source"), "size", "_hash"), "sizes")
    counted = stage(light.groupBy("_source", "size").agg(F.count("*").alias("n")), "bins")
    sources = counted.groupBy("_source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")).limit(MOST_SOURCES + 1).collect()
    if len(sources) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sources.sort(key=lambda s: (s["_source"] is None, (s["_source"] or "").encode()))
    goal = targets([s["words"] for s in sources], [weights[i % len(weights)] for i in range(len(sources))], most)
    ids = spark.createDataFrame([(i, s["_source"]) for i, s in enumerate(sources)], "sid long, _source string")
    bins = stage(counted.withColumnRenamed("_source", "_of").join(F.broadcast(ids), F.col("_of").eqNullSafe(F.col("_source"))).select("sid", "size", "n"), "source-bins")
    tilts = [float(f"{t:.13g}") for t in _balance(bins, sources, goal, most)]
    drop(counted, bins)
    names = spark.createDataFrame([(i, s["_source"], s["words"], g, t) for i, (s, g, t) in enumerate(zip(sources, goal, tilts, strict=True))], "sid long, _source string, source_size long, target double, tilt double")
    limits = _limits(light, names, most)
    drop(light)
    out = rows.join(F.broadcast(limits), F.col("_of").eqNullSafe(F.col("_source"))).withColumns(_rounded(most))
    copies = F.col("whole") + F.coalesce(F.col("place") < F.col("limit"), F.lit(False)).cast("long")
    return out.withColumn("copies", copies).select("_row.*", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The documents that ``mix`` takes, each as often as it has copies, with their own columns, whatever their names.

    Nulls, ties, repeated rows, long texts and empty tables: as in ``mix``.
    """
    columns = docs.columns
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_doc"), *(F.col(f"`{options.get(k, k)}`").alias(f"_{k}") for k in ("text", "source")), F.col(f"`{options.get('key', 'doc_id')}`").alias("_key"))
    options = {k: v for k, v in options.items() if k in ("weights", "most")}
    taken = mix(whole, ("_doc",), key="_key", text="_text", source="_source", **options)
    return taken.where("copies > 0").select("_doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("_doc.*")
