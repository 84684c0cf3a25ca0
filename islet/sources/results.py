"""Result files: run summaries, component listings and their roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEARCH_COLUMNS = ("n", "k", "M", "r", "Tp", "Tc", "f", "cl", "cm", "cu", "cv")
MERGING_COLUMNS = ("n", "k", "M", "p", "r", "Tp", "Tc", "f", "cl", "cm", "cu", "cv")
_DOUBLES = ("cm", "cv")


def write_summary(summary: DataFrame, path: str) -> None:
    """The run's row with a header; ``p`` only where the engine has phases."""
    columns = MERGING_COLUMNS if summary.first()["p"] is not None else SEARCH_COLUMNS
    summary.select(*columns).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_listing(listing: DataFrame, path: str) -> None:
    """``iC, nC`` in the order of labels."""
    listing.orderBy("iC").write.mode("overwrite").csv(path, header=True)


def read_summaries(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Rows of summary files of either kind, with the ``file`` they come from; a missing ``p`` is null.

    ``pattern`` selects files by name and must match the whole name.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    numbers = lines.where(F.col("value").rlike(r"^[0-9]")).select("file", F.split("value", ",").alias("x")).where(F.size("x").isin(len(SEARCH_COLUMNS), len(MERGING_COLUMNS)))
    merged = F.size("x") == len(MERGING_COLUMNS)
    out = []
    for i, c in enumerate(MERGING_COLUMNS):
        at = F.get("x", F.lit(i))
        if c == "p":
            at = F.when(merged, at)
        elif i > 3:
            at = F.when(merged, at).otherwise(F.get("x", F.lit(i - 1)))
        kind = "double" if c in _DOUBLES else "long"
        out.append(at.try_cast("double").cast(kind).alias(c))
    return numbers.select("file", *out)


def first_lines(spark: SparkSession, path: str, many: int) -> DataFrame:
    """``file, line, value``: the first lines, counted from 1, of every file below ``path``.

    Only the first block of a file is looked at for lines, so ``many`` must be few.
    """
    rows = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_row"))
    first = Window.partitionBy("file").orderBy("_row")
    return rows.where("_at = 0").withColumn("line", F.row_number().over(first).cast("long")).where(F.col("line") <= many).select("file", "line", "value")


def roll_up(summaries: DataFrame) -> DataFrame:
    """Distinct rows in the order of n, then k, as numbers."""
    return summaries.select(*MERGING_COLUMNS).distinct().orderBy("n", "k", *MERGING_COLUMNS[2:])


def write_roll_up(summaries: DataFrame, path: str) -> None:
    """One sorted file."""
    roll_up(summaries).coalesce(1).sortWithinPartitions("n", "k").write.mode("overwrite").csv(path, header=True)
