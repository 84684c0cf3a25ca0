"""Token-id files: Parquet list columns in document order, with chosen encodings, row groups and page indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from islet.llm.batches import text_slices
from islet.llm.bpe import WORK_BYTES, Encoder


def _encoded(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            for part in text_slices(batch, "text", WORK_BYTES):
                ids, offsets = encoder.flat(part.column(1), end)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                sizes = pa.array(np.diff(offsets).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, lists], ["doc_id", "n_tokens", "ids"])

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end: int, encoding: str = "dictionary", row_group_mb: int = 32, page_rows: int = 2000) -> None:
    """Encode ``docs(doc_id, text)`` and write a folder of token files in ascending doc_id order.

    Rows are dealt out by ranges of doc_id before they are encoded, so texts are moved once and ids
    never. Each file has ``doc_id``, ``n_tokens`` and ``ids`` (every text's ids and ``end``).
    ``encoding``: ``dictionary`` (two bytes an id at most for 64k vocabularies, then zstd) or
    ``delta`` (delta binary packing). ``row_group_mb`` bounds what a reader holds; ``page_rows``
    rows have an entry each in the page index, by which a filter on doc_id skips pages.

    Null or empty text: the list holds ``end`` alone. Null doc_id: first. Rows of one doc_id are
    ordered by their text; equal rows are kept. Other columns are not read. No rows: an empty table.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tie = F.xxhash64("text")
    ordered = keyed.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    ids = ordered.mapInArrow(_encoded(tokenizer, end), "doc_id long, n_tokens int, ids array<int>")
    options = {
        "compression": "zstd",
        "parquet.compression.codec.zstd.level": "1",
        "parquet.block.size": str(row_group_mb << 20),
        "parquet.page.row.count.limit": str(page_rows),
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
    }
    ids.write.options(**options).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` and the place of each row: ``file``, ``row``. Columns not selected aren't read."""
    table = spark.read.schema("doc_id long, n_tokens int, ids array<int>").parquet(path)
    return table.select("doc_id", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        ids, ends = lists.values.to_numpy().astype("<u4", copy=False), lists.offsets.to_numpy()
        sums = [zlib.crc32(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64()), batch.column(3), batch.column(4)], ["doc_id", "n_tokens", "ids_crc32", "file", "row"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Files follow each other by the number in their names (which outgrows its five digits), then by
    name. Offsets of files come from the ``n_tokens`` column alone, one row a file; inside a file a
    running sum follows the row order.
    """
    rows = read(spark, path)
    whole = rows.groupBy("file").agg(F.sum("n_tokens").alias("ids_in_file"))
    number = F.regexp_extract("file", r"^part-(\d+)", 1).try_cast("long")
    whole = whole.select("file", (F.sum("ids_in_file").over(Window.orderBy(number, "file")) - F.col("ids_in_file")).alias("before_file"))
    each = rows.mapInArrow(_sums, "doc_id long, n_tokens long, ids_crc32 long, file string, row long")
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row")) - F.col("n_tokens")
    return each.withColumn("inside", inside).join(whole, "file").select("doc_id", (F.col("before_file") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
