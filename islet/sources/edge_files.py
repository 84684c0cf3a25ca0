"""Edge lists on storage: text, the packed binary format, and listings."""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

LARGEST_ID, RECORD = 4294967295, 8


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``u, v`` of a text edge list: two unsigned numbers at the start of a line. Other lines are dropped."""
    return parse_lines(spark.read.text(path))


def parse_lines(lines: DataFrame) -> DataFrame:
    """``u, v`` of lines in the column ``value``; blanks before and anything after the numbers is allowed."""
    pattern = r"^\s*([0-9]+)\s+([0-9]+)"
    number = lambda k: F.regexp_extract("value", pattern, k).try_cast("decimal(38,0)")
    parsed = lines.where(F.col("value").rlike(pattern)).select(number(1).alias("u"), number(2).alias("v"))
    return parsed.where(f"u <= {LARGEST_ID} and v <= {LARGEST_ID}").select(F.col("u").cast("long"), F.col("v").cast("long"))


def write_text(edges: DataFrame, path: str) -> None:
    """One edge a line."""
    edges.select(F.concat_ws(" ", "u", "v").alias("value")).write.mode("overwrite").text(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """``u, v`` of packed files: little-endian pairs of unsigned 32-bit ids, without a header.

    Works on any file system that Spark reads. Whole files are the unit of work here; for single
    large files on a path that executors can open, the ``ecg`` source splits by ranges of bytes.
    A partial record at the end is ignored.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_unpacked, "u long, v long")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            raw = content.as_buffer() if content.is_valid else b""
            yield from _pairs(np.frombuffer(raw, "<u4", len(raw) // RECORD * 2))


def _pairs(ids: np.ndarray, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    pairs = ids.reshape(-1, 2)
    for at in range(0, len(pairs), most):
        part = pairs[at : at + most].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["u", "v"])


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    path: str
    records: int


def _local(path: str) -> str:
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"the ecg source opens files itself; use read_packed for {path}")
    return url.path


class PackedEdges(DataSource):
    """``spark.read.format("ecg")``: packed edge files, split by ranges of whole records.

    ``path`` is a file or a folder of ``.ecg`` files that driver and executors can open.
    ``split_bytes`` bounds a partition (32 MB). Writing adds one file a task.
    """

    @classmethod
    def name(cls) -> str:
        return "ecg"

    def schema(self) -> str:
        return "u long, v long"

    def reader(self, schema):
        return PackedReader(self.options)

    def writer(self, schema, overwrite):
        return PackedWriter(self.options, overwrite)


class PackedReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = _local(options["path"]), int(options.get("split_bytes", 32 << 20)) // RECORD * RECORD or RECORD

    def partitions(self):
        top = self.path
        names = sorted(os.path.join(top, f) for f in os.listdir(top) if f.endswith(".ecg")) if os.path.isdir(top) else [top]
        ranges = []
        for name in names:
            whole = os.path.getsize(name) // RECORD * RECORD
            ranges += [ByteRange(name, a, min(a + self.split, whole)) for a in range(0, whole, self.split)]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, partition):
        if partition.stop > partition.start:
            ids = np.fromfile(partition.path, "<u4", (partition.stop - partition.start) // 4, offset=partition.start)
            yield from _pairs(ids)


class PackedWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite):
        self.path, self.overwrite, self.job = _local(options["path"]), overwrite, uuid.uuid4().hex[:8]

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        context = TaskContext.get()
        name = os.path.join(self.path, f".part-{context.partitionId():05d}-{self.job}-{context.taskAttemptId()}.tmp")
        records = 0
        with open(name, "wb") as f:
            for batch in iterator:
                u, v = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in "uv")
                if len(u) and (min(u.min(), v.min()) < 0 or max(u.max(), v.max()) > LARGEST_ID):
                    raise ValueError("an id is outside 0 to 4294967295")
                f.write(np.stack([u, v], axis=1).astype("<u4").tobytes())
                records += len(u)
        return Written(name, records)

    def commit(self, messages) -> None:
        """Files appear only when every task has written; with overwrite, older ones go."""
        old = [f for f in os.listdir(self.path) if f.endswith(".ecg")] if self.overwrite and os.path.isdir(self.path) else []
        for f in old:
            os.remove(os.path.join(self.path, f))
        for m in messages:
            if m is not None:
                base = os.path.basename(m.path)[1:].rsplit("-", 1)[0]
                os.replace(m.path, os.path.join(self.path, f"{base}.ecg"))

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


def register(spark: SparkSession) -> None:
    """Make ``format("ecg")`` known to the session."""
    spark.dataSource.register(PackedEdges)


def pack_record(u: int, v: int) -> bytes:
    """The bytes of one edge."""
    return struct.pack("<II", u, v)


def write_adjacency(adjacency: DataFrame, path: str) -> None:
    """``id: n1 n2 ...`` a vertex and line."""
    line = F.concat(F.col("id"), F.lit(": "), F.array_join("neighbors", " "))
    adjacency.select(line.alias("value")).write.mode("overwrite").text(path)
