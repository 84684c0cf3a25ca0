"""Tables that outlive executors: intermediate results on storage that the whole cluster shares.

Iterative operators cut their lineage here. A staged table is ordinary Parquet below the folder
that ``spark.checkpoint.dir`` names, so losing any executor costs a reread and no recomputation.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a staged table that a task holds before it writes them.
ROW_GROUP = str(8 << 20)

_own: dict[str, str] = {}
_staged: dict[str, dict] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    On a cluster it is ``spark.checkpoint.dir``, and RuntimeError says so where that is unset. On one
    machine without it a temporary folder is made once per application.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="islet-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other table uses."""
    return f"{shared_dir(spark)}/islet-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, compression: str = "zstd", **options: str) -> DataFrame:
    """Write ``df`` below the shared folder and return it as read again.

    The files go once no plan reads them any more: the JVM's garbage collector is asked, by a weak
    reference to the table's file index, whenever something else is staged; ``drop`` and the end of
    the application don't wait for it.
    """
    spark = df.sparkSession
    sweep(spark)
    path = new_path(spark, name)
    df.write.options(**{"compression": compression, "parquet.block.size": ROW_GROUP, **options}).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    index = table._jdf.queryExecution().analyzed().relation().location()
    _staged.setdefault(spark.sparkContext.applicationId, {})[path] = spark.sparkContext._jvm.java.lang.ref.WeakReference(index)
    table._islet_path = path
    return table


def gather(tables: list[DataFrame]) -> DataFrame:
    """The rows of staged tables of one schema, as one scan of all their files, which go with its last reader."""
    first = tables[0]
    paths = [t._islet_path for t in tables]
    out = first.sparkSession.read.schema(first.schema).parquet(*paths)
    index = out._jdf.queryExecution().analyzed().relation().location()
    mine = _staged[first.sparkSession.sparkContext.applicationId]
    mine |= {p: first.sparkSession.sparkContext._jvm.java.lang.ref.WeakReference(index) for p in paths}
    return out


def sweep(spark: SparkSession) -> None:
    """Delete staged tables that no plan can read any more."""
    mine = _staged.get(spark.sparkContext.applicationId, {})
    for path in [p for p, index in mine.items() if index.get() is None]:
        del mine[path]
        drop_path(spark, path)


def drop(*tables: DataFrame) -> None:
    """Delete staged tables whose last reader has run."""
    for t in tables:
        _staged.get(t.sparkSession.sparkContext.applicationId, {}).pop(t._islet_path, None)
        drop_path(t.sparkSession, t._islet_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path on whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
