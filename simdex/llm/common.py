"""Plumbing shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of 8..24 bytes that may be sent to every executor; larger sides are shuffled.
BROADCAST_ROWS = 2_000_000
#: Bytes and rows of an Arrow batch between the JVM and Python.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4000


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, one machine alone gets a local one; a cluster an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"simdex-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the stored table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/simdex-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._simdex_path = path
    _stored.append(path)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_simdex_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _stored:
        _stored.remove(path)


#: Paths of the tables of :func:`materialize` that are not deleted.
_stored: list[str] = []


def keep_only(df: DataFrame, since: int) -> DataFrame:
    """``df``, a stored table; all others stored since there were ``since`` are deleted."""
    for path in [p for p in _stored[since:] if p != df._simdex_path]:
        _delete(df.sparkSession, path)
    return df


def stored() -> int:
    """How many stored tables there are."""
    return len(_stored)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side whose counted rows fit, none beyond."""
    return F.broadcast(df) if rows <= limit else df


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of ``df``, in slices of at most :data:`BATCH_BYTES`.

    The session's Arrow batches are bounded by bytes as well as rows, so that a
    run of very long texts doesn't make a task outgrow its executor.
    """
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        for batch in batches:
            step = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))
            for s in range(0, batch.num_rows, step):
                yield from fn(batch.slice(s, step))
            pool.release_unused()

    return spread(df).mapInArrow(run, schema)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches, where the session's are larger or have no bound."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = str(spark.conf.get(key)).strip()
        if now.startswith("-") or not 0 < size(now) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, core_bytes: int = 4 << 20) -> DataFrame:
    """``df`` over all cores where its input, by estimate, is too small to have a task for each."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * core_bytes else df
