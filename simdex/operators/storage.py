"""Tables written to the shared folder, and broadcasts behind a size check."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a vector table that may be sent to every executor (about 150 bytes each).
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where none is, one machine alone gets a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"simdex-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def store(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder and read it again."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/simdex-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted, are within ``limit``."""
    return F.broadcast(df) if df.count() <= limit else df


def spread(df: DataFrame, core_bytes: int = 4 << 20) -> DataFrame:
    """``df`` over all cores where its input is too small to have a task for each.

    A single small file has one row group, so one task would do all the work; by
    the optimiser's size estimate such inputs, and only those, are dealt out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * core_bytes else df


def dealt(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores or shuffle partitions.

    For the streamed side of a nested-loop join: few bytes, much work a row, which
    the coalescing of small shuffle partitions would put into one task.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
