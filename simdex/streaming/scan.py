"""Greedy deduplication of a stream: each micro-batch against the stored index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.encode import add_planes
from ..operators.dedup import scan
from ..operators.joins import vectors


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


def batch_step(index_path: str, result_path: str, key: str, text_col: str, threshold: float, lens: str = "dedup") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` body.

    Each batch writes its kept vectors and its decisions under its own number,
    overwriting what a failed attempt left, so a replay gives the same tables.
    Only the vectors of earlier batches are read.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = vectors(add_planes(batch.select(F.col(key), F.col(text_col)), text_col), key)
        stored = _read(spark, index_path)
        if stored is not None:
            stored = stored.where(F.col("batch") < number).drop("batch")
        found = scan(rows, "id", threshold, lens, index=stored, index_key="id")
        out = f"{result_path}/batch={number}"
        found.write.mode("overwrite").parquet(out)
        kept = spark.read.parquet(out).where("NOT is_duplicate").select("id")
        rows.join(kept, "id", "left_semi").write.mode("overwrite").parquet(f"{index_path}/batch={number}")

    return step


def stream_scan(stream: DataFrame, index_path: str, result_path: str, checkpoint: str, key: str = "id", text_col: str = "text", threshold: float = 0.7, lens: str = "dedup") -> DataStreamWriter:
    """The writer of a scan over a stream, ready to start."""
    step = batch_step(index_path, result_path, key, text_col, threshold, lens)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
