"""Corpus-specific channel weights and weighted similarities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.encode import PLANES, trits_of, widened
from ..functions.lens import parse_lens


def document_frequency(df: DataFrame) -> DataFrame:
    """``channel, df, n``: rows in which each of the 240 channels is not zero, and rows in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(240, np.int64), 0
        for batch in batches:
            planes = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            for s in range(0, len(planes), 4096):
                total += (trits_of(planes[s : s + 4096]) > 0).sum(axis=0)
            n += len(planes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(240, dtype=np.int32)), pa.array(total), pa.array(np.full(240, n))], names=["channel", "df", "n"])

    rows = df.select(*PLANES).mapInArrow(run, "channel int, df bigint, n bigint")
    return rows.groupBy("channel").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Frequencies of two corpora as one."""
    return left.unionByName(right).groupBy("channel").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


def weights(freq: DataFrame) -> DataFrame:
    """``channel, df, n, weight``: log2(n / (1 + df)) over its maximum, 0.01 at least.

    All weights are 1 without rows or where no channel has a positive logarithm.
    """
    raw = F.when(F.col("n") > 0, F.log2(F.col("n") / (1 + F.col("df")))).otherwise(F.lit(0.0))
    top = F.max("raw").over(Window.partitionBy(F.lit(1)))
    scaled = F.when(F.col("top") <= 0, F.lit(1.0)).otherwise(F.greatest(F.col("raw") / F.col("top"), F.lit(0.01)))
    return freq.withColumn("raw", raw).withColumn("top", top).select("channel", "df", "n", scaled.alias("weight"))


def collect_weights(freq: DataFrame) -> np.ndarray:
    rows = weights(freq).select("channel", "weight").collect()
    out = np.ones(240)
    for r in rows:
        out[r.channel] = r.weight
    return out


def weighted_cosines(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted cosine of matching rows of two channel matrices."""
    num = (w * a * b).sum(axis=1)
    den = np.sqrt((w * a * a).sum(axis=1)) * np.sqrt((w * b * b).sum(axis=1))
    return np.where(den < 1e-12, 0.0, np.minimum(num / np.maximum(den, 1e-12), 1.0))


def score_pairs(df: DataFrame, w: np.ndarray, lens: str | tuple[float, ...] | None = None, a: str = "", b: str = "_b", name: str = "similarity") -> DataFrame:
    """``df`` with the weighted cosine of two vectors of each row.

    ``lens`` takes it per chain and averages; None takes it over all channels.
    """
    left = [df.columns.index(f"{p}{a}") for p in PLANES]
    right = [df.columns.index(f"{p}{b}") for p in PLANES]
    lw = parse_lens(lens) if lens is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            out = np.zeros(n)
            for s in range(0, n, 2048):
                part = batch.slice(s, 2048)
                x, y = (trits_of(np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in at], axis=1)).astype(float) for at in (left, right))
                if lw is None:
                    out[s : s + 2048] = weighted_cosines(x, y, w)
                else:
                    for c in range(4):
                        at = slice(60 * c, 60 * c + 60)
                        if lw[c] > 0:
                            out[s : s + 2048] += lw[c] * weighted_cosines(x[:, at], y[:, at], w[at])
                    out[s : s + 2048] /= sum(lw) or 1.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, name])

    return df.mapInArrow(run, widened(df, **{name: T.DoubleType()}))


def noise_floor(scored: DataFrame, freq: DataFrame, column: str = "similarity") -> DataFrame:
    """One row: smallest, mean and largest similarity, and the channels below weight 0.5."""
    low = weights(freq).agg(F.count_if(F.col("weight") < 0.5).alias("low_channels"))
    return scored.agg(F.min(column).alias("min_similarity"), F.avg(column).alias("mean_similarity"), F.max(column).alias("max_similarity")).crossJoin(low)
