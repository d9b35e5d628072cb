"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize


def _local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its local component)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        nxt = label.copy()
        np.minimum.at(nxt, u, low)
        np.minimum.at(nxt, v, low)
        np.minimum.at(nxt, label[u], low)
        np.minimum.at(nxt, label[v], low)
        nxt = nxt[nxt]
        if np.array_equal(nxt, label):
            break
        label = nxt
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
        a, b = _local_forest(a, b)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])


#: Edges, 16 bytes each, that one task may hold.
ONE_TASK = 1_000_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """Return ``(node, comp)``, ``comp`` being the smallest node reachable.

    Edges with a null end and self-loops are ignored; repeated edges count once;
    an empty table gives an empty result. Each partition first reduces its edges
    to a spanning forest, so what follows works on about one edge a node. Counted
    edges up to ``one_task`` are then joined by one task; more go through rounds of
    star contractions, each written to the shared folder. The result is the same.
    """
    clean = edges.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v"))
    clean = clean.where("u is not null and v is not null and u <> v")
    cur = materialize(clean.mapInArrow(_contract, "u bigint, v bigint"), "edges")
    by_u = Window.partitionBy("u")
    seen = None
    few = cur.count() <= one_task
    if few:
        whole = materialize(cur.coalesce(1).mapInArrow(_contract, "u bigint, v bigint"), "edges")
        discard(cur)
        cur = whole
    while not few:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(by_u))).where("v > u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.withColumn("m", F.min("v").over(by_u))
        small = down.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        nxt = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        mark = nxt.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first()
        discard(cur)
        cur = nxt
        if mark == seen:
            break
        seen = mark
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)
