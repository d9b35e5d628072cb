"""All pairs of vectors, compared in tiles.

Rows are dealt into blocks and each pair of blocks is one tile, which a task reads
and compares by a matrix product in single precision. Every similarity here is a
scalar product of scaled channels that are not negative, so the product is within
``SLACK`` of the true value, relatively: what may reach a threshold, or a row's
maximum, goes on to the exact expression, and nothing else can. A tile's memory is
bounded by its two blocks and one strip of the product.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.encode import PLANES, trits_of
from ..functions.lens import STATIC_IDF, parse_lens

#: Bound of the relative error of a product of 960 terms in single precision.
SLACK = 7e-5
#: Rows of a block, and the most blocks a side is cut into (beyond which they get larger).
BLOCK, BLOCKS = 16384, 64
#: Cells of a strip of the product that is held at once.
STRIP = 1 << 23


@dataclass(frozen=True)
class Measure:
    """A lens (name, weights, ``flat`` or ``idf``), calibrated or not, of one vector or of weighted fields; ``channels`` weigh the channels of a lens."""

    lens: str | tuple[float, ...] = "dedup"
    calibrate: bool = False
    fields: tuple[float, ...] = (1.0,)
    suffixed: bool = False
    channels: tuple[float, ...] | None = None

    @property
    def columns(self) -> list[str]:
        return [f"{p}{s}" for s in self.suffixes for p in PLANES]

    @property
    def suffixes(self) -> list[str]:
        return [f"_{i}" for i in range(len(self.fields))] if self.suffixed else [""]

    def matrix(self, planes: np.ndarray) -> np.ndarray:
        """Rows whose scalar products are the similarities."""
        whole = sum(w for w in self.fields if w > 0) or 1.0
        parts = [self._one(planes[:, 8 * i : 8 * i + 8]) * np.float32(math.sqrt(w / whole)) for i, w in enumerate(self.fields) if w > 0]
        return np.concatenate(parts, axis=1) if parts else np.zeros((len(planes), 1), np.float32)

    def _one(self, planes: np.ndarray) -> np.ndarray:
        x = trits_of(planes).astype(np.float32)
        fill = np.maximum((x > 0).mean(1), 0.05)
        if self.lens in ("flat", "idf"):
            if self.lens == "idf":
                x *= np.sqrt(np.array(STATIC_IDF, np.float32))
            norm = np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))
            x = x / np.where(norm > 0, norm, 1)
        else:
            w = np.array(parse_lens(self.lens))
            if self.channels:
                x *= np.sqrt(np.array(self.channels, np.float32))
            x = x.reshape(-1, 4, 60)
            norm = np.sqrt((x.astype(np.float64) ** 2).sum(2, keepdims=True))
            x = (x * (np.sqrt(w / (w.sum() or 1.0))[:, None] / np.where(norm > 0, norm, 1))).reshape(-1, 240)
        return (x / np.sqrt(fill)[:, None] if self.calibrate else x).astype(np.float32)

    def exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The lens cosine of matching rows, in the order of operations of :mod:`simdex.functions.similarity`."""
        if self.lens in ("flat", "idf") or self.suffixed or self.channels:
            raise ValueError("only a lens is evaluated here")
        bits = lambda x: np.bitwise_count(x).astype(np.int64)
        live = [(w, c) for c, w in enumerate(parse_lens(self.lens)) if w > 0]
        total = None
        for w, c in live:
            pa_, qa, pb, qb = a[:, c], a[:, c + 4], b[:, c], b[:, c + 4]
            dot = bits(pa_ & pb) + 2 * (bits(pa_ & qb) + bits(qa & pb)) + 4 * bits(qa & qb)
            den = np.sqrt((bits(pa_) + 4 * bits(qa)).astype(float)) * np.sqrt((bits(pb) + 4 * bits(qb)).astype(float))
            part = w * np.where(den == 0, 0.0, np.minimum(dot / np.where(den == 0, 1.0, den), 1.0))
            total = part if total is None else total + part
        out = np.zeros(len(a)) if total is None else total / sum(w for w, _ in live)
        if self.calibrate:
            fill = lambda x: np.maximum(bits(x[:, :4] | x[:, 4:]).sum(1) / 240.0, 0.05)
            out = np.maximum(np.minimum(out / np.sqrt(fill(a) * fill(b)), 1.0), 0.0)
        return out

    def reach(self, s: np.ndarray, a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
        """Which cells of the product ``s`` of planes ``a`` and ``b`` are at the threshold, exactly."""
        out = s >= t
        i, j = np.nonzero(np.abs(s - np.float32(t)) <= SLACK * abs(t))
        for k in range(0, len(i), 1 << 18):
            x, y = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
            out[x, y] = self.exact(a[x], b[y]) >= t
        return out


@dataclass
class Side:
    """A block: keys, planes, and the scaled rows."""

    ids: np.ndarray
    planes: np.ndarray
    rows: np.ndarray

    @functools.cached_property
    def labels(self) -> np.ndarray:
        """A number for each distinct vector."""
        return np.unique(self.planes, axis=0, return_inverse=True)[1].ravel()

    def __len__(self) -> int:
        return len(self.ids)


Kernel = Callable[[Side, Side, bool], Iterator[pa.RecordBatch]]


def _blocks(n: int, cores: int) -> int:
    return max(1, min(BLOCKS, max(-(-n // BLOCK), min(math.ceil(math.sqrt(4 * cores)), -(-n // 1024)))))


def _run(measure: Measure, kernel: Kernel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    width = len(measure.columns)

    def side(batches: list[pa.RecordBatch], which: int) -> Side:
        t = pa.Table.from_batches(batches)
        t = t.filter(pa.compute.equal(t.column("side"), which))
        planes = np.stack([t.column(2 + i).to_numpy() for i in range(1, width + 1)], axis=1).astype(np.int64, copy=False).reshape(-1, width)
        return Side(t.column("id").to_numpy(), planes, measure.matrix(planes))

    def tile(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = side(batches, 0), side(batches, 1)
        same = bool(batches[0].column("same")[0].as_py())
        if len(a) and (same or len(b)):
            yield from kernel(a, a if same else b, same)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            keys = batch.column("tile").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                if e == s:
                    continue
                if now is not None and keys[s] != now:
                    yield from tile(held)
                    held = []
                now = keys[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield from tile(held)

    return run


def _tiled(left: DataFrame, right: DataFrame | None, measure: Measure, kernel: Kernel, schema: T.StructType | str) -> DataFrame:
    """The kernel's rows over all tiles of ``left`` and ``right``, or of ``left`` and itself, each unordered pair once."""
    cores = left.sparkSession.sparkContext.defaultParallelism
    cols = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in measure.columns]
    left = left.where("id is not null").select("id", *cols)
    g = h = _blocks(left.count(), cores)
    part = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    others = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("o")
    if right is None:
        rows = left.withColumn("part", part(g)).select("*", others(g))
        rows = rows.select((F.least("part", "o") * g + F.greatest("part", "o")).alias("tile"), (F.col("part") > F.col("o")).cast("int").alias("side"), "id", *measure.columns, (F.col("part") == F.col("o")).alias("same"))
    else:
        right = right.where("id is not null").select("id", *cols)
        h = _blocks(right.count(), cores)
        one = left.withColumn("part", part(g)).select("*", others(h)).select((F.col("part") * h + F.col("o")).alias("tile"), F.lit(0).alias("side"), "id", *measure.columns, F.lit(False).alias("same"))
        two = right.withColumn("part", part(h)).select("*", others(g)).select((F.col("o") * h + F.col("part")).alias("tile"), F.lit(1).alias("side"), "id", *measure.columns, F.lit(False).alias("same"))
        rows = one.unionByName(two)
    tiles = g * (g + 1) // 2 if right is None else g * h
    return rows.repartition(tiles, "tile").sortWithinPartitions("tile", "side").mapInArrow(_run(measure, kernel), schema)


def _strips(a: Side, b: Side) -> Iterator[tuple[int, np.ndarray]]:
    step = max(16, STRIP // max(1, len(b)))
    for at in range(0, len(a), step):
        yield at, a.rows[at : at + step] @ b.rows.T


def both(a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
    width = a.planes.shape[1]
    names = ["a_id", *(f"a{k}" for k in range(width)), "b_id", *(f"b{k}" for k in range(width))]
    for s in range(0, len(i), 20_000):
        x, y = i[s : s + 20_000], j[s : s + 20_000]
        cols = [a.ids[x], *a.planes[x].T, b.ids[y], *b.planes[y].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=names)


def near_top(s: np.ndarray, b: Side, threshold: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of ``s`` that may be the largest of their row; columns are in key order, cells below 0 don't count."""
    top = s.max(1)
    least = top * (1 - 3 * SLACK)
    if threshold is not None:
        least = np.maximum(least, threshold * (1 - SLACK))
    none = top == 0  # no channel in common: all are equal, and the first has the smallest key
    least[none | (top < 0)] = np.inf
    i, j = np.nonzero(s >= least[:, None])
    if len(i) > 4 * len(s):
        keep = np.lexsort((j, b.labels[j], i))
        first = np.ones(len(keep), bool)
        first[1:] = (np.diff(i[keep]) != 0) | (np.diff(b.labels[j[keep]]) != 0)
        i, j = i[keep[first]], j[keep[first]]
    if threshold is None or threshold <= 0:
        z = np.flatnonzero(none)
        i, j = np.concatenate([i, z]), np.concatenate([j, (s[z] == 0).argmax(1)])
    return i, j


def _schema(left: DataFrame, right: DataFrame, measure: Measure) -> T.StructType:
    return both_schema(left.schema["id"].dataType, right.schema["id"].dataType, measure)


def both_schema(a_id: T.DataType, b_id: T.DataType, measure: Measure) -> T.StructType:
    n = len(measure.columns)
    field = lambda name, t: T.StructField(name, t)
    return T.StructType([
        field("a_id", a_id), *(field(f"a{k}", T.LongType()) for k in range(n)),
        field("b_id", b_id), *(field(f"b{k}", T.LongType()) for k in range(n)),
    ])


def structs(df: DataFrame, measure: Measure) -> DataFrame:
    """``a`` and ``b``, each with its id, planes and norms, for the expressions on pairs."""

    def one(x: str) -> Column:
        at = {c: f"{x}{k}" for k, c in enumerate(measure.columns)}
        norms = [F.expr(f"sqrt(cast(bit_count({at[f'p{c}{s}']}) + 4 * bit_count({at[f'q{c}{s}']}) as double))").alias(f"s{c}{s}") for s in measure.suffixes for c in range(4)]
        return F.struct(F.col(f"{x}_id").alias("id"), *(F.col(v).alias(c) for c, v in at.items()), *norms).alias(x)

    return df.select(one("a"), one("b"))


def likely_pairs(df: DataFrame, measure: Measure, threshold: float) -> DataFrame:
    """``a, b``: a superset of the unordered pairs at the threshold, for the exact expression to judge."""

    def kernel(a: Side, b: Side, same: bool) -> Iterator[pa.RecordBatch]:
        for at, s in _strips(a, b):
            i, j = np.nonzero(s >= threshold * (1 - SLACK) if threshold > 0 else s >= -1)
            i += at
            if same:
                i, j = i[i < j], j[i < j]
            yield from both(a, b, i, j)

    return structs(_tiled(df, None, measure, kernel, _schema(df, df, measure)), measure)


def likely_best(left: DataFrame, right: DataFrame, measure: Measure, which: str = "any", threshold: float | None = None) -> DataFrame:
    """``a, b``: of each left row and tile the right rows that may be its most similar.

    ``which``: ``any`` of them, one with another id (``other``) or a smaller one
    (``before``). With a threshold only those that may reach it. Of equal right
    vectors one, that of the smallest id, is enough.
    """

    def kernel(a: Side, b: Side, same: bool) -> Iterator[pa.RecordBatch]:
        order = np.argsort(b.ids, kind="stable")
        b = Side(b.ids[order], b.planes[order], b.rows[order])
        for at, s in _strips(a, b):
            ids = a.ids[at : at + len(s)]
            if which == "other":
                s[ids[:, None] == b.ids[None, :]] = -1
            elif which == "before":
                s[b.ids[None, :] >= ids[:, None]] = -1
            i, j = near_top(s, b, threshold)
            yield from both(a, b, i + at, j)

    return structs(_tiled(left, right, measure, kernel, _schema(left, right, measure)), measure)


def linked(df: DataFrame, measure: Measure, threshold: float) -> DataFrame:
    """``id`` of the rows that have another row at the threshold."""

    def kernel(a: Side, b: Side, same: bool) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros(len(a), bool), np.zeros(len(b), bool)
        for at, s in _strips(a, b):
            hit = measure.reach(s, a.planes[at : at + len(s)], b.planes, threshold)
            hit &= a.ids[at : at + len(s), None] != b.ids[None, :]
            left[at : at + len(s)] |= hit.any(1)
            right |= hit.any(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a.ids[left], b.ids[right]]))], names=["id"])

    return _tiled(df, None, measure, kernel, T.StructType([T.StructField("id", df.schema["id"].dataType)])).distinct()


def counts(df: DataFrame, measure: Measure, thresholds: list[float]) -> DataFrame:
    """``threshold, n``: how many unordered pairs of rows with different ids are at each threshold."""

    def kernel(a: Side, b: Side, same: bool) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(thresholds), np.int64)
        for at, s in _strips(a, b):
            ids = a.ids[at : at + len(s)]
            s[ids[:, None] >= b.ids[None, :] if same else ids[:, None] == b.ids[None, :]] = np.nan
            for k, t in enumerate(thresholds):
                n[k] += int(np.count_nonzero(measure.reach(s, a.planes[at : at + len(s)], b.planes, t)))
        yield pa.RecordBatch.from_arrays([pa.array(thresholds), pa.array(n)], names=["threshold", "n"])

    found = _tiled(df, None, measure, kernel, "threshold double, n bigint")
    grid = df.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    return grid.join(found.groupBy("threshold").agg(F.sum("n").alias("n")), "threshold", "left").select("threshold", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def unlike(planes: np.ndarray, kept: np.ndarray, measure: Measure, threshold: float) -> np.ndarray:
    """Which rows have no row of ``kept`` at the threshold."""
    left = np.arange(len(planes))
    rows = measure.matrix(planes)
    for at in range(0, len(kept), 4096):
        block = kept[at : at + 4096]
        other = measure.matrix(block)
        gone = []
        for s in range(0, len(left), 2048):
            mine = left[s : s + 2048]
            gone.append(measure.reach(rows[mine] @ other.T, planes[mine], block, threshold).any(1))
        if gone:
            left = left[~np.concatenate(gone)]
    out = np.zeros(len(planes), bool)
    out[left] = True
    return out


def greedy(planes: np.ndarray, measure: Measure, threshold: float) -> np.ndarray:
    """Which rows a scan in the given order keeps: those unlike every row kept before them."""
    kept = np.zeros(len(planes), bool)
    for at in range(0, len(planes), 2048):
        mine = at + np.flatnonzero(unlike(planes[at : at + 2048], planes[:at][kept[:at]], measure, threshold))
        rows = measure.matrix(planes[mine])
        near = measure.reach(rows @ rows.T, planes[mine], planes[mine], threshold)
        gone = np.zeros(len(mine), bool)
        for k in range(len(mine)):
            if not gone[k]:
                kept[mine[k]] = True
                gone |= near[k]
    return kept
