"""Second stage: a ternary projection of the 240 channels, learned by Hebbian counts.

Training is one distributed aggregate: each partition multiplies its channel
matrices and emits the 240 x 240 sums, which are added by cell. Models are small
and travel with the tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.encode import PLANES, fnv1a_64, planes_of, trits_of, widened
from ..sources import readers

DIM, K = 240, 3
_LCG_MUL, _LCG_ADD, _M64 = 6364136223846793005, 1442695040888963407, (1 << 64) - 1
#: All maps of {0,1,2} to itself: map ``e`` sends ``x`` to digit ``x`` of ``e`` in base 3.
ENDO = np.array([[e // 3**x % 3 for x in range(3)] for e in range(27)], np.uint8)
MODES = ("mod3", "sign", "sparse", "diagonal", "block")


def lcg(seed: int, n: int) -> np.ndarray:
    """The first ``n`` states after ``seed`` of a 64-bit linear congruence."""
    out = np.empty(n, np.uint64)
    x = seed & _M64
    for i in range(n):
        x = (x * _LCG_MUL + _LCG_ADD) & _M64
        out[i] = x
    return out


def random_projection(seed: int) -> np.ndarray:
    return ((lcg(seed, K * DIM * DIM) >> np.uint64(32)) % np.uint64(3)).astype(np.uint8).reshape(K, DIM, DIM)


def identity_projection() -> np.ndarray:
    return np.repeat(np.eye(DIM, dtype=np.uint8)[None], K, axis=0)


def random_blocks(seed: int, k: int = K) -> np.ndarray:
    return ((lcg(seed, k * 4 * 3600) >> np.uint64(32)) % np.uint64(3)).astype(np.uint8).reshape(k, 4, 60, 60)


def identity_blocks(k: int = K) -> np.ndarray:
    return np.tile(np.eye(60, dtype=np.uint8), (k, 4, 1, 1))


def majority(votes: list[np.ndarray]) -> np.ndarray:
    """Per channel the value of two of three votes, the first where all differ."""
    if len(votes) < 3:
        return votes[0]
    a, b, c = votes[:3]
    return np.where((b == c) & (a != b), b, a)


def _sign(x: np.ndarray) -> np.ndarray:
    return (np.sign(x) + 1).astype(np.uint8)


def project(x: np.ndarray, w: np.ndarray, mode: str = "mod3") -> np.ndarray:
    """Project rows of channels by ``w``: ``(K, 240, 240)``, blocks ``(K, 4, 60, 60)``."""
    x = np.atleast_2d(x)
    if mode == "block":
        parts = x.reshape(-1, 4, 60).astype(np.int32)
        return majority([(np.einsum("cij,ncj->nci", wk.astype(np.int32), parts) % 3).astype(np.uint8).reshape(-1, DIM) for wk in w])
    if mode == "diagonal":
        gate = majority([wk.diagonal() for wk in w])
        return np.where(gate == 2, x, np.where(gate == 1, (3 - x) % 3, 1)).astype(np.uint8)
    z = x.astype(np.int32)
    if mode == "mod3":
        return majority([(z @ wk.T.astype(np.int32) % 3).astype(np.uint8) for wk in w])
    if mode == "sign":
        return majority([_sign((z - 1) @ (wk.T.astype(np.int32) - 1)) for wk in w])
    if mode == "sparse":
        return majority([_sign((z - 1) @ np.array([0, -1, 1])[wk].T) for wk in w])
    raise ValueError(f"no projection {mode!r}; there are {', '.join(MODES)}")


@dataclass
class Cascade:
    """Cells that add a map of one channel to another, modulo 3."""

    endo: np.ndarray
    src: np.ndarray
    dst: np.ndarray

    def tick(self, x: np.ndarray) -> np.ndarray:
        out = x.astype(np.int32).T.copy()
        np.add.at(out, self.dst, ENDO[self.endo[:, None], x.T[self.src]])
        return (out % 3).astype(np.uint8).T


def topology(kind: str, cells: int, seed: int) -> Cascade:
    """``random``, ``layered`` or ``local`` wiring, drawn from the congruence."""
    stream = iter(lcg(seed, cells * 6).tolist())
    draw = lambda: next(stream)
    rows = []
    for k in range(cells):
        if kind == "random":
            rows.append(((draw() >> 32) % 27, (draw() >> 32) % DIM, (draw() >> 32) % DIM))
        elif kind == "layered":
            src, r = k % DIM, draw()
            dst = src if r >> 33 & 1 else (r >> 32) % DIM
            rows.append(((draw() >> 32) % 27, src, dst))
        elif kind == "local":
            chain, off = (draw() >> 32) % 4, (draw() >> 32) % 60
            r = draw()
            to, at = (chain, (r >> 32) % 60) if (r >> 33) % 4 < 3 else ((draw() >> 32) % 4, (draw() >> 32) % 60)
            rows.append(((draw() >> 32) % 27, chain * 60 + off, to * 60 + at))
        else:
            raise ValueError(f"no topology {kind!r}")
    cells_ = np.array(rows, np.int64).reshape(-1, 3)
    return Cascade(cells_[:, 0], cells_[:, 1], cells_[:, 2])


@dataclass
class Model:
    projection: np.ndarray = field(default_factory=identity_projection)
    mode: str = "mod3"
    cells: int = 0
    topology_seed: int = 0
    topology_kind: str = "random"
    stacked: bool = False
    identity: bool = False
    alpha: tuple[float, ...] | None = None

    @staticmethod
    def identical() -> Model:
        return Model(identity=True)

    @staticmethod
    def random(cells: int, seed: int) -> Model:
        return Model(random_projection(seed), cells=cells, topology_seed=seed ^ 0xDEADBEEFCAFEBABE)

    @staticmethod
    def blocks(weights: np.ndarray, cells: int = 0, seed: int = 0) -> Model:
        return Model(weights, "block", cells, seed)

    def encode(self, x: np.ndarray, depth: int = 0) -> np.ndarray:
        """Second-stage channels of rows of channels, after ``depth`` further steps."""
        if not 0 <= depth <= 64:
            raise ValueError("depth is 0 to 64")
        if self.identity:
            return np.atleast_2d(x)
        out = project(x, self.projection, self.mode)
        wired = topology(self.topology_kind, self.cells, self.topology_seed) if depth and not self.stacked and self.cells else None
        for _ in range(depth):
            if self.stacked:
                out = project(out, self.projection, self.mode)
            elif wired is not None:
                out = wired.tick(out)
        return out

    def gate_masks(self) -> tuple[int, ...]:
        """By chain: channels whose diagonal is not 0 in two of three copies."""
        live = sum((wk.diagonal() != 0).astype(int) for wk in self.projection) >= 2
        return tuple(int(sum(1 << i for i in range(60) if live[60 * c + i])) for c in range(4))

    def save(self, spark: SparkSession, path: str) -> None:
        """Weights as rows and the settings as JSON, in one Parquet table."""
        meta = json.dumps({k: v for k, v in self.__dict__.items() if k != "projection"} | {"shape": self.projection.shape})
        spark.createDataFrame([(meta, bytes(self.projection.tobytes()), f"{fnv1a_64(self.projection.tobytes()):016x}")], "meta string, weights binary, checksum string").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        row = spark.read.parquet(path).first()
        if f"{fnv1a_64(bytes(row.weights)):016x}" != row.checksum:
            raise ValueError(f"{path}: the checksum differs")
        meta = json.loads(row.meta)
        w = np.frombuffer(bytes(row.weights), np.uint8).reshape(meta.pop("shape")).copy()
        if w.max(initial=0) > 2:
            raise ValueError(f"{path}: a weight is not ternary")
        meta["alpha"] = tuple(meta["alpha"]) if meta["alpha"] else None
        return Model(w, **meta)


def _matrix(batch: pa.RecordBatch, at: list[int]) -> np.ndarray:
    return trits_of(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in at], axis=1))


def add_stage2(df: DataFrame, model: Model, depth: int = 0, suffix: str = "", out: str = "_s2") -> DataFrame:
    """``df`` with the planes of the second stage beside those of the first."""
    at = [df.columns.index(f"{p}{suffix}") for p in PLANES]
    names = [f"{p}{out}" for p in PLANES]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [planes_of(shared.value.encode(_matrix(batch.slice(s, 1024), at), depth)) for s in range(0, batch.num_rows, 1024)]
            made = np.concatenate(parts) if parts else np.zeros((0, 8), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(made[:, i]) for i in range(8))], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, widened(df, **{n: T.LongType() for n in names}))


def encode_depths(df: DataFrame, key: str, model: Model, depths: int) -> DataFrame:
    """``id, depth`` and the planes at every depth below ``depths``."""
    rows = [add_stage2(df, model, d).select(F.col(key).alias("id"), F.lit(d).alias("depth"), *(F.col(f"{p}_s2").alias(p) for p in PLANES)) for d in range(depths)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def gate_planes(model: Model, prefix: str = "") -> dict[str, Column]:
    """The diagonal projection on planes alone: kept, flipped and dead channels by mask."""
    gate = majority([wk.diagonal() for wk in model.projection])
    mask = lambda v, c: sum(1 << i for i in range(60) if gate[60 * c + i] == v)
    out = {}
    for c in range(4):
        p, q = f"{prefix}p{c}", f"{prefix}q{c}"
        out[f"p{c}"] = F.expr(f"({p} & {mask(2, c)}L) | ({q} & {mask(1, c)}L) | {mask(0, c)}L")
        out[f"q{c}"] = F.expr(f"({q} & {mask(2, c)}L) | ({p} & {mask(1, c)}L)")
    return out


@dataclass(frozen=True)
class HebbianConfig:
    """A pair pulls together above the threshold and apart at or below it."""

    threshold: float = 0.9
    weighted: bool = False
    positive_scale: float = 10.0
    negative_scale: float = 3.0
    density: float = 0.15


def signed_magnitude(similarity: Column, cfg: HebbianConfig) -> Column:
    """Signed weight of a training pair."""
    delta = similarity - cfg.threshold
    if not cfg.weighted:
        return F.when(delta > 0, 1).otherwise(-1)
    return F.when(delta > 0, 1 + F.floor(delta * cfg.positive_scale)).otherwise(-(1 + F.floor(-delta * cfg.negative_scale)))


def accumulate(pairs: DataFrame, weight: str, a: str = "", b: str = "_b", blocks: bool = False) -> DataFrame:
    """``i, j, counter``: sums of weight x (b_i - 1) x (a_j - 1); only within chains if ``blocks``."""
    left = [pairs.columns.index(f"{p}{a}") for p in PLANES]
    right = [pairs.columns.index(f"{p}{b}") for p in PLANES]
    at_w = pairs.columns.index(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((DIM, DIM))
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                w = part.column(at_w).to_numpy(zero_copy_only=False).astype(float)
                total += ((_matrix(part, right) - 1.0) * w[:, None]).T @ (_matrix(part, left) - 1.0)
        i, j = np.divmod(np.arange(DIM * DIM, dtype=np.int32), DIM)
        keep = i // 60 == j // 60 if blocks else np.ones(len(i), bool)
        yield pa.RecordBatch.from_arrays([pa.array(i[keep]), pa.array(j[keep]), pa.array(np.rint(total).astype(np.int64).ravel()[keep])], names=["i", "j", "counter"])

    rows = pairs.mapInArrow(run, "i int, j int, counter bigint")
    limit = (1 << 31) - 1
    return rows.groupBy("i", "j").agg(F.greatest(F.least(F.sum("counter"), F.lit(limit)), F.lit(-limit)).alias("counter"))


def accumulator_stats(acc: DataFrame) -> DataFrame:
    """One row: largest magnitude, and positive, negative, nil and saturated counters."""
    c = F.col("counter")
    return acc.agg(F.max(F.abs(c)).alias("max_abs"), F.count_if(c > 0).alias("positive"), F.count_if(c < 0).alias("negative"), F.count_if(c == 0).alias("zero"), F.count_if(F.abs(c) >= (1 << 31) - 1).alias("saturated"))


def auto_threshold(acc: DataFrame, density: float) -> DataFrame:
    """One row ``threshold``: the smallest at which no more than that share of counters exceeds it."""
    hist = acc.groupBy(F.abs("counter").alias("t")).agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    marks = hist.unionByName(hist.sparkSession.createDataFrame([(0, 0)], "t bigint, n bigint")).groupBy("t").agg(F.sum("n").alias("n"))
    exceed = marks.withColumn("over", F.coalesce(F.sum("n").over(above), F.lit(0)))
    total = hist.agg(F.floor(F.sum("n") * F.lit(density)).alias("most"))
    return exceed.crossJoin(total).where("over <= most").agg(F.min("t").alias("threshold"))


def freeze(acc: DataFrame, threshold: int | Column) -> DataFrame:
    """``i, j, weight``: 2 above the threshold, 1 below its negative, else 0."""
    t = F.lit(threshold) if isinstance(threshold, int) else threshold
    return acc.select("i", "j", F.when(F.col("counter") > t, 2).when(F.col("counter") < -t, 1).otherwise(0).alias("weight"))


def freeze_sparse(acc: DataFrame, top: int) -> DataFrame:
    """Only the ``top`` largest magnitudes of each row, ties to the smaller column."""
    order = Window.partitionBy("i").orderBy(F.desc(F.abs("counter")), "j")
    w = F.when(F.col("counter") > 0, 2).when(F.col("counter") < 0, 1).otherwise(0)
    return acc.withColumn("r", F.row_number().over(order)).select("i", "j", F.when(F.col("r") <= top, w).otherwise(0).alias("weight"))


def unfreeze(weights: DataFrame, scale: int) -> DataFrame:
    """Counters to start from: scale where the weight is 2, its negative where it is 1."""
    return weights.select("i", "j", (F.when(F.col("weight") == 2, scale).when(F.col("weight") == 1, -scale).otherwise(0)).cast("bigint").alias("counter"))


def save_accumulator(acc: DataFrame, path: str, cfg: HebbianConfig) -> None:
    """Counters with their training settings, to go on from later; readers see the old ones until the new are complete."""
    readers.save_index(acc.select("i", "j", "counter"), path, kind="accumulator", **cfg.__dict__)


def load_accumulator(spark: SparkSession, path: str) -> tuple[DataFrame, HebbianConfig]:
    """Stored counters and settings; an error where a cell lies outside, stands twice or beyond 32 bits, or the checksum differs."""
    acc, meta = readers.load_index(spark, path)
    if meta.pop("kind", None) != "accumulator":
        raise ValueError(f"{path}: no accumulator")
    outside = ~(F.col("i").between(0, DIM - 1) & F.col("j").between(0, DIM - 1) & F.col("counter").between(-(1 << 31) + 1, (1 << 31) - 1))
    bad, cells, distinct = acc.agg(F.count_if(F.coalesce(outside, F.lit(True))), F.count("*"), F.countDistinct("i", "j")).first()
    if bad or cells != distinct:
        raise ValueError(f"{path}: {bad} counters out of range, {cells - distinct} twice")
    return acc, HebbianConfig(**meta)


def freeze_stats(weights: DataFrame) -> DataFrame:
    w = F.col("weight")
    return weights.agg(F.count("*").alias("total"), F.count_if(w == 2).alias("positive"), F.count_if(w == 1).alias("negative"), F.avg((w != 0).cast("double")).alias("density"))


def to_model(weights: DataFrame, mode: str = "diagonal", cells: int = 0) -> Model:
    """Collect at most 57,600 weights into a model; all three copies are alike."""
    rows = weights.toPandas()
    w = np.zeros((DIM, DIM), np.uint8)
    w[rows["i"], rows["j"]] = rows["weight"]
    full = np.repeat(w[None], K, axis=0)
    if mode == "block":
        full = np.stack([[wk[60 * c : 60 * c + 60, 60 * c : 60 * c + 60] for c in range(4)] for wk in full])
    return Model(full, mode, cells, fnv1a_64(full.tobytes()))


def source_weight(df: DataFrame, weights: dict[str, float], key: str = "id", source: str = "source", magnitude: str = "magnitude", seed: int = 1) -> DataFrame:
    """Repeat a source's pairs by a weight of 1 or more, keep a share of them below 1."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
    w = F.coalesce(table[F.col(source)], F.lit(1.0)) if table is not None else F.lit(1.0)
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return df.where((w >= 1) | (draw < w)).withColumn(magnitude, F.col(magnitude) * F.greatest(F.floor(w), F.lit(1)))


def train(pairs: DataFrame, similarity: str, cfg: HebbianConfig = HebbianConfig(), mode: str = "diagonal", schedule: tuple[float, ...] | None = None, warm: DataFrame | None = None, rounds: int = 0) -> Model:
    """Accumulate over all epochs, freeze at the target density; ``rounds`` of re-encoding deepen it."""
    parts = warm
    for t in schedule or (cfg.threshold,):
        own = HebbianConfig(t, cfg.weighted, cfg.positive_scale, cfg.negative_scale, cfg.density)
        acc = accumulate(pairs.withColumn("__w", signed_magnitude(F.col(similarity), own)), "__w", blocks=mode == "block")
        parts = acc if parts is None else parts.unionByName(acc)
    total = parts.groupBy("i", "j").agg(F.sum("counter").alias("counter"))
    cut = int(auto_threshold(total, cfg.density).first()[0] or 0)
    model = to_model(freeze(total, cut), mode)
    for _ in range(rounds):
        deeper = add_stage2(add_stage2(pairs, model, 0, "", "_x"), model, 0, "_b", "_y")
        names = {f"{p}{s}": F.col(f"{p}{t}") for p in PLANES for s, t in (("", "_x"), ("_b", "_y"))}
        acc = accumulate(deeper.withColumns(names).withColumn("__w", signed_magnitude(F.col(similarity), cfg)), "__w", blocks=mode == "block")
        cut = int(auto_threshold(acc, cfg.density).first()[0] or 0)
        model = to_model(freeze(acc, cut), mode)
    return model


