"""Band routing: candidates share a bucket of a chain's hash, then are re-ranked."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.encode import FNV_PRIME, FNV_START, GOLDEN, PLANES, trits_of
from . import tiles
from .joins import best, nearest, score, vectors
from .storage import store

BUCKETS = 4096
BRUTE_FORCE_BELOW = 500
#: Recall mode: probed positions and candidate cap.
MODES = {"fast": ((0,), 200), "balanced": ((0, 15, 30), 500), "strict": ((0, 10, 20, 30, 45), 2000)}


def band_hash(trits: np.ndarray, probe: int | None = None) -> np.ndarray:
    """Buckets of the four chains of each row of 240 channels.

    ``probe`` adds 1, modulo 3, to that position of every chain first.
    """
    v = trits.reshape(-1, 4, 60).astype(np.uint32)
    if probe is not None:
        v = v.copy()
        v[:, :, probe] = (v[:, :, probe] + 1) % 3
    h = np.broadcast_to(np.array([FNV_START ^ (c * GOLDEN & 0xFFFFFFFF) for c in range(4)], np.uint32), v.shape[:2]).copy()
    for i in range(60):
        h = (h ^ v[:, :, i]) * np.uint32(FNV_PRIME)
    return h % BUCKETS


def band_keys(df: DataFrame, key: str, probes: tuple[int, ...] | None = None) -> DataFrame:
    """``id, band, bucket, probe``: probe 0 is the row's own bucket, 1.. the probed ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            trits = trits_of(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1))
            for k, p in enumerate((None, *(probes or ()))):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.repeat(np.arange(n), 4))), pa.array(np.tile(np.arange(4, dtype=np.int32), n)), pa.array(band_hash(trits, p).astype(np.int32).ravel()), pa.array(np.full(4 * n, k, np.int32))],
                    names=["id", "band", "bucket", "probe"],
                )

    src = df.select(F.col(key).cast("bigint").alias("id"), *PLANES)
    return src.mapInArrow(run, "id bigint, band int, bucket int, probe int")


def _lists(index: DataFrame, columns: list[str], at: int, most: int) -> DataFrame:
    """``key, id, buckets`` and planes: the first ``most`` rows of each bucket, with their buckets in all bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = band_hash(trits_of(_planes(batch, 1 + 8 * at, 8))).astype(np.int16)
            rows = pa.array(np.repeat(np.arange(n), 4))
            keys = own.astype(np.int32) + np.arange(4, dtype=np.int32) * BUCKETS
            cols = [pa.array(keys.ravel()), batch.column(0).take(rows), _packed(own).take(rows), *(c.take(rows) for c in batch.columns[1:])]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "id", "buckets", *columns])

    rows = index.mapInArrow(run, _shape("key int, id bigint, buckets binary", columns))
    place = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    return rows.withColumn("place", place).where(F.col("place") <= most).drop("place")


def _requests(df: DataFrame, columns: list[str], at: int, sizes: np.ndarray, probes: tuple[int, ...], enough: int, counted: bool) -> DataFrame:
    """``key, seq, n, id, buckets`` and planes: the buckets that each row has to look into, in order.

    Buckets of one band have no row in common, so a row is served where those of a
    band hold ``enough``. ``n``: what the bucket adds, known (if ``counted``) in the first band.
    """
    width = 1 + len(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            trits = trits_of(_planes(batch, 1 + 8 * at, 8))
            asked = np.stack([band_hash(trits, p) for p in (None, *probes)], axis=2).astype(np.int16)  # row, band, probe
            keys = asked.astype(np.int32) + np.arange(4, dtype=np.int32)[None, :, None] * BUCKETS
            size = sizes[keys]
            for p in range(1, width):
                size[:, :, p][(asked[:, :, p, None] == asked[:, :, :p]).any(2)] = 0  # looked into already
            held = np.cumsum(size, axis=2)
            served = (held >= enough).reshape(len(asked), -1)
            before = np.cumsum(served, axis=1) - served
            row, seq = np.nonzero((before == 0) & (size.reshape(len(asked), -1) > 0))
            n = size.reshape(len(asked), -1)[row, seq].astype(np.int64)
            pick = pa.array(row)
            cols = [pa.array(keys.reshape(len(asked), -1)[row, seq]), pa.array(seq.astype(np.int32)), pa.array(n, mask=(seq >= width) | (not counted))]
            cols += [batch.column(0).take(pick), _packed(asked).take(pick), *(c.take(pick) for c in batch.columns[1:])]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "seq", "n", "id", "buckets", *columns])

    return df.mapInArrow(run, _shape("key int, seq int, n bigint, id bigint, buckets binary", columns))


def _shape(head: str, columns: list[str]) -> str:
    return ", ".join([head, *(f"{c} bigint" for c in columns)])


def _planes(batch: pa.RecordBatch, start: int, width: int) -> np.ndarray:
    return np.stack([batch.column(start + k).to_numpy(zero_copy_only=False) for k in range(width)], axis=1)


def _packed(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x.reshape(len(x), -1))
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * 2), len(x), [None, pa.py_buffer(x.tobytes())])
    return raw.cast(pa.binary())


def _unpacked(col: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.int16).reshape(len(col), 4, width)


def _meet(lists: DataFrame, asked: DataFrame, columns: list[str], width: int, not_self: bool, what: str, schema: T.StructType | str, measure: tiles.Measure | None = None) -> DataFrame:
    """Every request with its bucket's rows: ``count`` those not looked at before, or give the taken ``pairs``, or those that may be the ``best``."""
    spark = lists.sparkSession
    head = ["key", "side", "seq", "take", "id", "buckets"]
    zero = F.lit(0)
    one = lists.select("key", zero.alias("side"), zero.alias("seq"), zero.cast("bigint").alias("take"), "id", "buckets", *(c if c in lists.columns else zero.cast("bigint").alias(c) for c in columns))
    two = asked.select("key", F.lit(1).alias("side"), "seq", F.col("take") if "take" in asked.columns else zero.cast("bigint").alias("take"), "id", "buckets", *columns)
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def meet(key: int, have: tiles.Side, own: np.ndarray, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, band = part.column(4).to_numpy(), key // BUCKETS
        looked = _unpacked(part.column(5), width)
        new = np.ones((len(ids), len(have)), bool)
        for b in range(band):
            for p in range(width):
                new &= own[None, :, b] != looked[:, b, p, None]
        if not_self:
            new &= ids[:, None] != have.ids[None, :]
        if what == "count":
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(new.sum(1)), *part.columns[4:]], names=["key", "seq", "n", "id", "buckets", *columns])
            return
        new &= np.cumsum(new, axis=1, dtype=np.int32) <= part.column(3).to_numpy()[:, None]
        if what == "pairs":
            i, j = np.nonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(have.ids[j])], names=["id", "ref_id"])
            return
        planes = _planes(part, len(head), len(columns))
        mine = tiles.Side(ids, planes, measure.matrix(planes))
        s = mine.rows @ have.rows.T
        s[~new] = -1
        yield from tiles.both(mine, have, *tiles.near_top(s, have))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, have, own = None, [], None, None
        for batch in batches:
            at = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                key, side = divmod(int(at[s]), 2)
                if key != now:
                    now, held, have = key, [], None
                if not side:
                    held.append(batch.slice(s, e - s))
                elif held:
                    if have is None:
                        ids = np.concatenate([b.column(4).to_numpy() for b in held])
                        own = np.concatenate([_unpacked(b.column(5), 1) for b in held])[:, :, 0]
                        planes = np.concatenate([_planes(b, len(head), len(columns)) for b in held]) if columns else np.zeros((len(ids), 0), np.int64)
                        have = tiles.Side(ids, planes, measure.matrix(planes) if measure else planes)
                    for k in range(s, e, 2048):
                        yield from meet(key, have, own, batch.slice(k, min(2048, e - k)))

    rows = one.unionByName(two).repartition(parts, "key").sortWithinPartitions("key", "side", "id")
    return rows.mapInArrow(run, schema)


@dataclass
class Routed:
    """Buckets' rows, and the requests with what each may still take of its bucket (``take``) and adds (``n``)."""

    lists: DataFrame
    asked: DataFrame
    columns: list[str]
    width: int
    not_self: bool

    def pairs(self) -> DataFrame:
        return _meet(self.lists.drop(*self.columns), self.asked.drop(*self.columns), [], self.width, self.not_self, "pairs", "id bigint, ref_id bigint")

    def likely_best(self, measure: tiles.Measure) -> DataFrame:
        """``a, b``: of each request the candidates that may be its most similar."""
        found = _meet(self.lists, self.asked, self.columns, self.width, self.not_self, "best", tiles.both_schema(T.LongType(), T.LongType(), measure), measure)
        return tiles.structs(found, measure)


def routed(df: DataFrame, key: str, index: DataFrame, index_key: str, mode: str = "balanced", not_self: bool = False, columns: tuple[str, ...] = PLANES, at: int = 0, carry: bool = True) -> Routed:
    """Candidates without a table of pairs: rows ask buckets, which hold their first rows only.

    They are ordered by band, probe and index key, each counted once, up to the
    mode's cap. A bucket's row was met before if its bucket in an earlier band is one
    that the asking row looked into, so each bucket counts for itself. At most
    ``cap`` of a bucket's keys have been counted in earlier buckets, so none beyond
    its first ``2 cap`` can be among a row's candidates, and none takes part. Keys of
    the index are unique. ``columns`` are planes; those from ``8 at`` route, and all
    are kept for comparison if ``carry``.
    """
    probes, cap = MODES[mode]
    cols, width = list(columns), 1 + len(probes)
    solid = lambda d, k: d.select(F.col(k).cast("bigint").alias("id"), *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in cols)).where("id is not null").distinct()
    lists = store(_lists(solid(index, index_key), cols, at, 2 * cap + not_self), "buckets")
    sizes = np.zeros(4 * BUCKETS, np.int64)
    for r in lists.groupBy("key").count().collect():
        sizes[r[0]] = r[1]
    asked = store(_requests(solid(df, key), cols, at, sizes, probes, cap + not_self, not not_self), "requests")
    if not carry:
        lists, asked, cols = lists.drop(*cols), asked.drop(*cols), []
    n = _meet(lists.drop(*cols), asked.where("n is null"), cols, width, not_self, "count", _shape("key int, seq int, n bigint, id bigint, buckets binary", cols))
    known = asked.where("n is not null")
    so_far = F.sum("n").over(Window.partitionBy("id", "buckets").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    taken = known.select(*n.columns).unionByName(n).withColumn("take", F.lit(cap) - F.coalesce(so_far, F.lit(0)))
    taken = taken.where("take > 0 AND n > 0").withColumn("n", F.least("n", "take"))
    return Routed(lists, taken, cols, width, not_self)


def candidates(df: DataFrame, key: str, index: DataFrame, index_key: str, mode: str = "balanced", not_self: bool = False) -> DataFrame:
    """``id, ref_id``: the first candidates of each row up to the mode's cap, in the order of :func:`routed`."""
    return routed(df, key, index, index_key, mode, not_self, carry=False).pairs()


def nearest_routed(df: DataFrame, key: str, index: DataFrame, index_key: str, lens: str | tuple[float, ...] = "dedup", mode: str = "balanced", calibrate: bool = False, not_self: bool = False) -> DataFrame:
    """``id, match_id, similarity``: the best candidate of each row that has one, compared where buckets are."""
    both = routed(df, key, index, index_key, mode, not_self).likely_best(tiles.Measure(lens, calibrate))
    return best(both.select(F.col("a.id").alias("id"), F.col("b.id").alias("ref_id"), F.expr(score(lens, calibrate)).alias("similarity")))


def rescored(pairs: DataFrame, df: DataFrame, key: str, index: DataFrame, index_key: str, expr: str) -> DataFrame:
    a, b = vectors(df, key).alias("a"), vectors(index, index_key).alias("b")
    both = pairs.alias("c").join(a, F.expr("a.id = c.id")).join(b, F.expr("b.id = c.ref_id"))
    return both.select(F.col("c.id").alias("id"), F.col("c.ref_id").alias("ref_id"), F.expr(expr).alias("similarity"))


def query(df: DataFrame, key: str, index: DataFrame, index_key: str, threshold: float, lens: str | tuple[float, ...] = "dedup", mode: str = "balanced", calibrate: bool = False) -> DataFrame:
    """``id, is_duplicate, match_id, similarity`` by routing; brute force for small indexes.

    A row without a candidate has no match and similarity 0.
    """
    if index.count() < BRUTE_FORCE_BELOW:
        return nearest(df, key, index, index_key, threshold, lens, calibrate)
    found = nearest_routed(df, key, index, index_key, lens, mode, calibrate)
    rows = df.select(F.col(key).alias("id")).join(found, "id", "left")
    sim = F.coalesce("similarity", F.lit(0.0))
    return rows.select("id", (sim >= threshold).alias("is_duplicate"), "match_id", sim.alias("similarity"))


def query_stats(df: DataFrame, key: str, index: DataFrame, index_key: str, mode: str = "balanced") -> DataFrame:
    """``id, candidates_checked, total_entries, candidate_ratio, speedup, recall_mode``."""
    total = index.count()
    counts = routed(df, key, index, index_key, mode, carry=False).asked.groupBy("id").agg(F.sum("n").alias("n"))
    rows = df.select(F.col(key).alias("id")).join(counts, "id", "left")
    n = F.coalesce("n", F.lit(0).cast("bigint")) if total >= BRUTE_FORCE_BELOW else F.lit(total).cast("bigint")
    return rows.select(
        "id", n.alias("candidates_checked"), F.lit(total).cast("bigint").alias("total_entries"),
        F.when(F.lit(total > 0), n / F.lit(max(1, total))).otherwise(0.0).alias("candidate_ratio"),
        F.when(n > 0, F.lit(float(total)) / n).otherwise(F.lit(float(total))).alias("speedup"), F.lit(mode).alias("recall_mode"),
    )


def bucket_sizes(df: DataFrame, key: str) -> DataFrame:
    """``band, bucket, size`` of the buckets in use."""
    return band_keys(df, key).groupBy("band", "bucket").agg(F.count("*").alias("size"))


def bucket_health(df: DataFrame, key: str) -> DataFrame:
    """Per band, over all 4,096 buckets: mean, largest, empty, percentiles, histogram."""
    spark = df.sparkSession
    grid = spark.range(4 * BUCKETS).select((F.col("id") / BUCKETS).cast("int").alias("band"), (F.col("id") % BUCKETS).cast("int").alias("bucket"))
    full = grid.join(bucket_sizes(df, key), ["band", "bucket"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    order = F.sort_array(F.collect_list("size"))
    within = lambda lo, hi: F.count_if(F.col("size").between(lo, hi))
    return full.groupBy("band").agg(
        F.avg("size").alias("mean_size"), F.max("size").alias("max_size"), F.count_if(F.col("size") == 0).alias("empty"),
        F.element_at(order, int(BUCKETS * 0.95) + 1).alias("p95"), F.element_at(order, int(BUCKETS * 0.99) + 1).alias("p99"),
        within(1, 1).alias("n1"), within(2, 3).alias("n2_3"), within(4, 7).alias("n4_7"), within(8, 15).alias("n8_15"), within(16, 1 << 40).alias("n16"),
    )


def global_stats(df: DataFrame, key: str, mode: str = "balanced") -> DataFrame:
    """One row: expected candidates from the mean occupied bucket, capped."""
    probes, cap = MODES[mode]
    sizes = bucket_sizes(df, key).agg(F.avg("size").alias("mean_occupied"), F.count("*").alias("occupied"))
    rows = df.agg(F.count("*").alias("total_entries")).crossJoin(sizes)
    want = F.least(F.coalesce("mean_occupied", F.lit(0.0)) * 4 * (1 + len(probes)), F.lit(float(cap)), F.col("total_entries").cast("double"))
    return rows.select("total_entries", "occupied", "mean_occupied", want.alias("expected_candidates"), F.lit(mode).alias("recall_mode"))


def recall(df: DataFrame, key: str, threshold: float, mode: str = "balanced", lens: str | tuple[float, ...] = "dedup") -> DataFrame:
    """One row: of the rows with another row at the threshold, how many routing flags."""
    brute = tiles.linked(df.select(F.col(key).alias("id"), *PLANES), tiles.Measure(lens), threshold)
    hit = nearest_routed(df, key, df, key, lens, mode, not_self=True).where(F.col("similarity") >= threshold).select("id")
    hit = store(hit, "routed")
    both = brute.join(hit.withColumn("hit", F.lit(True)), "id", "left")
    return both.agg(F.count("*").alias("brute_duplicates"), F.count_if(F.coalesce("hit", F.lit(False))).alias("routed_duplicates")).withColumn(
        "recall", F.when(F.col("brute_duplicates") > 0, F.col("routed_duplicates") / F.col("brute_duplicates")).otherwise(F.lit(1.0))
    )


def recall_report(index: DataFrame, index_key: str, asked: DataFrame, key: str, threshold: float, mode: str = "balanced", lens: str | tuple[float, ...] = "dedup") -> DataFrame:
    """One row: how routed queries compare with exhaustive ones.

    ``corpus_size, queries, recall_mode, brute_matches, routed_matches, recall,
    avg_candidates, overflow_rate`` (queries that fill the candidate cap),
    ``bucket_skew`` (largest bucket over the mean of all) and ``verdict``: PASS at a
    recall of 0.99 with overflow below 0.05, WARN at 0.95 or overflow below 0.1,
    else FAIL. Without a brute match recall is 1.
    """
    brute = nearest(asked, key, index, index_key, threshold, lens).select("id", F.col("is_duplicate").alias("brute"))
    routed = query(asked, key, index, index_key, threshold, lens, mode).select("id", F.col("is_duplicate").alias("routed"))
    checked = query_stats(asked, key, index, index_key, mode).select("id", "candidates_checked")
    rows = asked.select(F.col(key).alias("id")).join(brute, "id", "left").join(routed, "id", "left").join(checked, "id", "left")
    hit = F.coalesce("brute", F.lit(False))
    got = rows.agg(
        F.count("*").alias("queries"), F.count_if(hit).alias("brute_matches"), F.count_if(hit & F.coalesce("routed", F.lit(False))).alias("routed_matches"),
        F.avg("candidates_checked").alias("avg_candidates"), F.avg((F.col("candidates_checked") >= MODES[mode][1]).cast("double")).alias("overflow_rate"),
    )
    size = bucket_sizes(index, index_key).agg(F.max("size").alias("largest"))
    got = got.crossJoin(size).crossJoin(index.agg(F.count("*").alias("corpus_size")))
    recall_ = F.when(F.col("brute_matches") > 0, F.col("routed_matches") / F.col("brute_matches")).otherwise(1.0)
    skew = F.when(F.col("corpus_size") > 0, F.col("largest") / (F.col("corpus_size") / BUCKETS)).otherwise(1.0)
    verdict = F.when((F.col("recall") >= 0.99) & (F.col("overflow_rate") < 0.05), "PASS").when((F.col("recall") >= 0.95) | (F.col("overflow_rate") < 0.1), "WARN").otherwise("FAIL")
    return got.select("corpus_size", "queries", F.lit(mode).alias("recall_mode"), "brute_matches", "routed_matches", recall_.alias("recall"), "avg_candidates", "overflow_rate", skew.alias("bucket_skew")).withColumn("verdict", verdict)


def query_weighted(df: DataFrame, key: str, index: DataFrame, index_key: str, weights: np.ndarray, threshold: float, lens: str | tuple[float, ...] = "dedup", mode: str = "balanced") -> DataFrame:
    """``id, is_duplicate, match_id, similarity`` by routing, re-ranked with corpus weights; every entry is a candidate in small indexes."""
    from . import csidf

    left, right = vectors(df, key), vectors(index, index_key)
    if index.count() < BRUTE_FORCE_BELOW:
        both = left.alias("a").crossJoin(right.alias("b"))
    else:
        both = routed(df, key, index, index_key, mode).likely_best(tiles.Measure(lens, channels=tuple(map(float, weights))))
    both = both.select(F.col("a.id").alias("id"), *(F.col(f"a.{p}") for p in PLANES), F.col("b.id").alias("ref_id"), *(F.col(f"b.{p}").alias(f"{p}_b") for p in PLANES))
    top = best(csidf.score_pairs(both, weights, lens).select("id", "ref_id", "similarity"))
    rows = df.select(F.col(key).alias("id")).join(top, "id", "left")
    sim = F.coalesce("similarity", F.lit(0.0))
    return rows.select("id", (sim >= threshold).alias("is_duplicate"), "match_id", sim.alias("similarity"))
