"""Word n-gram Jaccard self-join with Bayesian pruning of MinHash candidates.

Documents with the same n-gram set form a class that is compared once. Classes
meet in LSH bands; each candidate pair then compares further MinHash values a
few at a time and is dropped once the posterior probability that its Jaccard
similarity reaches the threshold falls below the tolerance. What survives is
verified exactly on the n-gram sets, in which each class is shipped to the tiles
that hold its surviving pairs: one for a common group, several for a very large one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import textcore as tc
from .common import discard, map_arrow, materialize, maybe_broadcast
from .components import connected_components


@dataclass(frozen=True)
class JaccardConfig:
    """``bands`` x ``rows`` values find candidates, ``compare`` further ones prune them.

    At similarity 0.5 a pair meets in some band with probability 0.92, at 0.6
    with 0.996; ``tolerance``, shared by the steps, bounds the posterior at which a pair is dropped.
    A band's bucket of more than ``bucket`` classes is compared in blocks by several
    tasks; a tile of verification holds about ``tile`` classes or ``tile_grams`` grams a side.
    """

    n: int = 3
    threshold: float = 0.5
    bands: int = 40
    rows: int = 4
    compare: int = 64
    step: int = 8
    tolerance: float = 0.01
    bucket: int = 1024
    tile: int = 4096
    tile_grams: int = 2_000_000
    seed: int = 7

    @property
    def size(self) -> int:
        return self.bands * self.rows + self.compare


def _multipliers(cfg: JaccardConfig) -> np.ndarray:
    rng = np.random.default_rng(cfg.seed)
    return rng.integers(1, 1 << 32, size=(cfg.size, 2), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def minhash(grams: np.ndarray, bounds: np.ndarray, cfg: JaccardConfig) -> np.ndarray:
    """MinHash values, one row per function, of the non-empty rows of a chunk."""
    filled = np.flatnonzero(np.diff(bounds))
    starts = bounds[filled]
    low = (grams >> np.uint64(32)).astype(np.uint32) ^ grams.astype(np.uint32)
    out = np.empty((cfg.size, len(filled)), dtype=np.uint32)
    for k, (mul, add) in enumerate(_multipliers(cfg)):
        v = (low ^ add) * mul
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        out[k] = np.minimum.reduceat(v, starts)
    return out


def compared_bytes(values: np.ndarray) -> np.ndarray:
    """The low byte of each MinHash value, a row per text.

    A minimum's high bytes tend to 0 as sets grow and agree whatever the
    similarity; its low byte stays uniform.
    """
    return np.ascontiguousarray(values.astype(np.uint8).T)


def minimum_matches(cfg: JaccardConfig) -> np.ndarray:
    """Fewest equal values after each step for which the posterior stays above the step's tolerance.

    Values are kept as one byte, so similarity ``s`` matches with probability
    ``s + (1 - s) / 256``; the prior on ``s`` is uniform. The steps share the
    tolerance evenly, as a pair that reaches the threshold is at risk in each.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    out = []
    for n in range(cfg.step, cfg.compare + 1, cfg.step):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        like = np.exp(log - log.max(axis=1, keepdims=True))
        above = like[:, s >= cfg.threshold].sum(axis=1) / like.sum(axis=1)
        out.append(int(np.argmax(above >= cfg.tolerance * cfg.step / cfg.compare)))
    return np.array(out)


def _set_rows(cfg: JaccardConfig):
    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0)
        for first, n, data, offs in tc.chunks(batch.column(1)):
            w = tc.words(data, offs)
            grams, bounds = tc.ngram_hashes(w.hash, w.bounds, cfg.n)
            filled = np.flatnonzero(np.diff(bounds))
            if not len(filled):
                continue
            sig = minhash(grams, bounds, cfg)
            fp = np.empty(len(filled), np.uint64)
            size = np.empty(len(filled), np.int32)
            for i, r in enumerate(filled):
                u = np.unique(grams[bounds[r] : bounds[r + 1]])
                fp[i] = _fingerprint(u)
                size[i] = len(u)
            cut = cfg.bands * cfg.rows
            keys = np.empty((len(filled), cfg.bands), np.uint64)
            for b in range(cfg.bands):
                acc = np.full(len(filled), b + 1, np.uint64)
                for r in range(cfg.rows):
                    acc = tc.mix64(acc ^ sig[b * cfg.rows + r]) + np.uint64(b)
                keys[:, b] = acc
            side = compared_bytes(sig[cut:])
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(first + filled)),
                    pa.array(tc.signed(fp)),
                    pa.array(size),
                    pa.Array.from_buffers(pa.binary(), len(filled), [None, pa.py_buffer((np.arange(len(filled) + 1) * cfg.compare).astype(np.int32)), pa.py_buffer(side)]),
                    pa.ListArray.from_arrays(pa.array((np.arange(len(filled) + 1) * cfg.bands).astype(np.int32)), pa.array(tc.signed(keys.reshape(-1)))),
                ],
                names=["doc_id", "fp", "size", "sig", "keys"],
            )

    return rows


def _fingerprint(unique_grams: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        total = unique_grams.sum(dtype=np.uint64)
        other = np.bitwise_xor.reduce(unique_grams * np.uint64(0xD6E8FEB86659FD93))
        return tc.mix64(np.array([total + np.uint64(len(unique_grams)) * np.uint64(0xA0761D6478BD642F)], np.uint64) ^ other)[0]


def set_classes(docs: DataFrame, cfg: JaccardConfig, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stored tables: one row per distinct n-gram set, ``fp, size, sig, keys``; and ``doc_id, fp`` of every document."""
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    sets = materialize(map_arrow(src, _set_rows(cfg), "doc_id bigint, fp bigint, size int, sig binary, keys array<bigint>"), "sets")
    members = materialize(sets.select("doc_id", "fp").distinct(), "members")
    classes = materialize(sets.groupBy("fp").agg(F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("keys").alias("keys")), "classes")
    discard(sets)
    return classes, members


def _emit_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within each run of equal keys, or between its sides 1 and 2; input is sorted by key and side."""
    keep = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)]

    def pairs(k: np.ndarray, v: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
        whole = side[edge[:-1]] == 0
        size = np.where(whole, np.diff(edge), 0)
        for m in np.unique(size[size > 1]):
            at = edge[:-1][size == m]
            if m <= 64:
                i, j = np.triu_indices(m, 1)
                step = max(1, 500_000 // len(i))
                for s in range(0, len(at), step):
                    grp = v[at[s : s + step, None] + np.arange(m)]
                    yield _batch(grp[:, i].ravel(), grp[:, j].ravel())
            else:
                for s in at:
                    yield from _rows_of(v[s : s + m], [v[s + i + 1 : s + m] for i in range(m)])
        for s, e in zip(edge[:-1][~whole], edge[1:][~whole]):
            cut = s + int(np.searchsorted(side[s:e], 2))
            yield from _rows_of(v[s:cut], [v[cut:e]] * (cut - s))

    for batch in batches:
        k, v, side = (np.concatenate([old, batch.column(c).to_numpy(zero_copy_only=False)]) for c, old in enumerate(keep))
        if not len(k):
            continue
        cut = int(np.searchsorted(k, k[-1], side="left"))
        if cut:
            yield from pairs(k[:cut], v[:cut], side[:cut])
        keep = [k[cut:], v[cut:], side[cut:]]
    if len(keep[0]):
        yield from pairs(*keep)


def _rows_of(left: np.ndarray, right: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Pairs of each left-hand class with its own right-hand ones, some 500,000 at a time."""
    pend, n = [], 0
    for i, r in enumerate(right):
        pend.append((np.full(len(r), left[i]), r))
        n += len(r)
        if n > 500_000 or i == len(right) - 1:
            if n:
                yield _batch(np.concatenate([x for x, _ in pend]), np.concatenate([y for _, y in pend]))
            pend, n = [], 0


def _batch(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def candidate_pairs(classes: DataFrame, cfg: JaccardConfig = JaccardConfig()) -> DataFrame:
    """Distinct pairs of classes that share a band.

    Buckets are counted first. One of more than ``cfg.bucket`` classes is dealt by
    a hash into blocks, and each pair of blocks is a task's run of its own.
    """
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = classes.select(F.explode("keys").alias("k"), "fp")
    big = materialize(rows.groupBy("k").count().where(F.col("count") > cfg.bucket).select("k", F.ceil(F.col("count") / F.lit(cfg.bucket)).cast("int").alias("m")), "buckets")
    dealt = rows.join(maybe_broadcast(big, big.count()), "k", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    run = F.when(F.col("m") == 1, F.col("k")).otherwise(F.xxhash64("k", F.least("block", "other"), F.greatest("block", "other")))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).cast("tinyint")
    dealt = dealt.select(run.alias("k"), "fp", side.alias("side"))
    found = dealt.repartition(parts, "k").sortWithinPartitions("k", "side").mapInArrow(_emit_pairs, "a bigint, b bigint")
    return found.dropDuplicates(["a", "b"])


def prune(pairs: DataFrame, classes: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """Pairs whose posterior stays above its share of the tolerance at every step."""
    floor, step = minimum_matches(cfg), cfg.step
    sig = classes.select("fp", "sig")
    both = pairs.join(sig.select(F.col("fp").alias("a"), F.col("sig").alias("sa")).hint("shuffle_hash"), "a")
    both = both.join(sig.select(F.col("fp").alias("b"), F.col("sig").alias("sb")).hint("shuffle_hash"), "b")

    def check(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x, y = _bytes(batch.column(2)), _bytes(batch.column(3))
        alive = np.arange(len(x))
        hits = np.zeros(len(x), np.int32)
        for k, need in enumerate(floor):
            part = slice(k * step, (k + 1) * step)
            hits = hits + (x[alive, part] == y[alive, part]).sum(axis=1, dtype=np.int32)
            ok = hits >= need
            alive, hits = alive[ok], hits[ok]
        at = pa.array(alive)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return map_arrow(both.select("a", "b", "sa", "sb"), check, "a bigint, b bigint")


def _bytes(col: pa.Array) -> np.ndarray:
    col = col.cast(pa.large_binary())
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    return np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]].reshape(len(col), -1)


def _gram_rows(n: int):
    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        want = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        for first, count, data, offs in tc.chunks(batch.column(2)):
            w = tc.words(data, offs)
            grams, bounds = tc.ngram_hashes(w.hash, w.bounds, n)
            at, sets = [], []
            for r in range(count):
                u = np.unique(grams[bounds[r] : bounds[r + 1]])
                if len(u) and _fingerprint(u) == want[first + r]:
                    at.append(first + r)
                    sets.append(u.tobytes())
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at)), pa.array(sets, pa.binary())], names=["fp", "grams"])

    return rows


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, ids, sets, pend = None, [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if ids and pend:
                yield from _exact(ids, sets, pend, threshold)

        for batch in batches:
            key = batch.column(0).to_pylist()
            kind = batch.column(1).to_numpy(zero_copy_only=False)
            a, b = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
            edges = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1] or kind[i] != kind[i - 1]), len(key)]
            for s, e in zip(edges[:-1], edges[1:]):
                if key[s] != tile:
                    yield from flush()
                    tile, ids, sets, pend = key[s], [], [], []
                if kind[s] == 0:
                    ids += a[s:e].tolist()
                    sets += [np.frombuffer(x.as_buffer(), np.uint64) if x.is_valid else np.zeros(0, np.uint64) for x in batch.column(4)[s:e]]
                else:
                    pend.append((a[s:e], b[s:e]))
        yield from flush()

    return run


def _exact(ids: list[int], sets: list[np.ndarray], pend: list, threshold: float) -> Iterator[pa.RecordBatch]:
    """Verify the pairs of one tile with a dense mark per left-hand set."""
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    known = np.array(ids, np.int64)[order]
    first = np.concatenate([[True], known[1:] != known[:-1]])
    order, known = order[first], known[first]
    size = np.array([len(sets[i]) for i in order])
    _, code = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(code.max() + 1, bool)
    a = np.searchsorted(known, np.concatenate([x for x, _ in pend]))
    b = np.searchsorted(known, np.concatenate([y for _, y in pend]))
    by = np.argsort(a, kind="stable")
    a, b = a[by], b[by]
    edge = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]]))
    out_a, out_b, out_j = [], [], []
    for s, e in zip(edge[:-1], edge[1:]):
        x = a[s]
        own = code[bounds[x] : bounds[x + 1]]
        mark[own] = True
        for t in range(s, e, 2048):
            ys = b[t : min(e, t + 2048)]
            at = np.concatenate([[0], np.cumsum(size[ys])])
            pos = np.arange(at[-1]) + np.repeat(bounds[ys] - at[:-1], size[ys])
            both = np.add.reduceat(mark[code[pos]], at[:-1], dtype=np.int64)
            sim = both / (size[x] + size[ys] - both)
            ok = sim >= threshold
            out_a.append(np.full(ok.sum(), x))
            out_b.append(ys[ok])
            out_j.append(sim[ok])
        mark[own] = False
    ja, jb, sim = np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_j)
    for s in range(0, len(ja), 20_000):
        p, q = ja[s : s + 20_000], jb[s : s + 20_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(known[p]), pa.array(known[q]), pa.array(sim[s : s + 20_000])],
            names=["a", "b", "jaccard"],
        )


def verify(survivors: DataFrame, classes: DataFrame, members: DataFrame, docs: DataFrame, cfg: JaccardConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact similarity of surviving pairs, stored: ``a, b, jaccard``."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    comps = materialize(connected_components(survivors), "groups")
    node = comps.join(classes.select(F.col("fp").alias("node"), "size"), "node")
    room = F.greatest(F.count("*") / F.lit(cfg.tile), F.sum(F.col("size").cast("bigint")) / F.lit(cfg.tile_grams))
    big = materialize(node.groupBy("comp").agg(F.ceil(room).cast("int").alias("m")).where("m > 1"), "tiles")
    node = node.join(maybe_broadcast(big, big.count()), "comp", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    node = node.withColumn("block", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    reps = members.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("rep"))
    node = materialize(node.join(reps, "node").select("node", "comp", "block", "rep"), "nodes")
    n_node = node.count()
    src = docs.select(F.col(id_col).cast("bigint").alias("rep"), F.col(text_col).cast("string").alias("text"))
    text = src.join(maybe_broadcast(node.select("rep", F.col("node").alias("fp")), n_node), "rep").select("rep", "fp", "text")
    grams = map_arrow(text, _gram_rows(cfg.n), "fp bigint, grams binary")
    side = node.select("node", "comp", "block")
    pairs = survivors.join(maybe_broadcast(side.select(F.col("node").alias("a"), "comp", F.col("block").alias("ba")), n_node), "a")
    pairs = pairs.join(maybe_broadcast(side.select(F.col("node").alias("b"), F.col("block").alias("bb")), n_node), "b")
    pairs = pairs.select(F.struct("comp", F.least("ba", "bb").alias("i"), F.greatest("ba", "bb").alias("j")).alias("tile"), "a", "b")
    place = pairs.select("tile", F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = place.join(grams.withColumnRenamed("fp", "node"), "node")
    sets = sets.select("tile", F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit(0).cast("bigint").alias("b"), "grams")
    rows = sets.unionByName(pairs.select("tile", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("grams")))
    rows = rows.repartition(parts, "tile").sortWithinPartitions("tile", "kind")
    found = materialize(rows.mapInArrow(_verify(cfg.threshold), "a bigint, b bigint, jaccard double"), "pairs")
    for done in (comps, big, node):
        discard(done)
    return found


def class_pairs(docs: DataFrame, cfg: JaccardConfig = JaccardConfig(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stored tables: ``doc_id, fp`` of every document, ``fp`` being its class; and the verified pairs of classes ``a, b, jaccard``."""
    classes, members = set_classes(docs, cfg, id_col, text_col)
    survivors = materialize(prune(candidate_pairs(classes, cfg), classes, cfg), "survivors")
    pairs = verify(survivors, classes, members, docs, cfg, id_col, text_col)
    discard(survivors)
    discard(classes)
    return members, pairs


def _grouped(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Stored ``fp, n, class_id``: how many documents a class has and the smallest id among all those linked to it, at any remove."""
    comps = connected_components(pairs.select("a", "b"))
    sizes = members.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    sizes = materialize(sizes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp")), "sizes")
    least = sizes.groupBy("comp").agg(F.min("least").alias("class_id"))
    return sizes.join(least, "comp").select("fp", "n", "class_id")


def ngram_jaccard_join(docs: DataFrame, cfg: JaccardConfig = JaccardConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near duplicates by word n-grams: ``doc_id, class_id, n_links`` of every document that has one.

    A document is linked to every other whose n-gram set has Jaccard >= threshold
    with its own; ``n_links`` counts them all, equal sets included. ``class_id`` is
    the smallest id among the documents that links connect it with. The links
    themselves, between sets instead of documents, are those of :func:`jaccard_links`.

    Null and empty texts, and texts without a word, have no n-grams and no links;
    rows with a null id are left out; a repeated row counts once, and an id with
    several texts has a row a set; a text shorter than n words is one gram. Other
    columns are not read. An empty table gives no rows. Search is approximate by
    ``cfg``, each link is verified exactly.
    """
    members, pairs = class_pairs(docs, cfg, id_col, text_col)
    classes = _grouped(members, pairs)
    ends = pairs.select(F.col("a").alias("fp"), F.col("b").alias("to")).unionByName(pairs.select(F.col("b").alias("fp"), F.col("a").alias("to")))
    links = ends.join(classes.select(F.col("fp").alias("to"), "n"), "to").groupBy("fp").agg(F.sum("n").alias("others"))
    classes = classes.join(links, "fp", "left").select("fp", "class_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")).where("n_links > 0")
    classes = materialize(classes, "linked")
    return members.join(maybe_broadcast(classes, classes.count()), "fp").select("doc_id", "class_id", "n_links")


def jaccard_links(docs: DataFrame, cfg: JaccardConfig = JaccardConfig(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``doc_a, doc_b, jaccard`` of linked n-gram sets, each named by its smallest document; and ``doc_id, set_id`` of every document.

    Two documents are linked where their sets are, or are the same. Odd rows as in :func:`ngram_jaccard_join`.
    """
    members, pairs = class_pairs(docs, cfg, id_col, text_col)
    names = materialize(members.groupBy("fp").agg(F.min("doc_id").alias("set_id")), "names")
    ends = names.select(F.col("fp").alias("a"), F.col("set_id").alias("doc_a")), names.select(F.col("fp").alias("b"), F.col("set_id").alias("doc_b"))
    links = pairs.join(ends[0], "a").join(ends[1], "b").select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "jaccard")
    return links, members.join(names, "fp").select("doc_id", "set_id")


def with_class(docs: DataFrame, column: str, cfg: JaccardConfig = JaccardConfig(), text_col: str = "text") -> DataFrame:
    """``docs`` with the class of each row's n-gram set in a further ``column``, null where it has none."""
    texts = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[int | None] = [None] * batch.num_rows
        for first, n, data, offs in tc.chunks(batch.column(texts)):
            w = tc.words(data, offs)
            grams, bounds = tc.ngram_hashes(w.hash, w.bounds, cfg.n)
            for r in range(n):
                u = np.unique(grams[bounds[r] : bounds[r + 1]])
                if len(u):
                    out[first + r] = int(_fingerprint(u).astype(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, column])

    return map_arrow(docs, run, StructType([*docs.schema.fields, StructField(column, LongType())]))


def near_duplicate_drops(docs: DataFrame, cfg: JaccardConfig = JaccardConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` of every document but the smallest of its duplicate group; ``fp`` is its class, as of :func:`with_class`."""
    members, pairs = class_pairs(docs, cfg, id_col, text_col)
    classes = _grouped(members, pairs)
    return members.join(classes, "fp").where("doc_id <> class_id").select("doc_id", "fp").distinct()
