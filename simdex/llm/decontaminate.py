"""Benchmark passages in training documents, by an FM-index per training shard.

Each task indexes all words of its rows as it reads them, so no text is
shuffled; a shard's distinct words are its alphabet, and rows are separated. The
benchmark's word n-grams are searched backward, located and merged into spans.
They are worked out by the cluster and taken to the tasks in blocks of bounded
size, one after the other.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import discard, filesystem, map_arrow, materialize, shared_dir
from .fmindex import FMIndex


@dataclass(frozen=True)
class LeakConfig:
    """``n`` words make a test phrase; an item of ``least``..n-1 words is one phrase, a shorter one none: such words are no sign of a leak.

    ``block`` phrases are in a task's memory at a time.
    """

    n: int = 8
    least: int = 5
    sample: int = 16
    block: int = 200_000


@dataclass
class Phrases:
    """Distinct test phrases as right-aligned word hashes, with the items that hold them."""

    patterns: np.ndarray
    lengths: np.ndarray
    items: np.ndarray
    bounds: np.ndarray


@dataclass
class Suite:
    """Blocks of phrases: one that is held, or files that are read one at a time."""

    held: Phrases | None = None
    paths: tuple[str, ...] = ()

    def __iter__(self) -> Iterator[Phrases]:
        if self.held is not None:
            yield self.held
        for path in self.paths:
            where, name = filesystem(path)
            with where.open_input_stream(name) as f:
                yield pickle.loads(f.read())


def _phrase_rows(cfg: LeakConfig):
    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, count, data, offs in tc.chunks(batch.column(1)):
            w = tc.words(data, offs)
            size = np.diff(w.bounds)
            take = np.where(size >= cfg.least, np.maximum(size - cfg.n + 1, 1), 0)
            row = np.repeat(np.arange(count), take)
            begin = w.bounds[row] + np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)
            length = np.minimum(cfg.n, w.bounds[row + 1] - begin)
            at = np.repeat(begin, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(tc.signed(w.hash[at])))
            yield pa.RecordBatch.from_arrays([lists, batch.column(0).take(pa.array(first + row))], names=["phrase", "item"])

    return rows


def phrase_table(benchmark: DataFrame, cfg: LeakConfig, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``phrase, items``: distinct phrases as word hashes, and the items that hold them, in order."""
    src = benchmark.select(F.col(item_id).cast("bigint").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null")
    rows = map_arrow(src, _phrase_rows(cfg), "phrase array<bigint>, item bigint")
    return rows.groupBy("phrase").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _block(rows: pa.Table, n: int) -> Phrases:
    phrase, items = rows.column("phrase").combine_chunks(), rows.column("items").combine_chunks()
    lengths = np.diff(phrase.offsets.to_numpy()).astype(np.int64)
    patterns = np.zeros((len(lengths), n), np.uint64)
    col = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    patterns[np.repeat(np.arange(len(lengths)), lengths), np.repeat(n - lengths, lengths) + col] = phrase.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return Phrases(patterns, lengths, items.flatten().to_numpy(zero_copy_only=False), (items.offsets.to_numpy() - items.offsets[0].as_py()).astype(np.int64))


def build_suite(benchmark: DataFrame, cfg: LeakConfig, item_id: str = "item_id", item_text: str = "text") -> Suite:
    """The benchmark's phrases in blocks of about ``cfg.block``, by a hash where they are more."""
    spark = benchmark.sparkSession
    found = materialize(phrase_table(benchmark, cfg, item_id, item_text), "phrases")
    count = found.count()
    if count <= cfg.block:
        suite = Suite(_block(found.toArrow(), cfg.n)) if count else Suite()
    else:
        blocks, folder, paths = -(-count // cfg.block), f"{shared_dir(spark).rstrip('/')}/phrases-{uuid.uuid4().hex}", []
        where, base = filesystem(folder)
        where.create_dir(base, recursive=True)
        for k in range(blocks):
            part = found.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == k).toArrow()
            if part.num_rows:
                with where.open_output_stream(f"{base}/{k}") as f:
                    f.write(pickle.dumps(_block(part, cfg.n)))
                paths.append(f"{folder}/{k}")
        suite = Suite(None, tuple(paths))
    discard(found)
    return suite


def shard_spans(suite: Suite, cfg: LeakConfig, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int, list[int]]]:
    """Merged spans of a shard: ``(row, begin byte, end byte, words, items)``."""
    w = tc.words(data, offs)
    if not len(w.start) or suite.held is None and not suite.paths:
        return []
    alphabet, symbol = np.unique(w.hash, return_inverse=True)
    token = np.arange(len(w.start)) + w.row
    seq = np.zeros(token[-1] + 2, np.int64)
    seq[token] = symbol + 1
    word = np.zeros(len(seq), np.int64)
    word[token] = np.arange(len(w.start))
    index = FMIndex(seq, cfg.sample)
    first, length, items = [], [], []
    for block in suite:
        at = np.minimum(np.searchsorted(alphabet, block.patterns), len(alphabet) - 1)
        unused = np.arange(cfg.n) < cfg.n - block.lengths[:, None]
        here = np.flatnonzero(((alphabet[at] == block.patterns) | unused).all(axis=1))
        if not len(here):
            continue
        lo, hi = index.search(np.where(unused[here], 0, at[here] + 1), block.lengths[here])
        hits = hi - lo
        if not hits.sum():
            continue
        which = np.repeat(here, hits)
        rows = np.repeat(lo - (np.cumsum(hits) - hits), hits) + np.arange(hits.sum())
        first.append(word[index.locate(rows)])
        length.append(block.lengths[which])
        items += [block.items[block.bounds[p] : block.bounds[p + 1]].tolist() for p in which.tolist()]
    return merge_spans(w, np.concatenate(first), np.concatenate(length), items) if first else []


def merge_spans(w: tc.Words, first: np.ndarray, length: np.ndarray, found: list[list[int]]) -> list[tuple[int, int, int, int, list[int]]]:
    """Union of overlapping or touching word spans within a row."""
    order = np.lexsort((length, first))
    out: list[tuple[int, int, int, int, list[int]]] = []
    cur: tuple[int, int, set[int]] | None = None

    def close() -> None:
        s, e, items = cur
        out.append((int(w.row[s]), int(w.start[s]), int(w.end[e - 1]), e - s, sorted(items)))

    for i in order.tolist():
        s, e, items = int(first[i]), int(first[i] + length[i]), found[i]
        if cur and s <= cur[1] and w.row[s] == w.row[cur[0]]:
            cur = (cur[0], max(cur[1], e), cur[2] | set(items))
        else:
            if cur:
                close()
            cur = (s, e, set(items))
    if cur:
        close()
    return out


#: Bytes of text in a shard; a longer text is a shard of its own.
_SHARD = 4 << 20


def find_leaks(docs: DataFrame, benchmark: DataFrame, cfg: LeakConfig = LeakConfig(), id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, begin_char, end_char, n_words, items`` of every leaked span.

    A span is a maximal union of overlapping or touching test phrases; characters
    count from 0, the end is exclusive; ``items`` are the benchmark items whose
    phrases it holds. Words are compared folded, without punctuation. Documents
    without a leak have no row. Null and empty texts hold none; repeated rows are
    reported each; a null id stays null; null items and items of fewer than
    ``cfg.least`` words are not searched; empty tables give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(build_suite(benchmark, cfg, item_id, item_text))
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at, out = [], {"begin_char": [], "end_char": [], "n_words": [], "items": []}
        for first, _, data, offs in tc.chunks(batch.column(1), _SHARD):
            found = shard_spans(shared.value, cfg, data, offs)
            chars = char_places(data) if found else None
            for row, b, e, n, items in found:
                base = chars[offs[row]]
                at.append(first + row)
                out["begin_char"].append(int(chars[b] - base))
                out["end_char"].append(int(chars[e] - base))
                out["n_words"].append(n)
                out["items"].append(items)
        if at:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), *(pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))))],
                names=["doc_id", *out],
            )

    return map_arrow(src, run, "doc_id bigint, begin_char bigint, end_char bigint, n_words int, items array<bigint>")


def char_places(data: np.ndarray) -> np.ndarray:
    """Characters before each byte of a chunk, and before its end."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def remove_leaks(docs: DataFrame, benchmark: DataFrame, cfg: LeakConfig = LeakConfig(), text_col: str = "text", chars_col: str = "n_chars", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the leaked spans, same columns.

    A text that holds a span loses it, and ``chars_col``, where there is one, is
    counted anew; a text of which no word is left goes. All other rows, null and
    empty texts included, are unchanged; repeated rows are treated alike; an empty
    table stays empty, and with an empty benchmark nothing changes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(build_suite(benchmark, cfg, item_id, item_text))
    at = docs.columns.index(text_col)
    chars = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cuts: dict[int, list[tuple[int, int]]] = {}
        texts: dict[int, str] = {}
        for first, _, data, offs in tc.chunks(batch.column(at), _SHARD):
            for row, b, e, _, _ in shard_spans(shared.value, cfg, data, offs):
                cuts.setdefault(first + row, []).append((b - int(offs[row]), e - int(offs[row])))
            for row in (r for r in cuts if first <= r < first + len(offs) - 1):
                texts[row] = _without(data[offs[row - first] : offs[row - first + 1]].tobytes(), cuts[row])
        yield replace_texts(batch, at, chars, texts)

    return map_arrow(docs, run, docs.schema)


def _without(text: bytes, spans: list[tuple[int, int]]) -> str:
    out, last = [], 0
    for b, e in sorted(spans):
        out.append(text[last:b])
        last = e
    out.append(text[last:])
    return b"".join(out).decode("utf-8")


def replace_texts(batch: pa.RecordBatch, at: int, chars: int | None, texts: dict[int, str]) -> pa.RecordBatch:
    """``batch`` with new texts in some rows; rows whose new text has no word go."""
    if not texts:
        return batch
    rows = sorted(texts)
    new = pa.array([texts[r] for r in rows], batch.column(at).type)
    pick = np.arange(batch.num_rows)
    pick[rows] = batch.num_rows + np.arange(len(rows))
    cols = list(batch.columns)
    cols[at] = pa.concat_arrays([cols[at], new]).take(pa.array(pick))
    if chars is not None:
        cols[chars] = pa.concat_arrays([cols[chars], pa.array([len(texts[r]) for r in rows], pa.int64()).cast(cols[chars].type)]).take(pa.array(pick))
    keep = np.ones(batch.num_rows, bool)
    for _, _, data, offs in tc.chunks(new.cast(pa.large_binary()), 1 << 62):
        keep[np.array(rows)[np.diff(tc.words(data, offs).bounds) == 0]] = False
    return pa.RecordBatch.from_arrays(cols, schema=batch.schema).filter(pa.array(keep))
