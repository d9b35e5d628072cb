"""Choose documents so that each source fills its share of a token budget.

Documents are counted by exact token length. A source takes the same fraction of
every length, whole documents only, rounding losses carried on from length to
length; the last of its budget, four times its longest document's tokens, is met by
a bounded-knapsack dynamic programme over the documents left, as a bit set of
reachable sums. Within a length, documents are picked by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import map_arrow, materialize, maybe_broadcast
from .textcore import mix64


@dataclass(frozen=True)
class MixConfig:
    """``weights`` by source, all sources alike where None; ``budget`` in tokens, else ``fraction`` of the corpus.

    Documents of a source and length are drawn in bins of about ``bin`` by their hash,
    so that only a bin in which the quota ends is ranked.
    """

    weights: dict[str, float] | None = None
    budget: int | None = None
    fraction: float = 0.5
    tokenizer: str = tokens.BYTE_BPE
    bin: int = 1000
    seed: int = 5


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take.

    The sum is at most ``budget``, and all documents where they fit. Four times the
    longest length is held back from the proportional part, so that the programme
    always has that much to fit, and little more.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.zeros_like(counts)
    if budget <= 0:
        return take
    part, seen, taken = max(0, budget - 4 * int(lengths.max())), 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length, count = int(lengths[i]), int(counts[i])
        seen += length * count
        if length > 0:
            take[i] = min(count, (part * seen // total - taken) // length)
            taken += int(take[i]) * length
    return take + subset_sum(lengths, counts - take, budget - taken)


def subset_sum(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Counts within bounds whose total length is as near below ``budget`` as can be.

    Lengths come in the order of a hash, so that neither long nor short ones are
    preferred. Each sum keeps the step that first reached it, so a sum is traced
    back through steps that come ever earlier.
    """
    out = np.zeros(len(lengths), np.int64)
    full, seen, steps = (1 << (budget + 1)) - 1, 1, []
    by = np.zeros(budget + 1, np.int32)
    for i in np.argsort(mix64(np.asarray(lengths).astype(np.uint64)), kind="stable").tolist():
        length, left = int(lengths[i]), int(counts[i])
        if length <= 0 or length > budget:
            continue
        left, size = min(left, budget // length), 1
        while left > 0 and not seen >> budget & 1:
            k = min(size, left)
            fresh = (seen << (k * length)) & full & ~seen
            if fresh:
                steps.append((i, k))
                by[_bits(fresh)] = len(steps)
                seen |= fresh
            left -= k
            size *= 2
        if seen >> budget & 1:
            break
    best = seen.bit_length() - 1
    while best:
        i, k = steps[by[best] - 1]
        out[i] += k
        best -= k * int(lengths[i])
    return out


def _bits(x: int) -> np.ndarray:
    """Places of the set bits."""
    raw = np.frombuffer(x.to_bytes((x.bit_length() + 7) // 8, "little"), np.uint8)
    at = np.flatnonzero(raw)
    low, bit = np.nonzero(np.unpackbits(raw[at, None], axis=1, bitorder="little"))
    return at[low] * 8 + bit


def count_tokens(docs: DataFrame, cfg: MixConfig, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, n_tokens`` of every row; null and empty texts have 0."""
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    path = cfg.tokenizer

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        enc = tokens.byte_bpe(path)
        n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return map_arrow(src, run, "doc_id bigint, source string, n_tokens bigint")


def mix_sources(docs: DataFrame, cfg: MixConfig = MixConfig(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, n_tokens`` of the chosen documents.

    A source's budget is its share of the weights times the budget, rounded down;
    one that has fewer tokens gives all. Rows with a null source, with a null,
    empty or tokenless text, and sources without a weight are not chosen. Ties of
    the seeded hash go to the smaller id, nulls first; each of repeated rows is a
    document. An empty table gives no rows.
    """
    spark = docs.sparkSession
    counted = materialize(count_tokens(docs, cfg, id_col, text_col, source_col).where("n_tokens > 0 and source is not null"), "counted")
    hist = counted.groupBy("source", "n_tokens").agg(F.count("*").alias("n"))
    totals = hist.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("t"))
    whole = totals.agg(F.sum("t"), F.count("*")).first()
    budget = cfg.budget if cfg.budget is not None else int((whole[0] or 0) * cfg.fraction)
    if cfg.weights is None:
        goal = totals.select("source", F.floor(F.lit(float(budget)) / F.lit(max(1, whole[1]))).alias("goal"))
    else:
        weight = sum(w for w in cfg.weights.values() if w > 0) or 1.0
        rows = [(s, int(budget * w / weight)) for s, w in cfg.weights.items() if w > 0]
        goal = spark.createDataFrame(rows, "source string, goal bigint")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens")
        take = fit_budget(pdf["n_tokens"].to_numpy(), pdf["n"].to_numpy(), int(pdf["goal"].iloc[0]))
        return pd.DataFrame({"source": pdf["source"], "n_tokens": pdf["n_tokens"], "n": pdf["n"], "take": take})

    quota = hist.join(goal, "source").groupBy("source").applyInPandas(plan, "source string, n_tokens bigint, n bigint, take bigint").where("take > 0")
    quota = materialize(quota.withColumn("bins", F.ceil(F.col("n") / F.lit(cfg.bin))), "quota")
    return draw(counted, quota, cfg)


def draw(counted: DataFrame, quota: DataFrame, cfg: MixConfig) -> DataFrame:
    """The first ``take`` rows of each source and length in the order of a seeded hash.

    The hash deals the rows of a length to bins in its own order. Counts by bin
    say which bins go in whole; of the one in which the quota ends equal rows are
    counted together and the counts ranked.
    """
    group = ["source", "n_tokens"]
    rows = counted.join(maybe_broadcast(quota, quota.count()), group).withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), F.lit(cfg.seed)))
    rows = rows.withColumn("b", F.floor((F.shiftright("h", 11) / F.lit(float(1 << 53)) + 0.5) * F.col("bins")))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*group).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = rows.groupBy(*group, "b", "take").agg(F.count("*").alias("c")).withColumn("left", F.col("take") - before).where("left > 0")
    bins = materialize(bins.select(*group, "b", F.col("left").alias("room"), (F.col("c") <= F.col("left")).alias("whole")), "bins")
    placed = rows.select("doc_id", *group, "h", "b").join(maybe_broadcast(bins, bins.count()), [*group, "b"])
    same = placed.where("not whole").groupBy(*group, "b", "room", "h", "doc_id").agg(F.count("*").alias("c"))
    order = Window.partitionBy(*group, "b").orderBy("h", F.col("doc_id").asc_nulls_first())
    upto = F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0))
    same = same.withColumn("out", F.least("c", F.col("room") - upto + F.col("c"))).where("out > 0")
    ends = same.select("doc_id", *group, F.explode(F.sequence(F.lit(1), F.col("out"))).alias("copy")).drop("copy")
    return placed.where("whole").select("doc_id", *group).unionByName(ends)
