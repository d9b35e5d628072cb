"""Token-level assembly of conversations with loss masks.

Role and content are encoded separately as ordinary text, so nothing in them can
become a control token; the reserved ids are spliced in between. Control strings
that occur in content are escaped besides, so that a decoded conversation can be
parsed again. Masks come from prefix sums over the segment edges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import map_arrow


@dataclass(frozen=True)
class ChatConfig:
    """Reserved ids lie past the vocabulary; ``trained`` roles enter the loss."""

    tokenizer: str = tokens.BYTE_BPE
    start: int = 50257
    end: int = 50258
    stop: int = 50256
    trained: tuple[str, ...] = ("assistant",)


_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    r"""Add a backslash inside every ``<|``, ``<\|``, ``<\\|`` ...; :func:`unescape` reverses it."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def assemble(turns: list[tuple[str | None, str | None]], enc, cfg: ChatConfig) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one conversation of ``(role, text)`` turns.

    A turn is START role newline content END newline; STOP closes. The loss
    covers content and END of the trained roles.
    """
    newline = enc.encode_ordinary("\n")
    parts: list[list[int]] = []
    edges: list[tuple[int, int]] = []
    at = 0
    for role, text in turns:
        head = [cfg.start, *enc.encode_ordinary(escape(role or "unknown")), *newline]
        body = [*enc.encode_ordinary(escape(text or "")), cfg.end]
        if role in cfg.trained:
            edges.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, newline]
        at += len(head) + len(body) + len(newline)
    parts.append([cfg.stop])
    ids = np.fromiter((i for p in parts for i in p), np.int32, at + 1)
    delta = np.zeros(at + 2, np.int32)
    for b, e in edges:
        delta[b] += 1
        delta[e] -= 1
    return ids, np.cumsum(delta[:-1])


def disassemble(ids: list[int], enc, cfg: ChatConfig) -> list[tuple[str, str]]:
    """The turns that :func:`assemble` was given; null text comes back empty."""
    out, at = [], 0
    while ids[at] != cfg.stop:
        end = ids.index(cfg.end, at)
        role, _, text = enc.decode(ids[at + 1 : end]).partition("\n")
        out.append((unescape(role), unescape(text)))
        at = end + 2
    return out


def format_conversations(turns: DataFrame, cfg: ChatConfig = ChatConfig(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, n_turns, n_tokens, n_trained, input_ids, loss_mask``, a row a conversation.

    Turns go by number, then role and text, nulls first; repeated rows are turns
    of their own. A null text is empty content, a null role reads ``unknown`` and
    is not trained; rows without a conversation id are left out; an empty table
    gives no rows. A role keeps a line break only escaped, as a space.
    """
    src = turns.select(F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), F.regexp_replace(F.col(role).cast("string"), r"[\r\n]", " ").alias("role"), F.col(text).cast("string").alias("text"))
    grouped = src.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    flat = grouped.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        enc = tokens.byte_bpe(cfg.tokenizer)
        for s in range(0, batch.num_rows, 500):
            part = batch.slice(s, 500)
            made = [assemble(list(zip(r, t)), enc, cfg) for r, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(r) for r in part.column(1).to_pylist()], pa.int32()),
                    pa.array([len(i) for i, _ in made], pa.int32()),
                    pa.array([int(m.sum()) for _, m in made], pa.int32()),
                    pa.array([i for i, _ in made], pa.list_(pa.int32())),
                    pa.array([m for _, m in made], pa.list_(pa.int32())),
                ],
                names=["conv_id", "n_turns", "n_tokens", "n_trained", "input_ids", "loss_mask"],
            )

    return map_arrow(flat, run, "conv_id bigint, n_turns int, n_tokens int, n_trained int, input_ids array<int>, loss_mask array<int>")
