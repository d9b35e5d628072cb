"""Vectorised text kernels shared by the training-data operators.

Everything here works on the raw UTF-8 bytes of one Arrow batch with NumPy, so
no operator needs a Python loop per word.  A *word* is a maximal run of ASCII
letters, digits or non-ASCII bytes that are not Latin-1 or general punctuation
(U+0080..U+00BF without the three letters, U+2000..U+206F, U+3000..U+3002).
Folding lowers ASCII and Latin-1 letters in place, so byte offsets stay valid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)
_CHUNK_BYTES = 1 << 21

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True

_powers: dict[str, np.ndarray] = {}


def _power_table(kind: str, base: int, n: int) -> np.ndarray:
    table = _powers.get(kind)
    if table is None or len(table) < n:
        size = max(n, _CHUNK_BYTES + 1)
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        _powers[kind] = table
    return table[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def chunks(column: pa.Array, limit: int = _CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first_row, n_rows, bytes, offsets)``; a null text counts as empty.

    Rows are grouped so that a chunk holds about ``limit`` bytes; one longer
    text makes a chunk of its own and is never cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    arr = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if arr.null_count:
        arr = arr.fill_null(b"")
    n = len(arr)
    if n == 0:
        return
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64, count=n + 1, offset=arr.offset * 8)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end - start, data[offs[start] : offs[end]], offs[start : end + 1] - offs[start]
        start = end


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-case ASCII and Latin-1 letters, keeping the length."""
    out = _FOLD[data]
    if len(out) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] += 0x20
    return out


def word_mask(data: np.ndarray) -> np.ndarray:
    mask = _WORD[data]
    if len(data) > 1 and (data > 127).any():
        lead = data[:-1]
        nxt = data[1:]
        latin = (lead == 0xC2) & (nxt != 0xAA) & (nxt != 0xB5) & (nxt != 0xBA)
        mask[:-1][latin] = False
        mask[1:][latin] = False
        if len(data) > 2:
            third = data[2:]
            gen = (lead[:-1] == 0xE2) & ((nxt[:-1] == 0x80) | ((nxt[:-1] == 0x81) & (third <= 0xAF)))
            gen |= (lead[:-1] == 0xE3) & (nxt[:-1] == 0x80) & (third <= 0x82)
            for k in range(3):
                mask[k : len(data) - 2 + k][gen] = False
    return mask


@dataclass
class Words:
    """Word table of a chunk: byte spans, owning row and 64-bit hashes."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray
    folded: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Split a chunk into folded words and hash each of them."""
    n_rows = len(offsets) - 1
    folded = fold(data)
    mask = word_mask(data)
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    begin = mask.copy()
    begin[1:] &= ~mask[:-1] | first[1:-1]
    start = np.flatnonzero(begin)
    stop = mask.copy()
    if len(stop):
        stop[:-1] &= ~mask[1:] | first[1:-1]
    end = np.flatnonzero(stop) + 1
    bounds = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(n_rows), np.diff(bounds))
    return Words(start, end, row, _span_hashes(folded, start, end), bounds, folded)


def _span_hashes(folded: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of ascending spans, some 2 MB of text at a time."""
    out = np.empty(len(start), dtype=np.uint64)
    edges = np.flatnonzero(np.diff(start // _CHUNK_BYTES, prepend=-1, append=-1)) if len(start) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        s, e = start[a:b] - start[a], end[a:b] - start[a]
        part = folded[start[a] : end[b - 1]]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _power_table("fwd", _BASE, len(part)), out=total[1:])
        raw = (total[e] - total[s]) * _power_table("inv", _BASE_INV, len(part) + 1)[s]
        out[a:b] = mix64(raw + (e - s).astype(np.uint64) * _MULT)
    return out


def word_hash(word: str) -> int:
    """The hash that :func:`words` gives a single word."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(words(data, np.array([0, len(data)])).hash[0])


def ngram_hashes(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word n-grams and their row bounds.

    A row of 1..n-1 words has one gram, all its words; a row without words none.
    """
    count = np.diff(bounds)
    grams = np.maximum(count - n + 1, (count > 0).astype(count.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(grams)])
    if not len(hashes):
        return np.zeros(0, np.uint64), out_bounds
    row = np.repeat(np.arange(len(count)), grams)
    at = np.arange(out_bounds[-1]) - out_bounds[row] + bounds[row]
    last = bounds[row + 1] - 1
    acc = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        pos = at + k
        inside = pos <= last
        np.minimum(pos, last, out=pos)
        acc = (acc + np.where(inside, hashes[pos], np.uint64(k + 1))) * np.uint64(_BASE)
        acc ^= acc >> np.uint64(29)
    return mix64(acc), out_bounds


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
