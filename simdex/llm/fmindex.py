"""FM-index over a sequence of word symbols, all steps vectorised over many patterns."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank over an integer alphabet, one bit plane a level."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.levels = levels
        self.planes, self.counts, self.zeros = [], [], []
        cur = seq
        for level in range(levels - 1, -1, -1):
            bit = ((cur >> level) & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(64 + -len(bit) % 64, bool)]), bitorder="little").view(np.uint64)
            self.planes.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            cur = np.concatenate([cur[~bit], cur[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = self.planes[level][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.counts[level][word] + np.bitwise_count(low)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before position ``at``."""
        lo, hi = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            lo1, hi1 = self._ones(k, lo), self._ones(k, hi)
            lo = np.where(one, self.zeros[k] + lo1, lo - lo1)
            hi = np.where(one, self.zeros[k] + hi1, hi - hi1)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out, pos = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k in range(self.levels):
            one = (self.planes[k][pos >> 6] >> (pos & 63).astype(np.uint64)) & np.uint64(1) > 0
            ones = self._ones(k, pos)
            pos = np.where(one, self.zeros[k] + ones, pos - ones)
            out = (out << 1) | one
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix order; each 0 ends its suffixes and ranks by position among zeros.

    The last symbol must be 0. Prefix doubling, in which only suffixes that
    still tie and reach no 0 are sorted again.
    """
    n = len(seq)
    bits, sym = n.bit_length(), int(seq.max()).bit_length() or 1
    zero = np.flatnonzero(seq == 0)
    gap = zero[np.searchsorted(zero, np.arange(n))] - np.arange(n)
    width = max(1, min(8, (63 - bits) // sym))
    key = np.zeros(n, np.int64)
    for k in range(width):
        at = np.minimum(np.arange(n) + k, n - 1)
        key = (key << sym) | np.where(gap > k, seq[at], 0)
    packed = (key << bits) | np.arange(n)
    packed.sort()
    order = packed & ((1 << bits) - 1)
    head = np.concatenate([[True], (packed[1:] >> bits) != (packed[:-1] >> bits)])
    h = width
    while True:
        group = np.cumsum(head) - 1
        size = np.bincount(group)
        rank = np.empty(n, np.int64)
        rank[order] = np.flatnonzero(head)[group]
        settled = gap[order] < h
        rank[order[settled]] = np.flatnonzero(settled)
        slot = np.flatnonzero((size[group] > 1) & ~settled)
        if not len(slot):
            return order
        pos = order[slot]
        first, second = rank[pos], rank[np.minimum(pos + h, n - 1)]
        if 3 * bits <= 63:
            work = (first << (2 * bits)) | (second << bits) | pos
            work.sort()
            new = work & ((1 << bits) - 1)
            pair = work >> bits
        else:
            by = np.lexsort((pos, second, first))
            new = pos[by]
            pair = first[by] * n + second[by]
        order[slot] = new
        head[slot[1:]] |= pair[1:] != pair[:-1]
        h *= 2


class FMIndex:
    """Counts and locates symbol patterns in ``seq`` (0 separates; patterns hold none)."""

    def __init__(self, seq: np.ndarray, sample: int = 16):
        seq = np.asarray(seq, np.int64)
        if not len(seq) or seq[-1]:
            seq = np.append(seq, 0)
        order = suffix_array(seq)
        last = np.where(order > 0, seq[order - 1], 0)
        self.size = len(seq)
        counts = np.bincount(seq)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.wavelet = WaveletMatrix(last, max(1, int(seq.max()).bit_length()))
        keep = (last == 0) | (order % sample == 0)
        self.sampled = np.flatnonzero(keep)
        self.positions = order[keep]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of right-aligned patterns, by backward search."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        top = len(self.before) - 1
        for k in range(patterns.shape[1]):
            sym = patterns[:, patterns.shape[1] - 1 - k]
            live = np.flatnonzero((k < lengths) & (lo < hi))
            if not len(live):
                break
            gone = sym[live] >= top
            hi[live[gone]] = lo[live[gone]]
            live = live[~gone]
            c = sym[live]
            lo[live] = self.before[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.before[c] + self.wavelet.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to the nearest sampled one."""
        out = np.zeros(len(rows), np.int64)
        live, cur, steps = np.arange(len(rows)), np.asarray(rows, np.int64), 0
        while len(live):
            at = np.searchsorted(self.sampled, cur)
            hit = (at < len(self.sampled)) & (self.sampled[np.minimum(at, len(self.sampled) - 1)] == cur)
            out[live[hit]] = self.positions[at[hit]] + steps
            live, cur = live[~hit], cur[~hit]
            c = self.wavelet.access(cur)
            cur = self.before[c] + self.wavelet.rank(c, cur)
            steps += 1
        return out
