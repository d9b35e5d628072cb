"""Secret scan: sliding-window Shannon entropy of candidate strings.

A candidate is a maximal run of one character class. Windows slide over it one
character at a time; counts of the window's characters are updated by the one
that enters and the one that leaves, for all candidates of a batch at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import map_arrow
from .decontaminate import char_places, replace_texts


def _members(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_DIGIT, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class CharClass:
    """Runs of ``chars`` of ``least`` characters or more, with a window above ``bits``."""

    name: str
    chars: str
    least: int
    bits: float


CLASSES = (
    CharClass("hex", _DIGIT + "abcdefABCDEF", 24, 2.6),
    CharClass("base64", _DIGIT + _LOWER + _UPPER + "+/", 20, 3.6),
    CharClass("token", _DIGIT + _LOWER + _UPPER + "_-", 20, 3.6),
    CharClass("upper", _DIGIT + _UPPER, 20, 3.0),
    CharClass("assigned", _DIGIT + _LOWER + _UPPER + "+/_-", 10, 2.4),
)

#: The text before an ``assigned`` candidate: a telling name and a sign of assignment.
ASSIGNED = re.compile(r"(?i)(pass(word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\"']?\s{0,2}[=:]{1,2}\s{0,2}[\"']?$")

#: Candidates that match are no secrets: identifiers, placeholders and named digests.
ALLOW = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r".*(?i:example|placeholder|changeme|dummy|redacted|your[_-]?(api|secret|token|key)|xxxx).*",
    r"(.)\1*",
)
#: The same where the text before the candidate matches.
ALLOW_BEFORE = (r"(?i)\b(commit|sha-?1|sha-?256|sha-?512|md5|digest|checksum|etag|uuid|integrity|blob|tree)\b\W{0,4}$",)


@dataclass(frozen=True)
class SecretConfig:
    window: int = 20
    classes: tuple[CharClass, ...] = CLASSES
    allow: tuple[str, ...] = ALLOW
    allow_before: tuple[str, ...] = ALLOW_BEFORE
    context: int = 24
    mark: str = "[SECRET]"


#: Windows of a span that one row of the sliding table goes through.
_PIECE = 256


def window_entropy(data: np.ndarray, start: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """Largest entropy in bits over the windows of each span.

    A span shorter than the window is one window of its own length. Long spans are
    slid over in pieces side by side, which overlap so that no window is cut.
    """
    size = end - start
    pieces = np.maximum(1, -(-(size - window + 1) // _PIECE))
    span = np.repeat(np.arange(len(start)), pieces)
    skip = (np.arange(len(span)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * _PIECE
    begin, length = start[span] + skip, np.minimum(size[span] - skip, _PIECE + window - 1)
    bits = np.zeros(len(span))
    order = np.argsort(-length, kind="stable")
    part = 4096
    for s in range(0, len(order), part):
        pick = order[s : s + part]
        bits[pick] = _slide(data, begin[pick], length[pick], window)
    return np.maximum.reduceat(bits, np.cumsum(pieces) - pieces) if len(start) else bits


def _slide(data: np.ndarray, start: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
    plogp = np.arange(window + 2) * np.log2(np.maximum(np.arange(window + 2), 1))
    n = len(start)
    counts = np.zeros((n, 256), np.int16)
    total, best = np.zeros(n), np.zeros(n)
    short = np.minimum(size, window)
    for t in range(int(size[0])):
        live = int(np.searchsorted(-size, -t, side="left"))
        at = np.arange(live)
        if t >= window:
            out = data[start[:live] + t - window]
            c = counts[at, out]
            total[:live] += plogp[c - 1] - plogp[c]
            counts[at, out] = c - 1
        new = data[start[:live] + t]
        c = counts[at, new]
        total[:live] += plogp[c + 1] - plogp[c]
        counts[at, new] = c + 1
        full = t + 1 >= short[:live]
        best[:live][full] = np.maximum(best[:live][full], np.log2(short[:live][full]) - total[:live][full] / short[:live][full])
    return best


def _runs(data: np.ndarray, offs: np.ndarray, cls: CharClass) -> tuple[np.ndarray, np.ndarray]:
    mask = _members(cls.chars)[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    begin = mask.copy()
    begin[1:] &= ~mask[:-1] | first[1:-1]
    stop = mask.copy()
    stop[:-1] &= ~mask[1:] | first[1:-1]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    ok = e - s >= cls.least
    return s[ok], e[ok]


def scan_chunk(data: np.ndarray, offs: np.ndarray, cfg: SecretConfig) -> list[tuple[int, int, int, str, float]]:
    """``(row, begin byte, end byte, class, entropy)``, overlapping finds merged."""
    if not len(data):
        return []
    digit, alpha = _members(_DIGIT), _members(_LOWER + _UPPER)
    digits = np.concatenate([[0], np.cumsum(digit[data])])
    alphas = np.concatenate([[0], np.cumsum(alpha[data])])
    allow = [re.compile(p) for p in cfg.allow]
    before = [re.compile(p) for p in cfg.allow_before]
    found = []
    for cls in cfg.classes:
        s, e = _runs(data, offs, cls)
        mixed = (digits[e] > digits[s]) & (alphas[e] > alphas[s])
        if cls.name == "upper":  # access keys by their prefix, with or without a digit
            mixed |= np.array([data[x : x + 4].tobytes() in (b"AKIA", b"ASIA") for x in s.tolist()], bool)
        s, e = s[mixed], e[mixed]
        bits = window_entropy(data, s, e, cfg.window)
        for k in np.flatnonzero(bits >= cls.bits).tolist():
            row = int(np.searchsorted(offs, s[k], side="right")) - 1
            text = data[s[k] : e[k]].tobytes().decode("ascii")
            lead = data[max(int(offs[row]), int(s[k]) - cfg.context) : s[k]].tobytes().decode("utf-8", "ignore")
            if cls.name == "assigned" and not ASSIGNED.search(lead):
                continue
            if any(p.fullmatch(text) for p in allow) or any(p.search(lead) for p in before):
                continue
            end, last = int(e[k]), min(int(e[k]) + 2, int(offs[row + 1]))
            while cls.name == "base64" and end < last and data[end] == 61:  # padding
                end += 1
            found.append((row, int(s[k]), end, cls.name, float(bits[k])))
    found.sort(key=lambda x: (x[1], -x[2]))
    out: list[tuple[int, int, int, str, float]] = []
    for f in found:
        if out and f[0] == out[-1][0] and f[1] < out[-1][2]:
            p = out[-1]
            out[-1] = (p[0], p[1], max(p[2], f[2]), p[3], max(p[4], f[4]))
        else:
            out.append(f)
    return out


def find_secrets(docs: DataFrame, cfg: SecretConfig = SecretConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, begin_char, end_char, kind, entropy`` of every secret found.

    Characters count from 0, the end is exclusive; ``entropy`` is the largest of
    the span's windows, in bits, rounded to 6 places. Overlapping finds of several
    classes are one span, named after the earliest and then longest. Null and
    empty texts have none; repeated rows are reported each; a null id stays null;
    an empty table gives no rows.
    """
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at, cols = [], ([], [], [], [])
        for first, _, data, offs in tc.chunks(batch.column(1)):
            found = scan_chunk(data, offs, cfg)
            chars = char_places(data) if found else None
            for row, b, e, kind, bits in found:
                base = chars[offs[row]]
                at.append(first + row)
                for c, v in zip(cols, (int(chars[b] - base), int(chars[e] - base), kind, round(bits, 6))):
                    c.append(v)
        if at:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.float64())))],
                names=["doc_id", "begin_char", "end_char", "kind", "entropy"],
            )

    return map_arrow(src, run, "doc_id bigint, begin_char bigint, end_char bigint, kind string, entropy double")


def redact_secrets(docs: DataFrame, cfg: SecretConfig = SecretConfig(), text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with ``cfg.mark`` in the place of every secret; all rows stay.

    ``chars_col``, where there is one, is counted anew in the rows that change.
    Null and empty texts and texts without a secret are unchanged, repeated rows
    are treated alike, an empty table stays empty; other columns aren't read.
    """
    at = docs.columns.index(text_col)
    chars = docs.columns.index(chars_col) if chars_col in docs.columns else None
    mark = cfg.mark.encode()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts: dict[int, str] = {}
        for first, _, data, offs in tc.chunks(batch.column(at)):
            spans: dict[int, list[tuple[int, int]]] = {}
            for row, b, e, _, _ in scan_chunk(data, offs, cfg):
                spans.setdefault(row, []).append((b, e))
            for row, cut in spans.items():
                parts, last = [], int(offs[row])
                for b, e in cut:
                    parts += [data[last:b].tobytes(), mark]
                    last = e
                parts.append(data[last : offs[row + 1]].tobytes())
                texts[first + row] = b"".join(parts).decode("utf-8")
        yield replace_texts(batch, at, chars, texts)

    return map_arrow(docs, run, docs.schema)
