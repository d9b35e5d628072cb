"""Packed vectors and the reversible positional code of short texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encode import FNV_PRIME, FNV_START, NORMS, PLANES, planes_of, trits_of, widened, with_norms

SLOTS = 12
_CODES = bytes.fromhex(
    "363738393a3d3e3f41424344454647494a4b4d4e505355565758595c5d5e6162"
    "9acbd81e1f2025d1e3e426299fdf9e2f7177787c7e8286898b98c0b92b2a2dcc"
    "1b4c0307191106020a0b1c09080d150113050e21526d12345a0f54f231162327"
    "33ee0c106a2c181d40142224aa2830042e3b5f3c51be484f5b606617321a3563"
)
_BACK = {c: i for i, c in enumerate(_CODES)}
_COMMON, _MEDIUM = set("etaoinshrdlu"), set("cmfgpwyb")


def _trits(code: int) -> list[int]:
    return [code // 3**k % 3 for k in range(5)]


def _is_word(c: int) -> bool:
    return chr(c).isascii() and chr(c).isalnum()


def _classes(chars: list[int], i: int) -> list[int]:
    c = chars[i]
    ch = chr(c)
    letter, digit = ch.isalpha() and c < 128, ch.isdigit()
    case = 0 if letter and ch.islower() else 1 if letter else 2
    if not _is_word(c):
        place = 2
    elif i == 0 or not _is_word(chars[i - 1]):
        place = 0
    elif i == len(chars) - 1 or not _is_word(chars[i + 1]):
        place = 2
    else:
        place = 1
    low = ch.lower()
    freq = 0 if low in _COMMON else 1 if low in _MEDIUM else 2
    return [0 if letter else 1 if digit else 2, subclass(c), case, place, freq]


def subclass(c: int) -> int:
    """Vowels and multiples of three are 0, y, z's column and controls 2, the rest 1."""
    ch = chr(c)
    if c < 32 or c == 127 or ch in "Yy":
        return 2
    if ch.isdigit():
        return int(ch) % 3
    return 0 if ch in " AEIOUaeiou" else 1


def overflow_hash(raw: bytes) -> int:
    """FNV-1a of what the last slot stands for, 0 where nothing is cut."""
    if len(raw) <= SLOTS:
        return 0
    h = FNV_START
    for b in raw[SLOTS - 1 :]:
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFF
    return h


def positional_encode(raw: bytes) -> np.ndarray:
    """Forward, reverse, differential and structural views of the first 12 bytes."""
    out = np.zeros((4, SLOTS, 5), np.uint8)
    chars = [b & 0x7F for b in raw[: SLOTS - 1 if len(raw) > SLOTS else SLOTS]]
    codes = [_CODES[c] for c in chars]
    for i, code in enumerate(codes):
        out[0, i] = _trits(code)
        out[1, len(codes) - 1 - i] = _trits(code)
        out[2, i] = _trits(code if i == 0 else (code - codes[i - 1]) % 243)
        out[3, i] = _classes(chars, i)
    if len(raw) > SLOTS:
        out[:, SLOTS - 1] = _trits(overflow_hash(raw) % 242 + 1)
    return out.reshape(240)


def positional_decode(channels: np.ndarray) -> tuple[str, bool]:
    """Text of the forward view and whether it had been cut."""
    codes = channels.reshape(4, SLOTS, 5).astype(int) @ np.array([1, 3, 9, 27, 81])
    used = np.flatnonzero(codes[0])
    if not len(used):
        return "", False
    n = int(used[-1]) + 1
    cut = n == SLOTS and codes[0, SLOTS - 1] != codes[1, 0]
    return "".join(chr(_BACK[c]) if c in _BACK else "?" for c in codes[0, : n - cut]), bool(cut)


def pack5(trits: np.ndarray) -> bytes:
    """Five channels a byte, the first the least significant: 48 bytes for 240."""
    return bytes((np.asarray(trits).reshape(-1, 5) @ np.array([1, 3, 9, 27, 81])).astype(np.uint8))


def unpack5(packed: bytes) -> np.ndarray:
    return (np.frombuffer(packed, np.uint8)[:, None].astype(int) // np.array([1, 3, 9, 27, 81]) % 3).astype(np.uint8).ravel()


def pack_size(n: int) -> int:
    return -(-n // 4)


def pack2(trits: np.ndarray) -> bytes:
    """Two bits a channel, four a byte, lowest bits first."""
    t = np.zeros(4 * pack_size(len(trits)), np.uint8)
    t[: len(trits)] = trits
    return bytes(t.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8))


def unpack2(packed: bytes, n: int) -> np.ndarray:
    return (np.frombuffer(packed, np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).ravel()[:n]


def valid2(packed: bytes, n: int) -> bool:
    return len(packed) >= pack_size(n) and bool((unpack2(packed, n) < 3).all())


def add_packed(df: DataFrame, name: str = "packed") -> DataFrame:
    """``df`` with the 48-byte form of its planes."""
    at = [df.columns.index(p) for p in PLANES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in at], axis=1) if batch.num_rows else np.zeros((0, 8), np.int64)
            codes = (trits_of(planes).reshape(-1, 48, 5) @ np.array([1, 3, 9, 27, 81])).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in codes], pa.binary())], names=[*batch.schema.names, name])

    return df.mapInArrow(run, widened(df, **{name: T.BinaryType()}))


def add_unpacked(df: DataFrame, packed: str = "packed", suffix: str = "") -> DataFrame:
    """``df`` with planes and norms of its 48-byte vectors; a null one is all zeros, another length or a byte above 242 an error."""
    at, names = df.columns.index(packed), [f"{p}{suffix}" for p in PLANES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x if x is not None else bytes(48) for x in batch.column(at).to_pylist()]
            if any(len(x) != 48 for x in rows):
                raise ValueError(f"{packed}: a packed vector has 48 bytes")
            codes = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 48)
            if codes.size and codes.max() > 242:
                raise ValueError(f"{packed}: a byte is above 242")
            planes = planes_of((codes[:, :, None].astype(int) // np.array([1, 3, 9, 27, 81]) % 3).astype(np.uint8).reshape(-1, 240))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(planes[:, i]) for i in range(8))], names=[*batch.schema.names, *names])

    return with_norms(df.mapInArrow(run, widened(df, **{n: T.LongType() for n in names})), suffix)


def compare_packed(df: DataFrame, a: str, b: str, lens: str | tuple[float, ...] = "dedup", name: str = "similarity") -> DataFrame:
    """``df`` with the lens similarity of two packed columns."""
    from .similarity import lens_cosine

    both = add_unpacked(add_unpacked(df, a, "_x"), b, "_y")
    expr = lens_cosine("a.", "b.", lens)
    for side, suffix in (("a.", "_x"), ("b.", "_y")):
        for n in (*PLANES, *NORMS):
            expr = expr.replace(f"{side}{n}", f"{n}{suffix}")
    return both.select(*df.columns, F.expr(expr).alias(name))


def add_positional(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``positional`` (packed), ``decoded`` and ``was_cut`` of a text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [positional_encode((t or "").encode()) for t in batch.column(text_col).to_pylist()]
            back = [positional_decode(r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([pack5(r) for r in rows], pa.binary()), pa.array([t for t, _ in back], pa.string()), pa.array([c for _, c in back], pa.bool_())],
                names=[*batch.schema.names, "positional", "decoded", "was_cut"],
            )

    return df.mapInArrow(run, widened(df, positional=T.BinaryType(), decoded=T.StringType(), was_cut=T.BooleanType()))


def encode_info(text: Column) -> tuple[Column, Column, Column]:
    """Characters encoded, whether the text is cut, and the hash of the rest."""
    size = F.octet_length(text)
    rest = F.hex(F.substring(text.cast("binary"), SLOTS, 1 << 30))
    byte = lambda i: F.conv(F.substr(rest, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint")
    h = F.aggregate(F.transform(F.sequence(F.lit(0), size - SLOTS), byte), F.lit(FNV_START).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.least(size, F.lit(SLOTS)), size > SLOTS, F.when(size > SLOTS, h).otherwise(F.lit(0).cast("bigint"))
