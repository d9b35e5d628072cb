"""Text to 240 ternary channels: four chains of 60, kept as eight 60-bit planes.

Bit ``i`` of plane ``p<c>`` says that channel ``i`` of chain ``c`` is 1, of
``q<c>`` that it is 2. ``s<c>`` is the chain's Euclidean norm, kept beside the
planes so that joins don't work it out per pair.

Bytes are cut to seven bits and folded to lower case first; chain 0 hashes
characters and pairs of them, chain 1 triples, chain 2 runs of five, chain 3
words. A hash picks a channel and adds 1 or 2 to it, modulo 3.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FNV_START, FNV_PRIME, GOLDEN = 0x811C9DC5, 0x01000193, 0x9E3779B9
SEED_CHAR, SEED_PAIR, SEED_TRIPLE, SEED_FIVE, SEED_WORD = 0x54523035, 0x54523031, 0x54523032, 0x54523033, 0x54523034
#: (chain, gram length, seed, hashes a gram)
GRAMS = ((0, 1, SEED_CHAR, 1), (0, 2, SEED_PAIR, 3), (1, 3, SEED_TRIPLE, 3), (2, 5, SEED_FIVE, 3))
PLANES = ("p0", "p1", "p2", "p3", "q0", "q1", "q2", "q3")
NORMS = ("s0", "s1", "s2", "s3")
_STRUCT = ", ".join(f"{p}: bigint" for p in PLANES)
_WHITE = np.isin(np.arange(128), [9, 10, 13, 32])
_ROWS = 1 << 18
#: Bytes and rows of an Arrow batch of texts between the JVM and Python.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4000


def fnv1a_32(data: bytes, seed: int = 0, mask: int = 0x7F) -> int:
    h = FNV_START ^ seed
    for b in data:
        h = ((h ^ (b & mask)) * FNV_PRIME) & 0xFFFFFFFF
    return h


def fnv1a_64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def fold7(data: np.ndarray) -> np.ndarray:
    low = data & 0x7F
    return low + ((low >= 65) & (low <= 90)).astype(np.uint8) * np.uint8(32)


def _seeds(seed: int, k: int) -> list[np.uint32]:
    return [np.uint32(FNV_START ^ ((seed + i * GOLDEN) & 0xFFFFFFFF)) for i in range(k)]


def _add(acc: np.ndarray, chain: int, row: np.ndarray, h: np.ndarray) -> None:
    n = acc.shape[0]
    at = (row * 60 + h % np.uint32(60)) * 2 + ((h >> np.uint32(16)) & np.uint32(1))
    both = np.bincount(at.astype(np.int64), minlength=n * 120).reshape(n, 60, 2)
    acc[:, chain * 60 : chain * 60 + 60] += both[:, :, 0] + 2 * both[:, :, 1]


def _hash_spans(text: np.ndarray, start: np.ndarray, size: np.ndarray, init: np.uint32) -> np.ndarray:
    h = np.full(len(start), init, np.uint32)
    order = np.argsort(-size, kind="stable")
    s, n = start[order], size[order]
    cur = h[order]
    live = len(cur)
    for j in range(int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n, -j, side="left"))
        cur[:live] = (cur[:live] ^ text[s[:live] + j]) * np.uint32(FNV_PRIME)
    h[order] = cur
    return h


def _bin(h: np.ndarray) -> np.ndarray:
    """Channel and value of a hash as one number below 120."""
    return ((h % np.uint32(60)) * np.uint32(2) + ((h >> np.uint32(16)) & np.uint32(1))).astype(np.int16)


@functools.lru_cache(maxsize=8)
def _short_table(width: int, seed: int, k: int) -> list[np.ndarray]:
    """Bins of every gram of up to three 7-bit characters."""
    grams = np.arange(128**width, dtype=np.uint32)
    out = []
    for init in _seeds(seed, k):
        h = np.full(len(grams), init, np.uint32)
        for j in range(width):
            h = (h ^ ((grams >> np.uint32(7 * (width - 1 - j))) & np.uint32(127))) * np.uint32(FNV_PRIME)
        out.append(_bin(h))
    return out


def _short_codes(text: np.ndarray, width: int, seed: int, k: int) -> Iterator[np.ndarray]:
    m = len(text) - width + 1
    gram = text[:m].astype(np.int32)
    for j in range(1, width):
        gram = (gram << 7) | text[j : m + j]
    for table in _short_table(width, seed, k):
        yield table[gram]


def _long_codes(text: np.ndarray, width: int, seed: int, k: int) -> Iterator[np.ndarray]:
    m = len(text) - width + 1
    wide = text.astype(np.uint32)
    for init in _seeds(seed, k):
        h = (wide[:m] ^ init) * np.uint32(FNV_PRIME)
        for j in range(1, width):
            h ^= wide[j : m + j]
            h *= np.uint32(FNV_PRIME)
        yield _bin(h)


def channels(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Channel values, one row of 240 per text of the concatenated ``data``."""
    n = len(offsets) - 1
    acc = np.zeros((n, 240), np.int64)
    text = fold7(np.asarray(data, np.uint8))
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    left = np.repeat(offsets[1:], size) - np.arange(len(text))
    for chain, width, seed, k in GRAMS:
        m = len(text) - width + 1
        bins = np.where(left[:m] >= width, row[:m], n) * 120 if m > 0 else row[:0]
        if m > 0:
            codes = _short_codes(text, width, seed, k) if width <= 3 else _long_codes(text, width, seed, k)
            for code in codes:
                both = np.bincount(bins + code, minlength=(n + 1) * 120)[: n * 120].reshape(n, 60, 2)
                acc[:, chain * 60 : chain * 60 + 60] += both[:, :, 0] + 2 * both[:, :, 1]
        short = np.flatnonzero((size > 0) & (size < width)) if width > 2 else np.zeros(0, np.int64)
        if len(short):
            for init in _seeds(seed, k):
                _add(acc, chain, short, _hash_spans(text, offsets[:-1][short], size[short], init))
    inside = ~_WHITE[text]
    first = np.zeros(len(text) + 1, bool)
    first[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | first[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    who = row[start]
    none = np.flatnonzero((size > 0) & (np.bincount(who, minlength=n) == 0))
    start, length = np.concatenate([start, offsets[:-1][none]]), np.concatenate([end - start, size[none]])
    who = np.concatenate([who, none])
    for init in _seeds(SEED_WORD, 3):
        if len(start):
            _add(acc, 3, who, _hash_spans(text, start, length, init))
    return (acc % 3).astype(np.uint8)


def encode_text(text: str | bytes | None) -> np.ndarray:
    """The 240 channels of one text; null and empty ones have all zeros."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return channels(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]


_BITS = np.int64(1) << np.arange(60, dtype=np.int64)


def planes_of(trits: np.ndarray) -> np.ndarray:
    """Planes ``p0..p3, q0..q3`` of rows of 240 channels."""
    by = trits.reshape(-1, 4, 60)
    return np.concatenate([(by == 1) @ _BITS, (by == 2) @ _BITS], axis=1)


def trits_of(planes: np.ndarray) -> np.ndarray:
    bits = ((planes[:, :, None] >> np.arange(60)) & 1).astype(np.uint8)
    return (bits[:, :4] + 2 * bits[:, 4:]).reshape(len(planes), 240)


def batch_planes(column: pa.Array) -> np.ndarray:
    """Planes of an Arrow string column, some 256 KB of text at a time."""
    arr = column.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    n = len(arr)
    out = np.zeros((n, 8), np.int64)
    if not n:
        return out
    offs = np.frombuffer(arr.buffers()[1], np.int64, n + 1, arr.offset * 8)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = min(n, max(at + 1, int(np.searchsorted(offs, offs[at] + _ROWS, side="right")) - 1))
        out[at:end] = planes_of(channels(data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]))
        at = end
    return out


def add_planes(df: DataFrame, text_col: str | Column = "text", suffix: str = "") -> DataFrame:
    """``df`` with the planes and norms of a text column, by one pass over Arrow batches."""
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    names = [f"{p}{suffix}" for p in PLANES]
    clash = [n for n in (*names, *(f"{s}{suffix}" for s in NORMS)) if n in df.columns]
    if clash:
        raise ValueError(f"columns {clash} are there already")
    src = df.withColumn("__text", text.cast("string"))
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        for batch in batches:
            made = batch_planes(batch.column(batch.num_columns - 1))
            cols = [*batch.columns[:-1], *(pa.array(made[:, i]) for i in range(8))]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], *names])
            pool.release_unused()

    return with_norms(src.mapInArrow(run, widened(df, **{n: T.LongType() for n in names})), suffix)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches, where the session's are larger or have no bound, so that long texts don't make large ones."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = str(spark.conf.get(key)).strip()
        if now.startswith("-") or not 0 < size(now) <= most:
            spark.conf.set(key, str(most))


def widened(df: DataFrame, **columns: T.DataType) -> T.StructType:
    """The schema of ``df`` with further columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in columns.items())])


def with_norms(df: DataFrame, suffix: str = "") -> DataFrame:
    norm = lambda c: F.expr(f"sqrt(cast(bit_count(p{c}{suffix}) + 4 * bit_count(q{c}{suffix}) as double))")
    return df.withColumns({f"s{c}{suffix}": norm(c) for c in range(4)})


def trit_array(prefix: str = "", suffix: str = "") -> Column:
    """The 240 channels as ``array<tinyint>`` from the planes."""
    bit = lambda plane, i: (F.expr(f"{prefix}{plane}{suffix}").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)) != 0).cast("tinyint")
    chain = lambda c: F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: bit(f"p{c}", i) + 2 * bit(f"q{c}", i))
    parts = [chain(c) for c in range(4)]
    return F.transform(F.concat(*parts), lambda x: x.cast("tinyint"))


def encode_cte(source: str, key: str = "id", text: str = "text", name: str = "enc") -> str:
    """SQL for ``name(key, p0..q3, s0..s3)``: the same encoding, written relationally.

    ``source`` names a relation with ``key`` and ``text``. Distinct grams are
    hashed once each; null and empty texts have zero planes.
    """
    x = name
    step = lambda h, b: f"((xor({h}, {b}) * 16777619) & 4294967295)"
    start = "xor(2166136261, (seed + k * 2654435769) & 4294967295)"
    parts = []
    for chain, width, seed, hashes in GRAMS:
        h = start
        for j in range(width):
            h = f"CASE WHEN b{j} IS NULL THEN {h} ELSE {step(h, f'b{j}')} END" if j and width > 2 else step(h, f"b{j}")
        ok = f"b{width - 1} IS NOT NULL" + (f" OR (i = 0 AND n < {width})" if width > 2 else "")
        ks = ", ".join(f"({k})" for k in range(hashes))
        parts.append(f"SELECT id, {chain} AS chain, {h} AS h FROM {x}_w, (VALUES {ks}) ks(k), (SELECT {seed} AS seed) WHERE {ok}")
    word = f"list_reduce(list_prepend({start}, list_transform(string_split(w, ''), lambda c: (ord(c) - 256)::BIGINT)), lambda h, b: {step('h', 'b')})"
    return f"""
    {x}_hex AS (SELECT {key} AS id, hex(encode(coalesce({text}, ''))) AS h FROM {source}),
    {x}_hh AS (SELECT id, unnest(regexp_extract_all(h, '..')) AS hh, unnest(range(length(h) // 2)) AS i, length(h) // 2 AS n FROM {x}_hex),
    {x}_b7 AS (SELECT id, i, n, ((instr('0123456789ABCDEF', hh[1]) - 1) & 7) * 16 + instr('0123456789ABCDEF', hh[2]) - 1 AS v FROM {x}_hh),
    {x}_v AS (SELECT id, i, n, (v + CASE WHEN v BETWEEN 65 AND 90 THEN 32 ELSE 0 END)::BIGINT AS b0 FROM {x}_b7),
    {x}_w AS (SELECT id, i, n, b0, {", ".join(f"lead(b0, {j}) OVER w AS b{j}" for j in range(1, 5))} FROM {x}_v WINDOW w AS (PARTITION BY id ORDER BY i)),
    {x}_s AS (SELECT id, string_agg(chr((b0 + 256)::INTEGER), '' ORDER BY i) AS s FROM {x}_v GROUP BY id),
    {x}_ws AS (SELECT id, s, regexp_extract_all(s, '[^' || chr(265) || chr(266) || chr(269) || chr(288) || ']+') AS ws FROM {x}_s),
    {x}_wd AS (SELECT id, unnest(CASE WHEN len(ws) = 0 THEN [s] ELSE ws END) AS w FROM {x}_ws),
    {x}_wh AS (SELECT w, {word} AS h FROM (SELECT DISTINCT w FROM {x}_wd), (VALUES (0), (1), (2)) ks(k), (SELECT {SEED_WORD} AS seed)),
    {x}_all AS ({" UNION ALL ".join(parts)} UNION ALL SELECT id, 3, h FROM {x}_wd JOIN {x}_wh USING (w)),
    {x}_sum AS (SELECT id, chain, h % 60 AS slot, sum((h >> 16) % 2 + 1) % 3 AS v FROM {x}_all GROUP BY ALL),
    {x}_pl AS (SELECT id, {", ".join(f"coalesce(sum(CASE WHEN chain = {c} AND v = {1 if p == 'p' else 2} THEN 1::BIGINT << slot::INTEGER END), 0)::BIGINT AS {p}{c}" for p in "pq" for c in range(4))} FROM {x}_sum GROUP BY id),
    {x} AS (SELECT r.id, {", ".join(f"coalesce({p}, 0)::BIGINT AS {p}" for p in PLANES)},
            {", ".join(f"sqrt((bit_count(coalesce(p{c}, 0))::BIGINT + 4 * bit_count(coalesce(q{c}, 0))::BIGINT)::DOUBLE) AS s{c}" for c in range(4))} FROM {x}_hex r LEFT JOIN {x}_pl USING (id))"""
