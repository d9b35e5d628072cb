"""I-Match fingerprints: hashes of a document's mid-frequency terms.

Terms whose document frequency lies in a band of the corpus are kept, which is a
band of inverse document frequency: ``ln(1 / most) <= idf <= ln(1 / least)``.
A document's distinct terms in the band, sorted, are hashed once whole and once
for each of several randomised subsets of the lexicon. The band's lower edge is
a fraction of the corpus, so the lexicon has at most (mean distinct terms of a
document) / least entries however large the corpus is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import map_arrow

_CHUNK = 8 << 20


@dataclass(frozen=True)
class IMatchConfig:
    """``subsets`` lexicons besides the whole one; each leaves out ``dropped``/16 of the terms.

    A document with fewer than ``fewest`` terms in the band has no fingerprint.
    """

    least: float = 0.001
    most: float = 0.1
    subsets: int = 4
    dropped: int = 5
    fewest: int = 3


def _frequencies(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for _, _, data, offs in tc.chunks(batch.column(0), _CHUNK):
        w = tc.words(data, offs)
        if not len(w.start):
            continue
        order = np.argsort(w.hash, kind="stable")
        h, r = w.hash[order], w.row[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        first = new | np.concatenate([[True], r[1:] != r[:-1]])
        at = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays([pa.array(tc.signed(h[at])), pa.array(np.add.reduceat(first.astype(np.int64), at))], names=["term", "df"])


def lexicon(docs: DataFrame, cfg: IMatchConfig, text_col: str = "text") -> DataFrame:
    """``term`` (a 64-bit hash) and ``df`` of the terms in the band."""
    total = docs.count()
    freq = map_arrow(docs.select(F.col(text_col).cast("string")), _frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    return freq.where((F.col("df") >= total * cfg.least) & (F.col("df") <= total * cfg.most))


def _signatures(known: np.ndarray, cfg: IMatchConfig, column: pa.Array) -> tuple[np.ndarray, list[list[str | None]]]:
    n = len(column)
    count = np.zeros(n, np.int32)
    sigs: list[list[str | None]] = [[None] * n for _ in range(cfg.subsets + 1)]
    if not len(known):
        return count, sigs
    for first, rows, data, offs in tc.chunks(column, _CHUNK):
        w = tc.words(data, offs)
        at = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
        hit = np.flatnonzero(known[at] == w.hash)
        if not len(hit):
            continue
        uniq, rep, code = np.unique(at[hit], return_index=True, return_inverse=True)
        span = hit[rep]
        terms = [w.folded[s:e].tobytes() for s, e in zip(w.start[span].tolist(), w.end[span].tolist())]
        order = sorted(range(len(terms)), key=terms.__getitem__)
        rank = np.empty(len(terms), np.int64)
        rank[order] = np.arange(len(terms))
        terms = [terms[i] for i in order]
        digits = [hashlib.md5(t).hexdigest() for t in terms]
        inside = [np.array([int(d[j], 16) >= cfg.dropped for d in digits]) for j in range(cfg.subsets)]
        code = rank[code]
        bounds = np.searchsorted(w.row[hit], np.arange(rows + 1))
        for r in range(rows):
            own = np.unique(code[bounds[r] : bounds[r + 1]])
            count[first + r] = len(own)
            if len(own) < cfg.fewest:
                continue
            sigs[0][first + r] = _md5(terms, own)
            for j in range(cfg.subsets):
                part = own[inside[j][own]]
                if len(part):
                    sigs[j + 1][first + r] = _md5(terms, part)
    return count, sigs


def _md5(terms: list[bytes], pick: np.ndarray) -> str:
    return hashlib.md5(b" ".join([terms[i] for i in pick.tolist()])).hexdigest()


def _short_signatures(count: np.ndarray, cfg: IMatchConfig, column: pa.Array) -> list[str | None]:
    """Marked hashes of all distinct terms of the rows that have too few in the band."""
    out: list[str | None] = [None] * len(column)
    for first, rows, data, offs in tc.chunks(column, _CHUNK):
        few = np.flatnonzero(count[first : first + rows] < cfg.fewest)
        if not len(few):
            continue
        w = tc.words(data, offs)
        for r in few.tolist():
            span = slice(w.bounds[r], w.bounds[r + 1])
            terms = sorted({w.folded[s:e].tobytes() for s, e in zip(w.start[span].tolist(), w.end[span].tolist())})
            if terms:
                out[first + r] = "short-" + hashlib.md5(b" ".join(terms)).hexdigest()
    return out


def fingerprints(docs: DataFrame, cfg: IMatchConfig = IMatchConfig(), id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """``doc_id, n_terms, sig0 .. sigK`` of every row.

    ``sig0`` hashes all terms in the band, ``sig1`` on those of the randomised
    lexicons; documents that share any are duplicates by I-Match. A signature is
    null where its terms are none, and all are where there are fewer than
    ``cfg.fewest`` terms: so for null, empty and very short texts. With ``short``
    such texts have, in a further column ``sig_short``, the hash of all their
    distinct terms behind ``short-``, so that their exact copies share one; it is
    null for texts without a word and for all others. Frequencies count rows,
    repeated ones too; a null id stays null; an empty table gives no rows.
    """
    rows = lexicon(docs, cfg, text_col).select("term").toArrow()
    known = np.sort(rows.column(0).to_numpy().view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(known)
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = [f"sig{j}" for j in range(cfg.subsets + 1)] + ["sig_short"] * short

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        count, sigs = _signatures(shared.value, cfg, batch.column(1))
        if short:
            sigs.append(_short_signatures(count, cfg, batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), *(pa.array(s, pa.string()) for s in sigs)], names=["doc_id", "n_terms", *names])

    return map_arrow(src, run, "doc_id bigint, n_terms int, " + ", ".join(f"{n} string" for n in names))


def duplicate_groups(prints: DataFrame) -> DataFrame:
    """``signature, doc_id, first_id, members``: a row for each document and each signature that it shares.

    ``first_id`` is the smallest id with the signature, ``members`` how many ids
    have it. Groups are counted, not collected, so one may be of any size. Null
    ids are in no group; an id with several rows counts once.
    """
    cols = [c for c in prints.columns if c.startswith("sig")]
    rows = prints.select("doc_id", F.posexplode(F.array(*cols)).alias("k", "signature")).where("signature is not null and doc_id is not null").distinct()
    groups = rows.groupBy("k", "signature").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("members")).where("members > 1")
    return rows.join(groups, ["k", "signature"]).select("signature", "doc_id", "first_id", "members").distinct()


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)]))
_LOWER = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xE0, 0xF7), *range(0xF8, 0xFF)]))
#: The words of :mod:`textcore` as a regular expression.
WORD = r"[0-9A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{1FFF}\x{2070}-\x{2FFF}\x{3003}-\x{10FFFF}]+"


def sql(cfg: IMatchConfig = IMatchConfig(), source: str = "documents") -> str:
    """The same fingerprints in SQL, for tables whose ids are distinct."""
    subset = ", ".join(
        f"CASE WHEN count(*) >= {cfg.fewest} THEN md5(string_agg(t, ' ' ORDER BY t) FILTER (WHERE substr(md5(t), {j + 1}, 1) >= '{cfg.dropped:x}')) END AS sig{j + 1}" for j in range(cfg.subsets)
    )
    return f"""
    WITH words AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORD}'))) AS t FROM {source}),
    band AS (SELECT t FROM words GROUP BY t HAVING count(*) >= (SELECT count(*) FROM {source}) * {cfg.least}::DOUBLE AND count(*) <= (SELECT count(*) FROM {source}) * {cfg.most}::DOUBLE),
    sigs AS (SELECT doc_id, count(*)::INTEGER AS n_terms, CASE WHEN count(*) >= {cfg.fewest} THEN md5(string_agg(t, ' ' ORDER BY t)) END AS sig0, {subset}
             FROM words JOIN band USING (t) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_terms, 0)::INTEGER AS n_terms, {", ".join(f"sig{j}" for j in range(cfg.subsets + 1))} FROM {source} d LEFT JOIN sigs USING (doc_id)"""
