"""Word-level language labels from a linear-chain conditional random field.

Emission features of a word are its affixes, its character bigrams and trigrams
(hashed) and its entry in a lexicon of frequent training words; transitions
between languages are learned with them, on code-switched sequences spliced
from labelled documents. Labelling runs forward-backward over whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import map_arrow

_CHUNK = 2 << 20
#: Distinct words whose features are worked out at a time.
_SLICE = 20_000


@dataclass(frozen=True)
class LangConfig:
    """``sample`` bounds the labelled documents that training reads (by a hash of the id)."""

    sample: int = 600
    sequences: int = 1500
    length: int = 48
    mean_span: int = 12
    lexicon_min: int = 6
    bits: int = 16
    epochs: int = 60
    rate: float = 0.3
    decay: float = 1e-4
    min_share: float = 0.4
    seed: int = 11


@dataclass
class CrfModel:
    labels: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    lexicon_weights: np.ndarray
    transition: np.ndarray
    initial: np.ndarray


def word_features(folded: np.ndarray, start: np.ndarray, end: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature ids of each word span and their bounds by word."""
    n = len(start)
    size = (end - start).astype(np.int64)
    width = size + 2
    at = np.concatenate([[0], np.cumsum(width)])
    buf = np.zeros(at[-1], np.uint64)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    buf[np.repeat(at[:-1] + 1, size) + inner] = folded[np.repeat(start, size) + inner].astype(np.uint64) + np.uint64(2)
    buf[at[:-1]] = 1
    buf[at[1:] - 1] = 2
    owner = np.repeat(np.arange(n), width)
    pos = np.arange(at[-1]) - at[owner]
    ids, own = [], []
    mul = np.uint64(0x9E3779B97F4A7C15)

    def add(code: np.ndarray, who: np.ndarray, kind: int) -> None:
        ids.append((tc.mix64((code + np.uint64(kind << 40)) * mul) >> np.uint64(64 - bits)).astype(np.int64))
        own.append(who)

    for k in (2, 3):
        if at[-1] < k:
            continue
        code = np.zeros(at[-1] - k + 1, np.uint64)
        for j in range(k):
            code = code * np.uint64(260) + buf[j : at[-1] - k + 1 + j]
        ok = pos[: len(code)] + k <= width[owner[: len(code)]]
        add(code[ok], owner[: len(code)][ok], k)
    for k in (1, 2, 3, 4):
        who = np.flatnonzero(size >= k)
        head, tail = np.zeros(len(who), np.uint64), np.zeros(len(who), np.uint64)
        for j in range(k):
            head = head * np.uint64(260) + buf[at[who] + 1 + j]
            tail = tail * np.uint64(260) + buf[at[who + 1] - 1 - k + j]
        add(head, who, 16 + k)
        add(tail, who, 32 + k)
    ids, own = np.concatenate(ids), np.concatenate(own)
    order = np.argsort(own, kind="stable")
    return ids[order], np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))])


def _emissions(model: CrfModel, bits: int, folded: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(start), len(model.labels)), np.float32)
    for s in range(0, len(start), _SLICE):
        part = slice(s, s + _SLICE)
        ids, bounds = word_features(folded, start[part], end[part], bits)
        out[part] = np.add.reduceat(model.weights[ids], bounds[:-1], axis=0)
    if len(model.lexicon):
        at = np.minimum(np.searchsorted(model.lexicon, hashes), len(model.lexicon) - 1)
        hit = model.lexicon[at] == hashes
        out[hit] += model.lexicon_weights[at[hit]]
    return out


def marginals(emission: np.ndarray, bounds: np.ndarray, transition: np.ndarray, initial: np.ndarray) -> np.ndarray:
    """Posterior label probabilities of every word, chain by chain.

    ``emission`` holds log scores, one row a word; chain ``d`` is
    ``bounds[d]:bounds[d+1]``. All chains advance together, longest first.
    """
    score = np.exp(emission - emission.max(axis=1, keepdims=True)) if len(emission) else emission
    trans, first = np.exp(transition), np.exp(initial)
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    base, length = bounds[:-1][order], length[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(1, steps + 1), side="right")
    forward = np.empty_like(score)
    prev = None
    for t in range(steps):
        n = active[t]
        at = base[:n] + t
        cur = score[at] * (first if prev is None else prev[:n] @ trans)
        cur /= cur.sum(axis=1, keepdims=True)
        forward[at] = prev = cur
    back = np.ones((len(base), score.shape[1]))
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        at = base[:n] + t
        nxt = (score[at + 1] * back[:n]) @ trans.T
        nxt /= nxt.sum(axis=1, keepdims=True)
        back[:n] = nxt
        forward[at] *= nxt
    return forward / forward.sum(axis=1, keepdims=True) if len(forward) else forward


def train(rows: list[tuple[str, str]], cfg: LangConfig = LangConfig()) -> CrfModel | None:
    """Fit the model to ``(label, text)`` rows; None where no row has a word."""
    rows = [(lab, text) for lab, text in rows if lab is not None and text]
    if not rows:
        return None
    column = pa.array([t for _, t in rows], pa.large_string()).cast(pa.large_binary())
    labels = sorted({lab for lab, _ in rows})
    code = {lab: i for i, lab in enumerate(labels)}
    by_label: list[list[np.ndarray]] = [[] for _ in labels]
    folded, start, end, hashes, shift, words_seen = [], [], [], [], 0, 0
    for first, n, data, offs in tc.chunks(column):
        w = tc.words(data, offs)
        for r in range(n):
            span = np.arange(w.bounds[r], w.bounds[r + 1])
            if len(span):
                by_label[code[rows[first + r][0]]].append(span + words_seen)
        folded.append(w.folded)
        start.append(w.start + shift)
        end.append(w.end + shift)
        hashes.append(w.hash)
        shift += len(data)
        words_seen += len(w.start)
    have = [i for i, x in enumerate(by_label) if x]
    if not have:
        return None
    folded, start, end, hashes = (np.concatenate(x) for x in (folded, start, end, hashes))
    pool = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in by_label]
    rng = np.random.default_rng(cfg.seed)
    token = np.empty((cfg.sequences, cfg.length), np.int64)
    gold = np.empty((cfg.sequences, cfg.length), np.int64)
    for s in range(cfg.sequences):
        t = 0
        lab = have[rng.integers(len(have))]
        while t < cfg.length:
            span = min(cfg.length - t, 1 + int(rng.exponential(cfg.mean_span)))
            src = pool[lab]
            p = int(rng.integers(len(src)))
            token[s, t : t + span] = src[(p + np.arange(span)) % len(src)]
            gold[s, t : t + span] = lab
            t += span
            lab = have[rng.integers(len(have))]
    uniq, first_at, typ = np.unique(hashes[token.ravel()], return_index=True, return_inverse=True)
    rep = token.ravel()[first_at]
    ids, bounds = word_features(folded, start[rep], end[rep], cfg.bits)
    owner = np.repeat(np.arange(len(uniq)), np.diff(bounds))
    counts = np.bincount(typ, minlength=len(uniq))
    lex_at = np.flatnonzero(counts >= cfg.lexicon_min)
    k, y, total = len(labels), gold.ravel(), gold.size
    weights, lexw = np.zeros((1 << cfg.bits, k)), np.zeros((len(lex_at), k))
    trans, init = np.zeros((k, k)), np.zeros(k)
    grads = [np.full_like(x, 1e-8) for x in (weights, lexw, trans, init)]
    chain = np.arange(cfg.sequences + 1) * cfg.length
    target = np.zeros((total, k))
    target[np.arange(total), y] = 1
    pair_gold = np.zeros((k, k))
    np.add.at(pair_gold, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    for _ in range(cfg.epochs):
        emit = np.add.reduceat(weights[ids], bounds[:-1], axis=0)
        emit[lex_at] += lexw
        e = emit[typ]
        post, pair = _expectations(e, chain, trans, init, cfg.length)
        diff = (target - post) / total
        by_type = np.stack([np.bincount(typ, diff[:, c], minlength=len(uniq)) for c in range(k)], axis=1)
        g_w = np.stack([np.bincount(ids, by_type[owner, c], minlength=1 << cfg.bits) for c in range(k)], axis=1)
        found = (g_w * 100, by_type[lex_at] * 100, (pair_gold - pair) / total * 100, diff[:: cfg.length].sum(axis=0) * 100)
        for x, g, acc in zip((weights, lexw, trans, init), found, grads):
            g = g - cfg.decay * x
            acc += g * g
            x += cfg.rate * g / np.sqrt(acc)
    return CrfModel(labels, weights.astype(np.float32), uniq[lex_at], lexw.astype(np.float32), trans, init)


def _expectations(e: np.ndarray, chain: np.ndarray, trans: np.ndarray, init: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected labels and label pairs of equally long chains."""
    k = e.shape[1]
    score = np.exp(e - e.max(axis=1, keepdims=True)).reshape(-1, length, k)
    t_exp = np.exp(trans)
    fwd, bwd = np.empty_like(score), np.ones_like(score)
    fwd[:, 0] = score[:, 0] * np.exp(init)
    fwd[:, 0] /= fwd[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        cur = score[:, t] * (fwd[:, t - 1] @ t_exp)
        fwd[:, t] = cur / cur.sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        cur = (score[:, t + 1] * bwd[:, t + 1]) @ t_exp.T
        bwd[:, t] = cur / cur.sum(axis=1, keepdims=True)
    post = fwd * bwd
    post /= post.sum(axis=2, keepdims=True)
    right = score[:, 1:] * bwd[:, 1:]
    joint = np.einsum("sti,stj->stij", fwd[:, :-1], right) * t_exp
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    return post.reshape(-1, k), joint.sum(axis=(0, 1))


def label_words(model: CrfModel, bits: int, data: np.ndarray, offs: np.ndarray) -> tuple[tc.Words, np.ndarray]:
    """Words of a chunk and their posterior label probabilities."""
    w = tc.words(data, offs)
    if not len(w.start):
        return w, np.zeros((0, len(model.labels)))
    _, first_at, typ = np.unique(w.hash, return_index=True, return_inverse=True)
    emit = _emissions(model, bits, w.folded, w.start[first_at], w.end[first_at], w.hash[first_at])
    return w, marginals(emit[typ].astype(np.float64), w.bounds, model.transition, model.initial)


def judge(model: CrfModel | None, cfg: LangConfig, column: pa.Array) -> dict[str, np.ndarray]:
    """Per-row verdicts of a text column."""
    n = len(column)
    best, share = np.full(n, -1), np.zeros(n)
    count, switches = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for first, rows, data, offs in tc.chunks(column, _CHUNK):
        if model is None:
            count[first : first + rows] = np.diff(tc.words(data, offs).bounds)
            continue
        w, post = label_words(model, cfg.bits, data, offs)
        size = np.diff(w.bounds)
        count[first : first + rows] = size
        full = np.flatnonzero(size)
        if not len(full):
            continue
        mass = np.add.reduceat(post, w.bounds[full], axis=0) / size[full, None]
        best[first + full] = mass.argmax(axis=1)
        share[first + full] = mass.max(axis=1)
        top = post.argmax(axis=1)
        change = (top[1:] != top[:-1]) & (w.row[1:] == w.row[:-1])
        switches[first : first + rows] = np.bincount(w.row[1:][change], minlength=rows)
    kept = (count > 0) & ((best < 0) | (share >= cfg.min_share))
    return {"best": best, "share": share, "count": count, "switches": switches, "kept": kept}


def fit(docs: DataFrame, cfg: LangConfig = LangConfig(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> CrfModel | None:
    """Train on the ``cfg.sample`` labelled documents with the smallest id hashes."""
    key = F.xxhash64(F.col(id_col).cast("string"), F.lit(cfg.seed))
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    edge = [r[0] for r in labelled.select(key.alias("k")).orderBy("k").limit(cfg.sample).collect()]
    if not edge:
        return None
    rows = labelled.where(key <= edge[-1]).select(key.alias("k"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    rows = rows.orderBy("k", "l", "t").limit(cfg.sample).collect()
    return train([(r.l, r.t) for r in sorted(rows, key=lambda r: (r.k, r.l, r.t))], cfg)


def identify_languages(docs: DataFrame, cfg: LangConfig = LangConfig(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, lang, share, n_words, n_switches, kept`` for every row of ``docs``.

    ``lang`` is the language with the largest mean word posterior, ``share`` that
    mean, ``n_switches`` the changes of the most probable label from word to word.
    ``kept`` is false for texts without a word (null and empty ones among them:
    null ``lang``, null ``share``) and for texts in which no language has
    ``min_share``. Labels are read from ``lang_col`` for training only; rows with
    a null label or text do not train. Without a labelled row every text with a
    word is kept with a null language. Ties go to the first language by name;
    repeated rows are judged each; null ids stay null; an empty table gives none.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, cfg, id_col, text_col, lang_col))
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        got = judge(model.value, cfg, batch.column(1))
        none = got["best"] < 0
        names = pa.array([*(model.value.labels if model.value else []), None], pa.string())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                names.take(pa.array(np.where(none, len(names) - 1, got["best"]))),
                pa.array(got["share"], mask=none),
                pa.array(got["count"]),
                pa.array(got["switches"]),
                pa.array(got["kept"]),
            ],
            names=["doc_id", "lang", "share", "n_words", "n_switches", "kept"],
        )

    return map_arrow(src, run, "doc_id bigint, lang string, share double, n_words bigint, n_switches bigint, kept boolean")


def drop_unidentified(docs: DataFrame, cfg: LangConfig = LangConfig(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that :func:`identify_languages` keeps, all columns unchanged.

    Null and empty texts go; repeated rows stay or go together; an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, cfg, id_col, text_col, lang_col))
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array(judge(model.value, cfg, batch.column(at))["kept"]))

    return map_arrow(docs, run, docs.schema)
