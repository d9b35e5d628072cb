"""Personal data: overlapping candidates, judged by boosted trees.

Generators propose spans with high recall. Format and context features go to
gradient-boosted trees, trained on examples synthesised here from a seed, whose
scores are calibrated on held-out examples; each kind's threshold is the lowest
that keeps its held-out precision. Of overlapping spans the likeliest stays.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbdt
from .common import map_arrow

KINDS = ("email", "phone", "ip", "card", "ssn", "iban")

GENERATORS = {
    "email": re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63})*"),
    "phone": re.compile(r"(?<![\w.])\+?\(?\d{1,4}\)?(?:[ .\-]{0,2}\(?\d{2,5}\)?){1,5}(?!\w)"),
    "phone:area": re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3}[ .\-]?\d{4}(?!\w)"),
    "ip": re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d])"),
    "card": re.compile(r"(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)"),
    "ssn": re.compile(r"(?<!\d)\d{3}[\- ]\d{2}[\- ]\d{4}(?!\d)"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
}

_FOR = {
    "email": "email mail contact write reach correo courriel kontakt".split(),
    "phone": "phone tel call mobile fax cell telefon telefono téléphone whatsapp".split(),
    "ip": "ip address host login from client addr connection".split(),
    "card": "card visa mastercard amex credit debit cc tarjeta carte karte".split(),
    "ssn": "ssn social security".split(),
    "iban": "iban account bank konto compte cuenta transfer".split(),
}
_AGAINST = "version release build v order invoice isbn sku ref id page section chapter figure commit ticket item serial part batch timestamp lot".split()
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class PiiConfig:
    """``samples`` examples a kind are synthesised; a third of them calibrates.

    A kind's threshold is the lowest score of a true candidate that keeps ``precision``.
    """

    samples: int = 900
    trees: int = 150
    depth: int = 3
    precision: float = 0.98
    context: int = 48
    seed: int = 3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans of all generators, overlapping ones too."""
    return list(dict.fromkeys((m.start(), m.end(), name.partition(":")[0]) for name, rx in GENERATORS.items() for m in rx.finditer(text)))


def features(text: str, span: tuple[int, int, str], others: int, reach: int) -> list[float]:
    b, e, kind = span
    s = text[b:e]
    digits = re.sub(r"\D", "", s)
    groups = [len(g) for g in re.findall(r"\d+", s)]
    left, right = text[max(0, b - reach) : b], text[e : e + reach // 2]
    before = [w.lower() for w in _WORD.findall(left)[-5:]]
    octets = [int(x) for x in s.split(".")] if kind == "ip" else []
    counts = [digits.count(c) for c in set(digits)]
    entropy = -sum(c / len(digits) * math.log2(c / len(digits)) for c in counts) if digits else 0.0
    iban_ok = 0.0
    if kind == "iban":
        plain = s.replace(" ", "")
        iban_ok = float(int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1)
    host = s.rpartition("@")[2]
    return [
        *(float(kind == k) for k in KINDS),
        len(s), len(digits), float(len(digits) > 0 and luhn(digits)), entropy,
        max(counts, default=0) / max(1, len(digits)), float(digits[:1] in "3456" and bool(digits)), float(digits[:1] == "0"),
        float(s[:1] == "+"), float("(" in s), s.count("-"), s.count(" "), s.count("."),
        float(bool(octets) and max(octets) <= 255), float(bool(octets) and (octets[0] in (0, 127) or octets == [255] * 4 or sum(octets[1:]) <= 3)),
        max(octets, default=0), float(kind == "email" and "." in host), float(bool(re.search(r"\.[A-Za-z]{2,}$", host))) * (kind == "email"),
        iban_ok, float(any(w in _FOR[kind] for w in before)), float(any(w in _AGAINST for w in before[-2:])), float(bool(re.search(r"[#$€£=/\\_]\s?$", left))),
        float(left[-1:].isalnum()), float(right[:1].isalnum()), float(bool(re.match(r"[.,:/]\d", right))), float(bool(re.search(r"\d[.,:/\-]$", left))), float(others),
        len(groups), max(groups, default=0), min(groups, default=0), groups[-1] if groups else 0, groups[0] if groups else 0, float(bool(re.match(r"[ .\-]?\d", right))), float(bool(re.search(r"\d[ .\-]?$", left))),
    ]


def _overlaps(spans: list[tuple[int, int, str]]) -> list[int]:
    """How many other spans each one overlaps: those that begin before its end less those that end by its begin."""
    begin, end = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
    return (np.searchsorted(np.sort(begin), end) - np.searchsorted(np.sort(end), begin, side="right") - 1).tolist()


def _example(rng: np.random.Generator, kind: str, positive: bool) -> tuple[str, int, int]:
    """A text with one true or false instance of a kind."""
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvwyéñü"), rng.integers(2, 9)))
    host = lambda: re.sub(r"[^a-z]", "x", word())
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    if kind == "email":
        name = ".".join([word(), num(2)] if rng.random() < 0.5 else [word()])
        s = f"{name}@{host()}{num(1) if rng.random() < 0.5 else ''}.{rng.choice(['com', 'org', 'net', 'example.com', 'co.uk', 'de', 'fr', 'es'])}" if positive else f"{word()}@{host() if rng.random() < 0.5 else num(3)}"
    elif kind == "phone":
        sep = rng.choice(["-", " ", "."])
        if positive:
            s = [f"+{rng.integers(1, 99)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", sep.join(["+" + str(rng.integers(1, 99)), num(3), num(3), num(4)]), f"{num(3)}{sep}{num(3)}{sep}{num(4)}", f"+{rng.integers(30, 60)} {num(2)} {num(8)}", sep.join([rng.choice(["0", f"+{rng.integers(30, 60)} "]) + num(1), *(num(2) for _ in range(4))]), f"0{num(2)} {num(4)} {num(4)}", f"0{num(int(rng.integers(2, 5)))}{rng.choice([' ', '-'])}{num(int(rng.integers(6, 9)))}"][rng.integers(8)]
        else:
            s = [f"{num(2)} {num(3)}", f"20{num(2)}-{num(2)}-{num(2)}", num(int(rng.integers(4, 10))), f"{num(1)}.{num(2)}", next(n for n in iter(lambda: num(16), "") if not luhn(n)), f"{num(4)} {num(2)} {num(2)}", f"{num(3)}-{num(3)}"][rng.integers(7)]
    elif kind == "ip":
        low = rng.random() < 0.3
        s = ".".join(str(x) for x in rng.integers(0 if rng.random() < 0.2 else 1, 20 if low else 256, 4)) if positive else [".".join(str(x) for x in rng.integers(200, 999, 4)), "127.0.0.1", "0.0.0.0", "255.255.255.255", ".".join(str(x) for x in rng.integers(0, 12, 4))][rng.integers(5)]
    elif kind == "card":
        few = rng.choice(list("0123456789"), rng.integers(1, 4)) if rng.random() < 0.3 else list("0123456789")  # round numbers among them
        amex = rng.random() < 0.15
        body = str(rng.choice(["34", "37"])) + "".join(rng.choice(few, 12)) if amex else (str(rng.choice(list("3456"))) if rng.random() < 0.8 else num(1)) + "".join(rng.choice(few, 14))
        check = next(c for c in "0123456789" if luhn(body + c))
        s = body + (check if positive else str((int(check) + rng.integers(1, 10)) % 10))
        if rng.random() < 0.3:
            s = str(rng.choice([" ", "-"])).join([s[:4], s[4:10], s[10:]] if amex else [s[i : i + 4] for i in range(0, 16, 4)])
    elif kind == "ssn":
        spaced = positive and rng.random() < 0.2
        s = f"{num(3)}-{num(2)}-{num(4)}" if positive and not spaced else f"{num(3)} {num(2)} {num(4)}"
    else:
        country, plain = str(rng.choice(["DE", "FR", "ES", "GB", "IT", "NL"])), num(int(rng.integers(14, 20)))
        if rng.random() < 0.5:
            plain = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 4)) + plain[4:]
        body = int("".join(str(int(c, 36)) for c in plain + country + "00"))
        check = (98 - body % 97) if positive else (98 - body % 97 + rng.integers(1, 90)) % 97
        s = f"{country}{check:02d}{plain}"
        if rng.random() < 0.5:
            s = " ".join(s[i : i + 4] for i in range(0, len(s), 4))
    cue = ""
    if positive and (rng.random() < 0.25 or kind == "ip" and low or kind == "ssn" and spaced):
        cue = str(rng.choice(_FOR[kind])) + str(rng.choice([": ", " ", " is ", ". "]))
    elif not positive and rng.random() < 0.4 or positive is False and kind == "ip" and s.count(".") == 3 and max(map(int, s.split("."))) < 12:
        cue = str(rng.choice(_AGAINST)) + str(rng.choice([": ", " ", " #"]))
    left = " ".join(word() for _ in range(rng.integers(0, 7)))
    left = f"{left} {cue}" if left else cue
    after = ["", " " + num(3), " " + num(4)][rng.integers(3)] if rng.random() < 0.25 else ""
    tail = after + str(rng.choice(["", ".", ",", " ", "!!", "###", "%%%", "***"])) + " " + " ".join(word() for _ in range(rng.integers(0, 5)))
    return left + s + tail, len(left), len(left) + len(s)


@dataclass
class PiiModel:
    trees: gbdt.BoostedTrees
    scale: float
    shift: float
    thresholds: dict[str, float]
    held_out: dict[str, tuple[float, float]]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.trees.raw(x) + self.shift, -30, 30)))


def labelled(cfg: PiiConfig, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of all candidates in synthesised texts.

    A candidate is true where it covers a true instance and is of its kind.
    """
    rng = np.random.default_rng(seed)
    x, y, k = [], [], []
    for i, kind in enumerate(KINDS):
        for j in range(cfg.samples):
            positive = j % 2 == 0
            text, b, e = _example(rng, kind, positive)
            spans = candidates(text)
            for s, n in zip(spans, _overlaps(spans)):
                x.append(features(text, s, n, cfg.context))
                y.append(float(positive and s[2] == kind and abs(s[0] - b) <= 1 and abs(s[1] - e) <= 1))
                k.append(KINDS.index(s[2]))
    return np.array(x), np.array(y), np.array(k)


@functools.lru_cache(maxsize=2)
def train(cfg: PiiConfig = PiiConfig()) -> PiiModel:
    x, y, kind = labelled(cfg, cfg.seed)
    fold = np.random.default_rng(cfg.seed).random(len(x)) < 1 / 3
    model = PiiModel(gbdt.fit(x[~fold], y[~fold], cfg.trees, cfg.depth), 1.0, 0.0, {}, {})
    model.scale, model.shift = gbdt.platt(model.trees.raw(x[fold]), y[fold])
    p = model.probability(x[fold])
    for i, name in enumerate(KINDS):
        own = kind[fold] == i
        order = np.argsort(-p[own])
        true = y[fold][own][order] > 0
        hit, miss = np.cumsum(true), np.cumsum(~true)
        ok = np.flatnonzero(true & (hit >= cfg.precision * (hit + miss)))
        model.thresholds[name] = float(p[own][order][ok[-1]]) if len(ok) else 1.0
        chosen = p[own] >= model.thresholds[name]
        truth = y[fold][own] > 0
        model.held_out[name] = (float((chosen & truth).sum() / max(1, chosen.sum())), float((chosen & truth).sum() / max(1, truth.sum())))
    return model


def select(text: str, model: PiiModel, cfg: PiiConfig) -> list[tuple[int, int, str, float]]:
    """Chosen spans of a text in order, by probability where they overlap."""
    spans = candidates(text)
    if not spans:
        return []
    x = np.array([features(text, s, n, cfg.context) for s, n in zip(spans, _overlaps(spans))])
    return resolve(spans, model.probability(x), model)


def resolve(spans: list[tuple[int, int, str]], p: np.ndarray, model: PiiModel) -> list[tuple[int, int, str, float]]:
    ranked = sorted((-q, b, -e, k) for (b, e, k), q in zip(spans, p.tolist()) if q >= model.thresholds[k])
    out: list[tuple[int, int, str, float]] = []
    for q, b, e, k in ranked:
        if all(-e <= o[0] or b >= o[1] for o in out):
            out.append((b, -e, k, -q))
    return sorted(out)


_MAYBE = r"[0-9@]"


def find_pii(docs: DataFrame, cfg: PiiConfig = PiiConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, begin_char, end_char, kind, probability`` of the chosen spans.

    Characters count from 0, the end is exclusive; probabilities are rounded to 6
    places. Of equally likely overlapping spans the earliest and longest stays.
    Texts without a digit or at sign have no candidate, so none is generated for
    null and empty ones; repeated rows are reported each; a null id stays null; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(cfg))
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col(text_col).rlike(_MAYBE))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = shared.value
        per_row, x = [], []
        for text in batch.column(1).to_pylist():
            spans = candidates(text)
            per_row.append(spans)
            x += [features(text, s, n, cfg.context) for s, n in zip(spans, _overlaps(spans))]
        if not x:
            return
        p = model.probability(np.array(x))
        at, cols, used = [], ([], [], [], []), 0
        for r, spans in enumerate(per_row):
            for found in resolve(spans, p[used : used + len(spans)], model):
                at.append(r)
                for c, v in zip(cols, found):
                    c.append(v)
            used += len(spans)
        if at:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(np.round(cols[3], 6))],
                names=["doc_id", "begin_char", "end_char", "kind", "probability"],
            )

    return map_arrow(src, run, "doc_id bigint, begin_char bigint, end_char bigint, kind string, probability double")
