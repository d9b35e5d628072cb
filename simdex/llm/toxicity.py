"""Misspelled abuse terms by Levenshtein automata, with context-window scores.

The automata of all terms are intersected with the lexicon's trie by the subset
construction; the result is one table that reads a word a character at a time,
so all distinct words of a batch step through it together. A word that reaches
a term only by an edit at its first letter counts where the context is telling:
with a plain second person or a sure hit in its window. A hit's score depends on the
words and marks around it, which separate abuse from quotation and mention.

Public terms stand for themselves. Further terms, of any language, are learned from
labelled documents by their log-likelihood ratio; one of them proves nothing, but
a document whose learned terms sum up to enough evidence for its length is a find.
The same documents show which words in reach of a term are ordinary ones.
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
from .common import discard, map_arrow, materialize

LEXICON = (
    "trash", "pathetic", "idiot", "idiots", "idiotic", "worthless", "disgusting", "stupid", "clown", "clowns", "scum", "scumbag", "loser", "losers", "moron", "morons", "moronic",
    "imbecile", "imbeciles", "cretin", "bastard", "bitch", "asshole", "dumbass", "retard", "retards", "retarded", "vermin", "subhuman", "degenerate", "halfwit", "dimwit", "nitwit", "lowlife", "lowlifes", "douchebag",
    "connard", "salope", "abruti", "arschloch", "dummkopf", "schwachkopf", "gilipollas", "pendejo", "estupido", "imbecil",
)

#: Ordinary English, German, French and Spanish words within the reach of a term; they are no hits. What labelled documents show to be ordinary comes on top.
ORDINARY = (
    "rash", "closer", "closers", "oser", "doser", "blown", "flown", "itch", "witch", "ditch", "hitch", "aitch", "galope", "mirthless", "regenerated", "regenerates", "boronic", "petard",
    "thrash", "lose", "loses", "loose", "lower", "lowers", "lover", "lovers", "lasers", "laser", "layer", "layers", "lesser", "losers'", "leaser", "poser", "crown", "crowns", "clowned", "idiom", "idioms",
    "moon", "moons", "mormon", "mormons", "maroon", "mason", "macron", "cretan", "certain", "custard", "mustard", "batch", "birch", "botch", "butch", "pitch", "retire", "retired", "regards", "rewards", "petards", "permin", "studio", "stupor",
    "rapid", "empathetic", "apathetic", "sympathetic", "generate", "degenerated", "regenerate", "disguising", "tras", "track", "stash", "human", "halfway", "moray", "boron", "matron", "motion",
    "crash", "brash", "trust", "clan", "clone", "close", "down", "tranh", "toon", "loner", "loners", "lowed", "loaded", "moran", "morin", "worthies", "wordless", "salop", "abrupt", "brut",
)

#: Ordinary words that are also common misspellings of a term; their context decides.
EITHER = ("looser",)

SECOND_PERSON = "you your yours yourself u ur tu toi vous ton votre du dich dein deine ihr euch te ti vosotros usted ustedes eres".split()
#: Second persons too common as syllables or other words to make a doubtful hit a sure one.
FAINT = frozenset({"te", "ti", "ton"})
REPORTING = "said says say called calls wrote writes quoted quote quotes quoting shouted yelled claimed stated reported according dit disait sagte schrieb dijo escribió".split()
MENTION = "word words term terms slur insult meaning definition defined dictionary noun adjective translation synonym mot wort palabra".split()


@dataclass(frozen=True)
class ToxicConfig:
    """Scores: a hit's own by its edits, what its window adds or takes, and the document's threshold.

    ``sample`` bounds the labelled documents of a class that training reads, ``terms``
    the learned terms. A term is learned from ``least_docs`` toxic documents or more
    by a log-likelihood statistic of ``least_gain`` and a log odds of ``least_weight``.
    The evidence a document needs leaves alone ``clean`` of the clean labelled ones.
    """

    lexicon: tuple[str, ...] = LEXICON
    ordinary: tuple[str, ...] = ORDINARY
    own: tuple[float, ...] = (1.0, 0.8, 0.6)
    window: int = 6
    second_person: float = 0.3
    neighbour: float = 0.15
    reporting: float = 0.8
    mention: float = 0.5
    quoted: float = 0.4
    threshold: float = 0.75
    sample: int = 10_000
    terms: int = 2000
    least_docs: int = 4
    least_gain: float = 15.0
    least_weight: float = 1.5
    misspelt: float = 0.5
    folds: int = 4
    clean: float = 0.99
    seed: int = 23


@dataclass
class Learned:
    """Terms of labelled documents with their log odds, by fold and over all (last), and the ordinary words in reach of a term.

    ``coefficients`` of evidence, log of the words and 1 give the log odds of a toxic document.
    """

    terms: list[str]
    hashes: np.ndarray
    weights: np.ndarray
    ordinary: np.ndarray
    coefficients: np.ndarray | None = None
    threshold: float = 1.0


NOTHING = Learned([], np.zeros(0, np.uint64), np.zeros((1, 0)), np.zeros(0, np.uint64))


#: Terms that lie next to ordinary words of other languages (Verein, creation) count only as they are.
EXACT = frozenset({"vermin", "cretin"})


def allowed_edits(term: str) -> int:
    """None up to 4 letters, one up to 8, then two; two edits need a telling context."""
    return 0 if len(term) <= 4 or term in EXACT else 1 if len(term) <= 8 else 2


_SYMBOL = np.full(256, 27, np.uint8)
_SYMBOL[97:123] = np.arange(1, 27)
for _d, _c in zip("0134578", "oieastb"):
    _SYMBOL[ord(_d)] = ord(_c) - 96
#: Symbols of two-byte letters by lead and next byte: accents dropped, Greek and Cyrillic look-alikes as Latin letters.
_TWO = np.full((256, 256), 27, np.uint8)
_LOOKS = {"a": "àáâãäåæāăąаα", "c": "çćčсϲ", "d": "ďđԁ", "e": "èéêëēęěеё", "g": "ğġ", "h": "һ", "i": "ìíîïīįıіϊι", "j": "ј", "k": "кκ", "l": "łĺľ", "m": "м", "n": "ñńňη", "o": "òóôõöøōőоοσ", "p": "рρ", "r": "řŕг", "s": "śšşßѕ", "t": "ťтτ", "u": "ùúûüūůűυ", "v": "ѵν", "x": "хχ", "y": "ýÿуγ", "z": "źżž"}
for _base, _chars in _LOOKS.items():
    for _c in _chars:
        _b = _c.encode()
        _TWO[_b[0], _b[1]] = ord(_base) - 96
_N_SYMBOLS = 28


@dataclass
class Automaton:
    """``table[state, symbol]``; state 0 is dead, 1 the start; ``term`` is -1 where none ends."""

    table: np.ndarray
    term: np.ndarray
    edits: np.ndarray
    terms: list[str]
    longest: int


def build(lexicon: tuple[str, ...], first: bool = False, learned: frozenset[str] = frozenset()) -> Automaton:
    """Subset construction over (trie node, edits) pairs; ``first`` allows edits at the first letter too.

    ``learned`` terms besides the lexicon have one edit at most.
    """
    terms = sorted({*lexicon, *learned})
    limits = {t: min(allowed_edits(t), 1) if t in learned else allowed_edits(t) for t in terms}
    child: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    reach: list[int] = [0]
    for i, t in enumerate(terms):
        node, limit = 0, limits[t]
        reach[0] = max(reach[0], limit)
        for c in t:
            sym = ord(c) - 96
            if sym not in child[node]:
                child[node][sym] = len(child)
                child.append({})
                ends.append(-1)
                reach.append(0)
            node = child[node][sym]
            reach[node] = max(reach[node], limit)
        ends[node] = i

    def close(states: dict[int, int]) -> frozenset[tuple[int, int]]:
        todo = list(states.items())
        while todo:
            node, e = todo.pop()
            if (node or first) and e < reach[node]:
                for nxt in child[node].values():
                    if e + 1 <= reach[nxt] and e + 1 < states.get(nxt, 9):
                        states[nxt] = e + 1
                        todo.append((nxt, e + 1))
        return frozenset(states.items())

    def step(state: frozenset[tuple[int, int]], sym: int) -> frozenset[tuple[int, int]]:
        out: dict[int, int] = {}
        for node, e in state:
            for s, nxt in child[node].items():
                cost = e if s == sym else e + 1 if node or first else 9
                if cost <= reach[nxt] and cost < out.get(nxt, 9):
                    out[nxt] = cost
            if (node or first) and e + 1 <= reach[node] and e + 1 < out.get(node, 9):
                out[node] = e + 1
        return close(out)

    start = close({0: 0})
    number, queue, rows = {frozenset(): 0, start: 1}, [start], [[0] * _N_SYMBOLS]
    while queue:
        state = queue.pop(0)
        live = {s for node, _ in state for s in child[node]}
        other = step(state, 27)
        row = []
        for sym in range(_N_SYMBOLS):
            nxt = frozenset() if sym == 0 else step(state, sym) if sym in live else other
            if nxt not in number:
                number[nxt] = len(number)
                queue.append(nxt)
            row.append(number[nxt])
        rows.append(row)
    term, edits = np.full(len(number), -1), np.zeros(len(number), np.int64)
    for state, k in number.items():
        found = [(e, ends[node]) for node, e in state if ends[node] >= 0 and e <= limits[terms[ends[node]]]]
        if found:
            edits[k], term[k] = min(found)
    return Automaton(np.array(rows, np.int32), term, edits, terms, max((len(t) + limits[t] for t in terms), default=0))


def match_words(auto: Automaton, folded: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term index (-1: none) and edits of each word span."""
    term, edits = np.full(len(start), -1), np.zeros(len(start), np.int64)
    size = end - start
    pick = np.flatnonzero((size >= 3) & (size <= 2 * auto.longest))
    state, pos = np.ones(len(pick), np.int32), start[pick].copy()
    letters = np.zeros(len(pick), np.int64)
    live = np.arange(len(pick))
    while len(live):
        at = pos[live]
        byte = folded[at]
        two = (byte >= 0xC2) & (byte <= 0xDF)
        nxt = folded[np.minimum(at + 1, len(folded) - 1)]
        sym = np.where(two, _TWO[byte, nxt], _SYMBOL[byte])
        letters[live] += two & (sym < 27) | ((byte >= 97) & (byte <= 122))
        state[live] = auto.table[state[live], sym]
        pos[live] = at + 1 + two
        live = live[(state[live] > 0) & (pos[live] < end[pick[live]])]
    good = (pos >= end[pick]) & (auto.term[state] >= 0) & (letters >= 2)
    term[pick[good]] = auto.term[state[good]]
    edits[pick[good]] = auto.edits[state[good]]
    return term, edits


_PAIRS = ((b"\xc2\xab", b"\xc2\xbb"), (b"\xe2\x80\x9c", b"\xe2\x80\x9d"), (b"\xe2\x80\x9e", b"\xe2\x80\x9c"))


def _places(data: np.ndarray, mark: bytes) -> np.ndarray:
    """Where ``mark`` begins in ``data``, ascending."""
    at = np.flatnonzero(data[: max(0, len(data) - len(mark) + 1)] == mark[0])
    for k, byte in enumerate(mark[1:], 1):
        at = at[data[at + k] == byte]
    return at


def are_quoted(data: np.ndarray, offs: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each span lies between a pair of quotation marks on its line.

    Lines end at line feeds and rows. Straight marks are counted from the line's
    start; of the others the last one before the span must open and a closing one
    must follow on the line. A mark that closes a low one opens nothing.
    """
    edges = np.union1d(_places(data, b"\n") + 1, offs)
    line = np.searchsorted(edges, begin, side="right")
    low, high = edges[line - 1], np.append(edges, len(data) + 1)[line]
    seen = np.concatenate([[0], np.cumsum(data == 34)])
    high = np.minimum(high, len(data))
    out = ((seen[begin] - seen[low]) % 2 == 1) & (seen[high] > seen[end])
    low_open, low_close = _places(data, _PAIRS[2][0]), _places(data, _PAIRS[2][1])
    for opening, closing in _PAIRS:
        opens, closes = _places(data, opening), _places(data, closing)
        if not len(opens) or not len(closes):
            continue
        if opening == _PAIRS[1][0] and len(low_open):
            opens = opens[~_closes_low(edges, low_open, low_close, opens)]
        last_open, last_close = _last(opens, begin), _last(closes, begin)
        following = np.append(closes, len(data))[np.searchsorted(closes, end)]
        out |= (last_open >= low) & (last_open > last_close) & (following < high)
    return out


def _last(places: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The last of ``places`` before each position, -1 where none is."""
    return np.concatenate([[-1], places])[np.searchsorted(places, before)]


def _closes_low(edges: np.ndarray, low_open: np.ndarray, close: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the mark at each place is the first closing one after a low mark of its line."""
    opened = _last(low_open, at)
    return (opened >= edges[np.searchsorted(edges, at, side="right") - 1]) & (opened > _last(close, at))


def letters_of(word: str) -> str | None:
    """The term a word stands for in the trie: letters a to z only; None where it has others."""
    raw = np.frombuffer(word.encode(), np.uint8)
    out, k = [], 0
    while k < len(raw):
        two = 0xC2 <= raw[k] <= 0xDF and k + 1 < len(raw)
        out.append(int(_TWO[raw[k], raw[k + 1]] if two else _SYMBOL[raw[k]]))
        k += 1 + two
    return None if 27 in out else "".join(chr(96 + x) for x in out)


#: Signs that may stand within a word that is to be hidden.
_JOINS = np.zeros(256, bool)
_JOINS[list(b" .-_*")] = True
_HYPHENS = np.zeros(256, bool)
_HYPHENS[list(b"-_*")] = True


class Scorer:
    def __init__(self, cfg: ToxicConfig, learned: Learned = NOTHING):
        self.cfg, self.learned = cfg, learned
        spelt = (letters_of(t) for t in learned.terms)
        further = frozenset(t for t in spelt if t and len(t) > 5) - set(cfg.lexicon)
        self.auto, self.wide = build(cfg.lexicon, learned=further), build(cfg.lexicon, first=True, learned=further)
        self.public = np.isin(np.array(self.auto.terms), np.array(cfg.lexicon))
        of = {letters_of(t): k for k, t in enumerate(learned.terms)}
        self.place = np.array([of.get(t, -1) if not p else -1 for t, p in zip(self.auto.terms, self.public.tolist())], np.int64)
        hashed = lambda ws: np.sort(np.array([tc.word_hash(w) for w in ws], np.uint64))
        self.ordinary = np.union1d(hashed(w for w in cfg.ordinary if w.isalpha()), learned.ordinary)
        self.either = hashed(EITHER)
        self.address = hashed(w for w in SECOND_PERSON if w not in FAINT)
        self.second, self.report, self.mention = hashed(SECOND_PERSON), hashed(REPORTING), hashed(MENTION)

    def match_types(self, folded: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: public term (-1: none), its edits, whether only a telling context makes it a hit, learned term (-1: none)."""
        term, edits = match_words(self.auto, folded, start, end)
        rest = np.flatnonzero(term < 0)
        term[rest], edits[rest] = match_words(self.wide, folded, start[rest], end[rest])
        weak = np.zeros(len(term), bool)
        weak[rest] = True
        weak |= np.isin(hashes, self.either)
        for k, word in self._drawn_out(folded, start, end, term):
            t, e = self._lookup(word)
            if t >= 0 and self.public[t]:
                term[k], edits[k], weak[k] = t, min(2, e + 1), False
        own = np.full(len(term), -1)
        if len(self.learned.hashes):
            at = np.minimum(np.searchsorted(self.learned.hashes, hashes), len(self.learned.hashes) - 1)
            exact = (self.learned.hashes[at] == hashes) & ~((term >= 0) & self.public[term] & (edits == 0))
            own[exact], weak[exact] = at[exact], False
            edits[exact], term[exact] = 0, -1
        term[np.isin(hashes, self.ordinary) & (edits > 0)] = -1
        near = np.flatnonzero((term >= 0) & ~self.public[term] & (own < 0))
        own[near], weak[near] = self.place[term[near]], True
        term[near] = -1
        return term, edits, weak, own

    def _lookup(self, word: bytes) -> tuple[int, int]:
        data = np.frombuffer(word, np.uint8)
        t, e = match_words(self.auto, data, np.array([0]), np.array([len(data)]))
        return int(t[0]), int(e[0])

    def _drawn_out(self, folded: np.ndarray, start: np.ndarray, end: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Words without a term that draw a letter out three times or more, with it once."""
        same = np.zeros(len(folded) + 1, bool)
        if len(folded) > 2:
            same[: len(folded) - 2] = (folded[:-2] == folded[1:-1]) & (folded[1:-1] == folded[2:]) & (folded[:-2] >= 97) & (folded[:-2] <= 122)
        places = np.flatnonzero(same)
        if not len(places):
            return
        holds = np.searchsorted(places, end - 2) > np.searchsorted(places, start)
        for k in np.flatnonzero(holds & (term < 0) & (end - start <= 200)).tolist():
            yield k, re.sub(rb"([a-z])\1{2,}", rb"\1", folded[start[k] : end[k]].tobytes())

    def _spelt_out(self, w: tc.Words) -> list[tuple[int, int, int]]:
        """``(first word, public term, edits)`` of words that are written letter by letter or with a hyphen within."""
        gap = np.zeros(len(w.start), bool)
        between = w.end[:-1]
        close = (w.start[1:] - between == 1) & (w.row[1:] == w.row[:-1])
        gap[:-1] = close & _JOINS[w.folded[np.minimum(between, len(w.folded) - 1)]]
        single = (w.end - w.start == 1) & (w.folded[np.minimum(w.start, len(w.folded) - 1)] >= 97)
        link = gap.copy()
        link[:-1] &= single[:-1] & single[1:]
        link[-1:] = False
        edge = np.flatnonzero(np.diff(np.concatenate([[0], link.view(np.int8), [0]])))
        out = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if 4 <= b - a + 1 <= 2 * self.auto.longest:
                t, e = self._lookup(w.folded[w.start[a : b + 1]].tobytes())
                if t >= 0 and self.public[t] and e == 0:
                    out.append((a, t, 1))
        hyphen = np.zeros(len(w.start), bool)
        hyphen[:-1] = close & _HYPHENS[w.folded[np.minimum(between, len(w.folded) - 1)]]
        size = w.end - w.start
        pair = np.flatnonzero(hyphen[:-1] & (size[:-1] + size[1:] <= self.auto.longest) & (size[:-1] + size[1:] >= 5) & (np.minimum(size[:-1], size[1:]) > 1))
        for a in pair.tolist():
            t, e = self._lookup(w.folded[w.start[a] : w.end[a]].tobytes() + w.folded[w.start[a + 1] : w.end[a + 1]].tobytes())
            if t >= 0 and self.public[t] and e == 0:
                out.append((a, t, 1))
        return out

    def _window(self, w: tc.Words, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = w.row[hits]
        return np.maximum(w.bounds[row], hits - self.cfg.window), np.minimum(w.bounds[row + 1], hits + self.cfg.window + 1)

    def _telling(self, w: tc.Words, hits: np.ndarray, weak: np.ndarray, address: np.ndarray) -> np.ndarray:
        """``hits`` without the weak ones that have neither a plain second person nor a sure hit of their row in the window."""
        doubt = hits[weak[hits]]
        if not len(doubt):
            return hits
        telling = address.copy()
        telling[hits[~weak[hits]]] = True
        upto = np.concatenate([[0], np.cumsum(telling)])
        low, high = self._window(w, doubt)
        return np.setdiff1d(hits, doubt[upto[high] == upto[low]])

    def score(self, data: np.ndarray, offs: np.ndarray, fold: np.ndarray | None = None) -> list[tuple[int, float, int, int, list[str], float, float]]:
        """``(row, score, hits, quoted hits, terms, evidence, public score)`` of the rows with a hit.

        The evidence is by the weights of each row's ``fold``, over all where None.
        """
        cfg, w, learned = self.cfg, tc.words(data, offs), self.learned
        if not len(w.start):
            return []
        types, first_at, typ = np.unique(w.hash, return_index=True, return_inverse=True)
        term, edits, weak, own = (x[typ] for x in self.match_types(w.folded, w.start[first_at], w.end[first_at], types))
        for k, t, e in self._spelt_out(w):
            if term[k] < 0:
                term[k], edits[k], weak[k], own[k] = t, e, False, -1
        marks = [np.isin(types, x)[typ] for x in (self.address, self.second, self.report, self.mention)]
        hits = self._telling(w, np.flatnonzero((term >= 0) | (own >= 0)), weak, marks[0])
        if not len(hits):
            return []
        row, (low, high) = w.row[hits], self._window(w, hits)
        second, report, mention = ((lambda c: c[high] > c[low])(np.concatenate([[0], np.cumsum(m)])) for m in marks[1:])
        inside = are_quoted(data, offs, w.start[hits], w.end[hits])
        factor = np.where(inside, np.where(report, cfg.quoted * cfg.reporting, cfg.quoted), 1.0) * np.where(mention, cfg.mention, 1.0)
        near = np.searchsorted(hits, high) - np.searchsorted(hits, low) - 1
        public = own[hits] < 0
        single = np.where(public, (np.array(cfg.own)[edits[hits]] + cfg.neighbour * near + cfg.second_person * second) * factor, 0.0)
        proof = np.zeros(len(hits))
        if len(learned.hashes):
            which = np.full(len(hits), -1) if fold is None else fold[row]
            proof = np.where(public, 0.0, learned.weights[which, own[hits]] * factor * np.where(edits[hits] > 0, cfg.misspelt, 1.0))
        edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        best = np.maximum.reduceat(single, edge)
        counts, quoted = np.diff(np.append(edge, len(hits))), np.add.reduceat(inside.astype(np.int64), edge)
        # a learned term counts once a document, where it says most
        code = row * (len(learned.terms) + 1) + own[hits] + 1
        order = np.lexsort((-proof, code))
        once = order[np.concatenate([[True], code[order][1:] != code[order][:-1]])]
        evidence = np.bincount(row[once], proof[once], minlength=len(offs) - 1)
        out = []
        for i, (r, b, n, q) in enumerate(zip(row[edge].tolist(), best.tolist(), counts.tolist(), quoted.tolist())):
            own_hits = hits[edge[i] : edge[i] + n]
            names = {self.auto.terms[term[h]] if own[h] < 0 else learned.terms[own[h]] for h in own_hits.tolist()}
            s = max(b, cfg.threshold * self.proven(float(evidence[r]), int(w.bounds[r + 1] - w.bounds[r])) / learned.threshold)
            out.append((r, s, n, q, sorted(names), float(evidence[r]), b))
        return out

    def proven(self, evidence: float, words: int) -> float:
        """Probability of a toxic document by its learned terms."""
        c = self.learned.coefficients
        return 0.0 if c is None or evidence <= 0 else float(1 / (1 + np.exp(-np.clip(c @ [evidence, np.log1p(words), 1.0], -30, 30))))


def _gain(t: np.ndarray, c: np.ndarray, nt: float, nc: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood statistic and log odds of words in ``t`` of ``nt`` toxic and ``c`` of ``nc`` clean documents."""
    share, n = nt / max(1.0, nt + nc), t + c
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(t > 0, t * np.log(t / (n * share)), 0) + np.where(c > 0, c * np.log(c / (n * (1 - share))), 0))
    return np.nan_to_num(g), np.log((t + 0.5) / (nt + 1)) - np.log((c + 0.5) / (nc + 1))


def _word_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``h, word, toxic, fold`` of each distinct word of a document."""
    toxic, fold = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
    for first, n, data, offs in tc.chunks(batch.column(2)):
        w = tc.words(data, offs)
        key = np.lexsort((w.hash, w.row))
        fresh = np.concatenate([[True], (w.hash[key][1:] != w.hash[key][:-1]) | (w.row[key][1:] != w.row[key][:-1])])[: len(key)]
        at = key[fresh]
        at = at[(w.end[at] - w.start[at] >= 3) & (w.end[at] - w.start[at] <= 60)]
        names = [w.folded[s:e].tobytes().decode() for s, e in zip(w.start[at].tolist(), w.end[at].tolist())]
        r = first + w.row[at]
        yield pa.RecordBatch.from_arrays([pa.array(tc.signed(w.hash[at])), pa.array(names, pa.string()), pa.array(toxic[r]), pa.array(fold[r])], names=["h", "word", "toxic", "fold"])


def learn(docs: DataFrame, labels: DataFrame, cfg: ToxicConfig = ToxicConfig(), id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic") -> Learned:
    """Terms, ordinary words and the evidence needed, from ``cfg.sample`` labelled documents of each class, those with the smallest id hashes.

    Null ids and labels don't count; of several labels of an id the largest does, of
    several texts the one with the smallest hash; of equal texts of a class one is read. The evidence model
    is fitted to terms learned without a document's own fold. Without labelled
    documents of both classes nothing is learned.
    """
    marked = labels.select(F.col(label_id).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    marked = marked.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    key = F.xxhash64("doc_id", F.lit(cfg.seed))
    some = [marked.where(F.col("toxic") == t).orderBy(key, "doc_id").limit(cfg.sample) for t in (0, 1)]
    some = F.broadcast(some[0].unionByName(some[1]).withColumnRenamed("doc_id", "labelled"))
    text = docs.select(F.col(id_col).cast("bigint").alias("labelled"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    one = text.join(some, "labelled").groupBy("labelled", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m"))
    rows = materialize(one.select("toxic", F.pmod(F.col("m.h"), F.lit(cfg.folds)).cast("int").alias("fold"), F.col("m.text").alias("text")).dropDuplicates(), "labelled")
    size = {(r.toxic, r.fold): r.n for r in rows.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}
    sizes = np.array([[size.get((t, f), 0) for f in range(cfg.folds)] for t in (1, 0)], float)
    if not sizes.sum(axis=1).all():
        discard(rows)
        return NOTHING
    seen = map_arrow(rows, _word_rows, "h bigint, word string, toxic int, fold int")
    sums = [F.count(F.when((F.col("toxic") == t) & (F.col("fold") == f), 1)).alias(f"{'ct'[t]}{f}") for t in (1, 0) for f in range(cfg.folds)]
    seen = materialize(seen.groupBy("h").agg(F.min("word").alias("word"), *sums), "words")
    total = {x: sum(F.col(f"{x}{f}") for f in range(cfg.folds)) for x in "tc"}
    likely = seen.where(total["t"] >= cfg.least_docs).where(total["t"] * float(sizes[1].sum()) > total["c"] * float(sizes[0].sum()) * float(np.exp(cfg.least_weight)))
    found = likely.orderBy((total["t"] * F.log((total["t"] + 0.5) / (total["c"] + 0.5))).desc(), "h").limit(4 * cfg.terms).toPandas()
    t, c = (found[[f"{x}{f}" for f in range(cfg.folds)]].to_numpy(float) for x in "tc")
    gain, weight = _gain(t.sum(axis=1), c.sum(axis=1), *sizes.sum(axis=1))
    ok = (gain >= cfg.least_gain) & (weight >= cfg.least_weight) & ~found["word"].isin(cfg.lexicon).to_numpy()
    pick = np.lexsort((found["h"].to_numpy(), -gain))
    pick = pick[ok[pick]][: cfg.terms]
    pick = pick[np.argsort(found["h"].to_numpy()[pick].view(np.uint64))]
    weights = []
    for f in [*range(cfg.folds), None]:
        left = [x[pick].sum(axis=1) - (x[pick][:, f] if f is not None else 0) for x in (t, c)]
        g, own = _gain(*left, *(sizes.sum(axis=1) - (sizes[:, f] if f is not None else 0)))
        weights.append(np.where((g >= cfg.least_gain * (1 if f is None else 1 - 1 / cfg.folds)) & (left[0] > 0), own, 0.0))
    learned = Learned(found["word"].to_numpy()[pick].tolist(), found["h"].to_numpy()[pick].view(np.uint64), np.array(weights), np.zeros(0, np.uint64))
    sc = docs.sparkSession.sparkContext
    scorer = sc.broadcast(Scorer(cfg, learned))

    def in_reach(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, _, data, offs in tc.chunks(batch.column(1)):
            w = tc.words(data, offs)
            term, edits, _, own = scorer.value.match_types(w.folded, w.start, w.end, w.hash)
            at = np.flatnonzero(((term >= 0) | (own >= 0)) & (edits > 0))
            yield pa.RecordBatch.from_arrays([pa.array(tc.signed(w.hash[at]))], names=["h"])

    plain = seen.where(total["c"] >= 2).where(total["c"] * float(sizes[0].sum()) * 2 >= total["t"] * float(sizes[1].sum()))
    ordinary = [r.h for r in map_arrow(plain.select("h", "word"), in_reach, "h bigint").collect()]
    learned.ordinary = np.sort(np.array(ordinary, np.int64).view(np.uint64))
    scorer = sc.broadcast(Scorer(cfg, learned))

    def judge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fold = batch.column(1).to_numpy(zero_copy_only=False)
        for first, n, data, offs in tc.chunks(batch.column(2)):
            x = np.zeros((n, 3))
            x[:, 1] = np.log1p(np.diff(tc.words(data, offs).bounds))
            for r, _, _, _, _, proof, single in scorer.value.score(data, offs, fold[first : first + n]):
                x[r, 0], x[r, 2] = proof, single
            toxic = batch.column(0).slice(first, n)
            yield pa.RecordBatch.from_arrays([toxic, *(pa.array(v) for v in x.T)], names=["toxic", "proof", "words", "single"])

    got = map_arrow(rows, judge, "toxic int, proof double, words double, single double").toPandas().sort_values(["toxic", "proof", "words", "single"])
    discard(rows)
    discard(seen)
    got = got[got["single"] < cfg.threshold]
    x, y = np.column_stack([got["proof"], got["words"], np.ones(len(got))]), got["toxic"].to_numpy(float)
    if len(pick) and y.any() and not y.all():
        coef = _logistic(x, y)
        if coef[0] > 0:
            p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
            learned.coefficients = coef
            learned.threshold = float(max(0.5, np.quantile(p[y == 0], cfg.clean)))
    return learned


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a slightly ridged logistic regression, by Newton's method."""
    b = np.zeros(x.shape[1])
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(len(b)), x.T @ (y - q) - 1e-2 * b)
    return b


def find_toxic(
    docs: DataFrame, labels: DataFrame | None = None, cfg: ToxicConfig = ToxicConfig(), id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic"
) -> DataFrame:
    """``doc_id, score, n_hits, n_quoted, terms`` of the documents at or above the threshold.

    The score is the largest of the document's public hits or what its learned
    terms prove, scaled to the same threshold, rounded to 6 places; ``terms`` are
    the terms matched, sorted. ``labels`` trains as in :func:`learn`; without it
    public terms alone count. Null and empty texts have no hit; repeated rows are
    reported each; a null id stays null; an empty table gives no rows.
    """
    learned = learn(docs, labels, cfg, id_col, text_col, label_id, label_col) if labels is not None else NOTHING
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(cfg, learned))
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, _, data, offs in tc.chunks(batch.column(1), 4 << 20):
            rows = [r for r in shared.value.score(data, offs) if round(r[1], 6) >= cfg.threshold]
            if rows:
                at, score, n, quoted, terms, _, _ = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(first + np.array(at))),
                        pa.array(np.round(score, 6)),
                        pa.array(n, pa.int32()),
                        pa.array(quoted, pa.int32()),
                        pa.array(terms, pa.list_(pa.string())),
                    ],
                    names=["doc_id", "score", "n_hits", "n_quoted", "terms"],
                )

    return map_arrow(src, run, "doc_id bigint, score double, n_hits int, n_quoted int, terms array<string>")
