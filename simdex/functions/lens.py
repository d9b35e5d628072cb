"""Chain weights (lenses) and the fixed inverse-document-frequency table."""

from __future__ import annotations

import re

CHAINS = ("edit", "morph", "phrase", "vocab")

LENSES: dict[str, tuple[float, float, float, float]] = {
    "uniform": (1.0, 1.0, 1.0, 1.0),
    "dedup": (0.5, 0.5, 0.7, 1.0),
    "edit": (1.0, 0.3, 0.1, 0.0),
    "morph": (0.3, 1.0, 0.5, 0.2),
    "phrase": (0.1, 0.5, 1.0, 0.3),
    "phrase_dedup": (0.1, 0.3, 1.0, 0.5),
    "vocab": (0.0, 0.2, 0.3, 1.0),
    "code": (1.0, 0.8, 0.4, 0.2),
    "legal": (0.2, 0.4, 1.0, 0.8),
    "medical": (0.3, 1.0, 0.6, 0.5),
    "support": (0.2, 0.4, 0.7, 1.0),
    "policy": (0.1, 0.3, 1.0, 0.8),
}

#: How many frequent English grams fall on each channel.
_HITS = (
    "432312031321253106324226551432563231234473476353453430141236"
    "111310211300030220101123233212132222210120000030332221311252"
    "030020301211120012102131013110111001001102002212003032012010"
    "121230122210102254402001340012212220214110120031121310222102"
)

#: Weight of each of the 240 channels: fewer hits, more weight; words weigh half as much again.
STATIC_IDF: tuple[float, ...] = tuple(round((1.5 if i >= 180 else 1.0) / (1 + int(h)), 4) for i, h in enumerate(_HITS))


def parse_lens(spec: str | tuple[float, ...]) -> tuple[float, float, float, float]:
    """A lens by name, as four numbers, or as ``w,w,w,w``."""
    if not isinstance(spec, str):
        weights = tuple(float(w) for w in spec)
    elif spec in LENSES:
        return LENSES[spec]
    elif re.fullmatch(r"\s*[0-9.]+\s*(,\s*[0-9.]+\s*){3}", spec):
        weights = tuple(float(w) for w in spec.split(","))
    else:
        raise ValueError(f"no lens {spec!r}; there are {', '.join(LENSES)} and w,w,w,w")
    if len(weights) != 4 or min(weights) < 0:
        raise ValueError("a lens has four weights, none below 0")
    return weights
