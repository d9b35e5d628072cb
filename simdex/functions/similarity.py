"""Similarities of two plane rows, as expressions that Spark SQL and DuckDB both read.

``a`` and ``b`` are prefixes such as ``a.`` of the plane columns. All dot products
are popcounts, so Spark compiles them into the stage that evaluates them.
"""

from __future__ import annotations

from collections.abc import Sequence

from .lens import STATIC_IDF, parse_lens

MASK60 = (1 << 60) - 1


def bc(x: str) -> str:
    """Popcount as BIGINT (one engine returns a narrower type)."""
    return f"CAST(bit_count({x}) AS BIGINT)"


def dot(a: str, b: str, c: int, mask: int | None = None) -> str:
    m = "" if mask is None else f" & {mask}"
    pa, qa, pb, qb = f"{a}p{c}", f"{a}q{c}", f"{b}p{c}", f"{b}q{c}"
    return f"({bc(f'{pa} & {pb}{m}')} + 2 * ({bc(f'{pa} & {qb}{m}')} + {bc(f'{qa} & {pb}{m}')}) + 4 * {bc(f'{qa} & {qb}{m}')})"


def chain_cosine(a: str, b: str, c: int) -> str:
    """Cosine of the raw 0/1/2 channels of a chain; 0 where either is all zero."""
    return f"(CASE WHEN {a}s{c} = 0 OR {b}s{c} = 0 THEN 0.0e0 ELSE least({dot(a, b, c)} / ({a}s{c} * {b}s{c}), 1.0e0) END)"


def _average(parts: Sequence[tuple[float, str]]) -> str:
    live = [(w, x) for w, x in parts if w > 0]
    if not live:
        return "0.0e0"
    return f"(({' + '.join(f'{w!r}e0 * {x}' for w, x in live)}) / {sum(w for w, _ in live)!r}e0)"


def lens_cosine(a: str, b: str, lens: str | tuple[float, ...] = "dedup") -> str:
    """Weighted mean of the chain cosines; chains without weight are not evaluated."""
    return _average([(w, chain_cosine(a, b, c)) for c, w in enumerate(parse_lens(lens))])


def lens_bound(a: str, b: str, lens: str | tuple[float, ...] = "dedup") -> str:
    """An upper bound of the lens cosine from the norms alone.

    Channels are 2 at most, so a chain's dot product is at most the smaller
    squared norm, and its cosine at most the ratio of the norms.
    """
    part = lambda c: f"(CASE WHEN {a}s{c} = 0 OR {b}s{c} = 0 THEN 0.0e0 ELSE least({_ratio(a, b, c)}, 1.0e0) END)"
    return _average([(w, part(c)) for c, w in enumerate(parse_lens(lens))])


def _ratio(a: str, b: str, c: int) -> str:
    return f"(2.0e0 * least({total(a, c)}, {total(b, c)}) / ({a}s{c} * {b}s{c}))"


def total(a: str, c: int) -> str:
    """Sum of a chain's channels."""
    return f"({bc(f'{a}p{c}')} + 2 * {bc(f'{a}q{c}')})"


def norm2(a: str, c: int) -> str:
    return f"({bc(f'{a}p{c}')} + 4 * {bc(f'{a}q{c}')})"


def flat_cosine(a: str, b: str) -> str:
    """Cosine over all 240 channels."""
    na, nb = (" + ".join(norm2(x, c) for c in range(4)) for x in (a, b))
    return f"(CASE WHEN ({na}) = 0 OR ({nb}) = 0 THEN 0.0e0 ELSE least(({' + '.join(dot(a, b, c) for c in range(4))}) / (sqrt(CAST({na} AS DOUBLE)) * sqrt(CAST({nb} AS DOUBLE))), 1.0e0) END)"


def agreement(a: str, b: str, c: int) -> str:
    """Channels of a chain that are equal."""
    pa, qa, pb, qb = f"{a}p{c}", f"{a}q{c}", f"{b}p{c}", f"{b}q{c}"
    return f"({bc(f'{pa} & {pb}')} + {bc(f'{qa} & {qb}')} + 60 - {bc(f'({pa} | {qa} | {pb} | {qb})')})"


def matching(a: str, b: str) -> str:
    return f"({' + '.join(agreement(a, b, c) for c in range(4))})"


def hamming(a: str, b: str) -> str:
    return f"(240 - {matching(a, b)})"


def fill_ratio(a: str) -> str:
    """Share of the channels that are not zero."""
    return f"(({' + '.join(bc(f'({a}p{c} | {a}q{c})') for c in range(4))}) / 240.0e0)"


def calibrated(raw: str, a: str, b: str, floor: float = 0.05) -> str:
    """A similarity divided by the geometric mean of the fill ratios, within 0..1."""
    return f"greatest(least({raw} / sqrt(greatest({fill_ratio(a)}, {floor}e0) * greatest({fill_ratio(b)}, {floor}e0)), 1.0e0), 0.0e0)"


def reported_calibration(raw: str, a: str, b: str) -> str:
    """The same without a floor; unchanged where a text has no channel."""
    return f"(CASE WHEN {fill_ratio(a)} * {fill_ratio(b)} > 0 THEN least({raw} / sqrt({fill_ratio(a)} * {fill_ratio(b)}), 1.0e0) ELSE {raw} END)"


def weight_masks(weights: Sequence[float]) -> list[list[tuple[float, int]]]:
    """By chain: each distinct weight with the mask of its channels."""
    out = []
    for c in range(4):
        by: dict[float, int] = {}
        for i, w in enumerate(weights[c * 60 : c * 60 + 60]):
            by[w] = by.get(w, 0) | 1 << i
        out.append(sorted(by.items()))
    return out


def _weighted(a: str, b: str, c: int, masks: list[list[tuple[float, int]]]) -> str:
    return "(" + " + ".join(f"{w!r}e0 * {dot(a, b, c, m)}" for w, m in masks[c] if w) + ")"


def _over(num: str, da: str, db: str) -> str:
    return f"(CASE WHEN sqrt({da}) * sqrt({db}) < 1e-12 THEN 0.0e0 ELSE least({num} / (sqrt({da}) * sqrt({db})), 1.0e0) END)"


def idf_cosine(a: str, b: str, weights: Sequence[float] = STATIC_IDF) -> str:
    """Cosine in which each channel has a weight."""
    m = weight_masks(weights)
    sum_of = lambda x, y: "(" + " + ".join(_weighted(x, y, c, m) for c in range(4)) + ")"
    return _over(sum_of(a, b), sum_of(a, a), sum_of(b, b))


def idf_lens_joint(a: str, b: str, lens: str | tuple[float, ...] = "dedup", weights: Sequence[float] = STATIC_IDF) -> str:
    """One cosine whose weights are channel times chain weight."""
    lw = parse_lens(lens)
    return idf_cosine(a, b, [round(w * lw[i // 60], 12) for i, w in enumerate(weights)])


def idf_lens_chain(a: str, b: str, lens: str | tuple[float, ...] = "dedup", weights: Sequence[float] = STATIC_IDF) -> str:
    """A weighted cosine per chain, then the lens mean."""
    m = weight_masks(weights)
    return _average([(w, _over(_weighted(a, b, c, m), _weighted(a, a, c, m), _weighted(b, b, c, m))) for c, w in enumerate(parse_lens(lens))])



def _centered_parts(a: str, b: str, c: int, mask: int) -> tuple[str, str, str]:
    """Dot product and squared norms of the channels less one, under a mask.

    Zeros count -1 and twos +1. The zero plane is written without exclusive or,
    whose spelling differs between engines.
    """
    m = f" & {mask}"
    ones = lambda x: f"({x}p{c}{m})"
    twos = lambda x: f"({x}q{c}{m})"
    any_ = lambda x: f"(({x}p{c} | {x}q{c}){m})"
    n = mask.bit_count()
    zero_both = f"({n} - {bc(f'({any_(a)} | {any_(b)})')})"
    zero_two = lambda x, y: f"({bc(twos(y))} - {bc(f'{twos(y)} & {any_(x)}')})"
    num = f"({zero_both} + {bc(f'{twos(a)} & {twos(b)}')} - {zero_two(a, b)} - {zero_two(b, a)})"
    norm = lambda x: f"({n} - {bc(ones(x))})"
    return num, norm(a), norm(b)


def centered_cosine(a: str, b: str, chains: Sequence[int] = (0, 1, 2, 3), masks: Sequence[int] = (MASK60,) * 4) -> str:
    """Cosine of the channels less one, in -1..1; 0 where a norm is nil."""
    parts = [_centered_parts(a, b, c, masks[c]) for c in chains if masks[c]]
    if not parts:
        return "0.0e0"
    num, na, nb = (" + ".join(p[i] for p in parts) for i in range(3))
    return f"(CASE WHEN ({na}) = 0 OR ({nb}) = 0 THEN 0.0e0 ELSE ({num}) / (sqrt(CAST({na} AS DOUBLE)) * sqrt(CAST({nb} AS DOUBLE))) END)"


def linear_blend(a1: str, b1: str, a2: str, b2: str, alpha: float = 0.65, lens: str | tuple[float, ...] = "dedup") -> str:
    """First- and second-stage lens cosines mixed by one weight; 0 takes the second alone."""
    return f"({alpha!r}e0 * {lens_cosine(a1, b1, lens)} + {round(1 - alpha, 12)!r}e0 * {lens_cosine(a2, b2, lens)})"


def chain_blend(a1: str, b1: str, a2: str, b2: str, alpha: Sequence[float]) -> str:
    """Mean over chains of first- and second-stage centered cosines, mixed by ``alpha``."""
    mix = [f"({x!r}e0 * {centered_cosine(a1, b1, (c,))} + {1 - x!r}e0 * {centered_cosine(a2, b2, (c,))})" for c, x in enumerate(alpha)]
    return f"(({' + '.join(mix)}) / 4.0e0)"


def adaptive_blend(a1: str, b1: str, a2: str, b2: str, buckets: Sequence[float]) -> str:
    """Mix of the two stages whose weight is chosen by the decile of the flat cosine."""
    flat = flat_cosine(a1, b1)
    cases = " ".join(f"WHEN {i} THEN {x!r}e0" for i, x in enumerate(buckets))
    alpha = f"(CASE CAST(greatest(least(floor({flat} * 10), 9), 0) AS INT) {cases} END)"
    return f"({alpha} * {flat} + (1 - {alpha}) * {centered_cosine(a2, b2)})"
