"""Cells of the ternary machine: maps of {0,1,2}, ranks, and one step as column expressions.

A cell is a row with ``cell, rank, domain, state, q0..q2`` (state maps by input
trit), ``o0..o2`` (output maps) and ``e0..e2`` (a destination by output trit, null
where there is none). All tables follow from their definitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Map ``e`` sends ``x`` to digit ``x`` of ``e`` in base 3.
MAPS = tuple(tuple(e // 3**x % 3 for x in range(3)) for e in range(27))
#: How many values a map has: 1 a constant, 3 a permutation.
IMAGE = tuple(len(set(m)) for m in MAPS)
IDENTITY = MAPS.index((0, 1, 2))
#: The six permutations: identity, three swaps (0-2, 1-2, 0-1), two rotations.
PERMUTATIONS = tuple(MAPS.index(m) for m in ((0, 1, 2), (2, 1, 0), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1)))
#: ``COMPOSED[f][g]``: the permutation that applies ``g``, then ``f``.
COMPOSED = tuple(tuple(PERMUTATIONS.index(MAPS.index(tuple(MAPS[f][MAPS[g][x]] for x in range(3)))) for g in PERMUTATIONS) for f in PERMUTATIONS)

KILLED, LOSSY, CLOSED = 0, 1, 2
#: Kinds of cell with the map that fires at trit 0; at 1 and 2 all but the null cell keep their state.
CELLS = {"null": (0, 0, 0), "collapse": (0, 0, 1), "split": (0, 1, 0), "oscillator": (1, 0, 0), "identity": (0, 1, 2), "swap": (2, 1, 0), "rotate": (1, 2, 0)}
NAMES = tuple(CELLS)
QUARKS = tuple((MAPS.index(m),) + ((0, 0) if n == "null" else (IDENTITY, IDENTITY)) for n, m in CELLS.items())
RANK = tuple(IMAGE[q[0]] - 1 for q in QUARKS)
#: Input trits by clock domain, repeated.
TAPES = {"cyclic": (0, 1, 2), "constant": (0,), "alternating": (0, 1), "reversed": (2, 1, 0), "binary": (0, 1), "io": (0,)}
DOMAINS = tuple(TAPES)


def lowered(rank: int, domain: int, source: int) -> int:
    """The rank that is left after a signal from a cell of kind ``source``: never more than before.

    A collapse in the constant domain kills.
    """
    return KILLED if DOMAINS[domain] == "constant" and NAMES[source] == "collapse" else min(rank, RANK[source])


def fits(rank: int, quarks: tuple[int, ...]) -> bool:
    """Whether the state maps may stand at a rank: permutations anywhere, constants only in a dead cell."""
    return all(rank == KILLED or IMAGE[q] - 1 >= rank for q in quarks)


def _lookup(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def image(e: Column, x: Column) -> Column:
    """Map ``e`` of ``x``."""
    return _lookup([v for m in MAPS for v in m], e * 3 + x)


def tape(domain: Column, tick: Column) -> Column:
    """Input trit of a domain at a tick."""
    return _lookup([t[k % len(t)] for t in TAPES.values() for k in range(6)], domain * 6 + tick % 6)


def lowered_rank(rank: Column, domain: Column, source: Column) -> Column:
    table = [lowered(r, d, s) for r in range(3) for d in range(len(DOMAINS)) for s in range(len(NAMES))]
    return _lookup(table, (rank * len(DOMAINS) + domain) * len(NAMES) + source)


def _by_trit(trit: Column, *three: Column) -> Column:
    return F.when(trit == 0, three[0]).when(trit == 1, three[1]).otherwise(three[2])


def step(df: DataFrame, trit: Column) -> DataFrame:
    """``df`` after one step: ``output`` and ``dst`` of the state before, and the new ``state``."""
    cols = [[F.col(f"{c}{k}") for k in range(3)] for c in "qoe"]
    out = image(_by_trit(trit, *cols[1]), F.col("state"))
    new = df.withColumns({"output": out, "__next": image(_by_trit(trit, *cols[0]), F.col("state"))})
    return new.withColumn("dst", _by_trit(F.col("output"), *cols[2])).withColumn("state", F.col("__next")).drop("__next")


#: Modes of adaptive cells.
ADAPT = {"none": 0, "lumen": 1, "crystallize": 2, "decay": 3}


def adapt(df: DataFrame) -> DataFrame:
    """``df`` after the adaptive part of a step, by ``mode, target, limit, counter``.

    The counter rises by one a step. At the limit lumen and crystallize make the
    canonical cell of the target kind and start anew; decay makes a null cell, idle, once.
    """
    mode, count = F.col("mode"), (F.col("counter") + 1) % 65536
    due = (mode > 0) & (count >= F.col("limit"))
    kind = F.when(due & (mode == 3), 0).when(due & mode.isin(1, 2) & F.col("target").between(0, 6), F.col("target"))
    made = {"cell": F.coalesce(kind, F.col("cell")), "rank": F.when(kind.isNotNull(), _lookup(list(RANK), kind)).otherwise(F.col("rank"))}
    for k in range(3):
        made[f"q{k}"] = F.when(kind.isNotNull(), _lookup([q[k] for q in QUARKS], kind)).otherwise(F.col(f"q{k}"))
        made[f"o{k}"] = F.when(kind.isNotNull(), IDENTITY).otherwise(F.col(f"o{k}"))
    made["idle"] = F.when(due & (mode == 3), True).otherwise(F.col("idle"))
    made["counter"] = F.when(due & mode.isin(1, 2), 0).when(mode > 0, count).otherwise(F.col("counter"))
    made["mode"] = F.when(due & (mode == 3), 0).otherwise(mode)
    return df.withColumns(made)


def canonical(kind: int, domain: int = 0, edges: tuple[int | None, int | None, int | None] = (None, None, None)) -> dict:
    """The canonical cell of a kind as a row."""
    row = {"cell": kind, "rank": RANK[kind], "domain": domain, "state": 0}
    for k in range(3):
        row |= {f"q{k}": QUARKS[kind][k], f"o{k}": IDENTITY, f"e{k}": edges[k]}
    return row


def spin(g: tuple[int, ...]) -> int:
    """Length of the longest cycle of a map that isn't a fixed point; 0 without one."""
    best = 0
    for s in range(3):
        seen = [s]
        while g[seen[-1]] not in seen:
            seen.append(g[seen[-1]])
        if g[seen[-1]] == s and len(seen) > 1:
            best = max(best, len(seen))
    return best


def verify() -> list[str]:
    """The invariants that do not hold; none does fail."""
    under = lambda q: tuple(MAPS[q[2]][MAPS[q[1]][MAPS[q[0]][s]]] for s in range(3))
    checks: dict[str, Callable[[], bool]] = {
        "maps are closed and distinct": lambda: len(set(MAPS)) == 27 and {v for m in MAPS for v in m} == {0, 1, 2},
        "three constants, eighteen lossy maps, six permutations": lambda: [IMAGE.count(k) for k in (1, 2, 3)] == [3, 18, 6],
        "compositions of permutations are a Latin square": lambda: all(sorted(r) == list(range(6)) for r in (*COMPOSED, *zip(*COMPOSED))),
        "rank never rises": lambda: all(lowered(r, d, s) <= r for r in range(3) for d in range(6) for s in range(7)),
        "dynamics have the cell's rank": lambda: all(len(set(under(q))) - 1 == r for q, r in zip(QUARKS, RANK)),
        "dynamics have the cell's spin": lambda: [spin(under(q)) for q in QUARKS] == [0, 0, 0, 2, 0, 2, 3],
        "canonical cells fit their rank": lambda: all(fits(r, q) for q, r in zip(QUARKS, RANK)),
    }
    return [name for name, holds in checks.items() if not holds()]
