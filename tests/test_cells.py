"""Cells of the ternary machine: tables, steps and adaptation, a row at a time."""

import itertools

from pyspark.sql import functions as F

from simdex.functions import cells


def test_the_tables_hold():
    assert cells.verify() == []
    assert cells.RANK == (0, 1, 1, 1, 2, 2, 2) and cells.PERMUTATIONS == (21, 5, 15, 19, 7, 11)
    for f, g in itertools.product(range(6), repeat=2):
        whole = cells.MAPS[cells.PERMUTATIONS[cells.COMPOSED[f][g]]]
        assert all(whole[x] == cells.MAPS[cells.PERMUTATIONS[f]][cells.MAPS[cells.PERMUTATIONS[g]][x]] for x in range(3))
    assert not cells.fits(1, (0, 21, 21)) and not cells.fits(2, (3, 21, 21)) and cells.fits(0, (0, 0, 0))


def test_steps_against_the_definition(spark):
    rows = [(k, d, s, t) for k, d, s, t in itertools.product(range(7), range(6), range(3), range(12))]
    made = [{**cells.canonical(k, d, (10, 11, 12)), "state": s, "tick": t} for k, d, s, t in rows]
    df = spark.createDataFrame(made, ", ".join(f"{c} int" for c in made[0]))
    df = df.withColumn("was", F.col("state")).withColumn("trit", cells.tape(F.col("domain"), F.col("tick")))
    got = cells.step(df, F.col("trit")).withColumn("left", cells.lowered_rank(F.lit(2), F.col("domain"), F.col("cell"))).collect()
    assert len(got) == len(rows)
    for r in got:
        trit = list(cells.TAPES.values())[r.domain][r.tick % len(list(cells.TAPES.values())[r.domain])]
        assert r.trit == trit and r.output == r.was and r.dst == 10 + r.was
        assert r.state == cells.MAPS[(cells.QUARKS[r.cell])[trit]][r.was] and r.left == cells.lowered(2, r.domain, r.cell)


def test_adaptive_cells(spark):
    made = [{**cells.canonical(4), "mode": m, "target": t, "limit": 3, "counter": c, "idle": False} for m, t, c in [(0, 6, 9), (1, 6, 1), (1, 6, 2), (2, 9, 2), (3, 6, 1), (3, 6, 2)]]
    df = spark.createDataFrame([{**r, "n": i} for i, r in enumerate(made)], ", ".join(f"{c} {'boolean' if c == 'idle' else 'int'}" for c in [*made[0], "n"]))
    got = [(r.cell, r["rank"], r.q0, r.mode, r.counter, r.idle) for r in cells.adapt(df).orderBy("n").collect()]
    assert got == [(4, 2, 21, 0, 9, False), (4, 2, 21, 1, 2, False), (6, 2, 7, 1, 0, False), (4, 2, 21, 2, 0, False), (4, 2, 21, 3, 2, False), (0, 0, 0, 0, 3, True)]
