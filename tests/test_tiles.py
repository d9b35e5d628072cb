"""Comparisons in tiles against the expressions over every pair, with blocks of a few rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from simdex.functions.encode import PLANES, add_planes
from simdex.operators import csidf, dedup, evalmetrics, fields, joins, route, tiles

BASE = ["connection timeout on server alpha", "user cannot log in to portal", "disk is nearly full on node seven", "payment was declined by the bank"]
TEXTS = [t for k, b in enumerate(BASE) for t in (b, b + " again", b, b.replace("e", "a"), f"case {k} " + b, b.upper())] + ["", "a", "", "zzz", "a", "aa"]


@pytest.fixture
def enc(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK", 7)
    monkeypatch.setattr(dedup, "FIRST_ROUND", 4)
    return add_planes(spark.createDataFrame([(3 * i, i % 4, t) for i, t in enumerate(TEXTS)], "id bigint, g int, text string")).drop("text").cache()


def every(enc, lens="dedup", calibrate=False):
    rows = enc.alias("a").join(enc.alias("b"), F.expr("a.id <> b.id"))
    return {(r.i, r.j): r.s for r in rows.select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.expr(joins.score(lens, calibrate)).alias("s")).collect()}


@pytest.mark.parametrize("lens,calibrate", [("dedup", False), ("flat", False), ("dedup", True), ((0.0, 1.0, 0.0, 2.0), False)])
def test_pairs_at_a_threshold_that_a_pair_has_exactly(enc, lens, calibrate):
    sims = every(enc, lens, calibrate)
    for t in (sorted(sims.values())[len(sims) // 2], 0.6, 1.0):
        want = {p: s for p, s in sims.items() if p[0] < p[1] and s >= t}
        assert {(r.i, r.j): r.similarity for r in joins.pairs(enc, "id", t, lens, calibrate).collect()} == want


def test_counts_and_linked_rows_without_the_pairs(enc, monkeypatch):
    sims = every(enc)
    monkeypatch.setattr(joins, "pairs", None)  # the pairs themselves are not to be made
    ts = [sorted(sims.values())[len(sims) // 3], 0.5, 0.75]
    want = {t: sum(s >= t for (i, j), s in sims.items() if i < j) for t in ts}
    assert {r.threshold: r.n for r in tiles.counts(enc, tiles.Measure(), ts).collect()} == want
    assert {r.id for r in tiles.linked(enc, tiles.Measure(), ts[0]).collect()} == {i for (i, j), s in sims.items() if s >= ts[0]}
    row = dedup.batch_summary(enc, "id", 0.75).first()
    assert (row.lines, row.pair_count) == (len(TEXTS), want[0.75])
    assert route.recall(enc, "id", 0.75).first().brute_duplicates == len({i for (i, j), s in sims.items() if s >= 0.75})
    known = {3 * i for i in range(len(TEXTS)) if i % 3 == 1}
    of = {3 * i: i % 4 for i in range(len(TEXTS))}
    false = sum(s >= 0.5 for (i, j), s in sims.items() if i < j and i not in known and j not in known and of[i] != of[j])
    best = {k: max((s, -j) for (i, j), s in sims.items() if i == k) for k in known}
    false += sum(s >= 0.5 and of[k] != of[-j] for k, (s, j) in best.items())
    got = evalmetrics.dedup_sweep(enc.withColumn("dup", F.col("id") % 9 == 3), "id", "g", "dup", [0.5]).first()
    assert (got.fp, got.tp + got.fn + sum(s >= 0.5 and of[k] != of[-j] for k, (s, j) in best.items())) == (false, len(known))


@pytest.mark.parametrize("which", ["other", "before"])
def test_best_rows_ties_and_rows_without_a_channel(enc, which):
    sims = every(enc)
    both = tiles.likely_best(enc.select("id", *PLANES), enc.select("id", *PLANES), tiles.Measure(), which)
    got = joins.best(both.select(F.col("a.id").alias("id"), F.col("b.id").alias("ref_id"), F.expr(joins.score()).alias("similarity")))
    want = {}
    for (i, j), s in sims.items():
        if which == "other" or j < i:
            want[i] = max(want.get(i, (-1.0, 0)), (s, -j))
    assert {r.id: (r.similarity, -r.match_id) for r in got.collect()} == want


def test_a_scan_in_rounds_makes_no_pairs(enc, monkeypatch):
    sims = every(enc)
    monkeypatch.setattr(joins, "pairs", None)
    kept, want = [], {}
    for j in sorted({i for i, _ in sims}):
        hits = [(sims[j, i], -i) for i in kept if sims[j, i] >= 0.6]
        if hits:
            want[j] = -max(hits)[1]
        else:
            kept.append(j)
    assert {r.id: r.match_id for r in dedup.scan(enc, "id", 0.6).collect() if r.is_duplicate} == want
    s = dedup.summary(enc, "id", 0.6).first()
    near = [max(sims[j, i] for i in kept if i < j) for j in sorted({i for i, _ in sims}) if kept[0] < j]
    assert (s.kept, s.duplicates) == (len(kept), len(want)) and abs(s.mean_similarity - sum(near) / len(near)) < 1e-9


@pytest.mark.parametrize("idf", [False, True])
def test_fields_in_tiles(spark, monkeypatch, idf):
    monkeypatch.setattr(tiles, "BLOCK", 7)
    cfg = fields.FieldConfig(("title", "body"), (1.0, 0.8), "body")
    rows = spark.createDataFrame([(i, t, TEXTS[(i * 5) % len(TEXTS)]) for i, t in enumerate(TEXTS)], "id bigint, t string, b string")
    e = fields.field_vectors(fields.encode_fields(rows, cfg, {"title": "t", "body": "b"}), cfg, "id").cache()
    expr = fields.field_cosine(cfg, idf)
    pick = lambda df: {(r.i, r.j): r.s for r in df.select(F.least("a.id", "b.id").alias("i"), F.greatest("a.id", "b.id").alias("j"), F.expr(expr).alias("s")).where("s >= 0.4").collect()}
    want = pick(e.alias("a").join(e.alias("b"), F.expr("a.id < b.id")))
    assert want and pick(tiles.likely_pairs(e, fields.measure(cfg, idf), 0.4)) == want


@pytest.mark.parametrize("not_self", [False, True])
def test_routing_compares_where_buckets_are(spark, monkeypatch, not_self):
    """Against the candidates as a table, with a cap that cuts, a hot bucket and a repeated row."""
    monkeypatch.setitem(route.MODES, "fast", ((0,), 7))
    rows = [(i, "one hot line that all share" if i % 3 else f"line number {i % 11}") for i in range(90)]
    e = add_planes(spark.createDataFrame(rows, "id bigint, text string")).drop("text").cache()
    pairs = route.candidates(e, "id", e, "id", "fast", not_self).cache()
    want = {tuple(r) for r in joins.best(route.rescored(pairs, e, "id", e, "id", joins.score())).collect()}
    asked = e.unionByName(e.where("id < 5"))
    monkeypatch.setattr(route, "candidates", None)
    monkeypatch.setattr(route, "rescored", None)
    assert {tuple(r) for r in route.nearest_routed(asked, "id", e, "id", "dedup", "fast", not_self=not_self).collect()} == want
    if not not_self:
        monkeypatch.setattr(route, "BRUTE_FORCE_BELOW", 0)
        counts = {r["id"]: r["count"] for r in pairs.groupBy("id").count().collect()}
        assert {r.id: r.candidates_checked for r in route.query_stats(e, "id", e, "id", "fast").collect()} == counts
        weights = [0.01 + i / 240 for i in range(240)]
        flat = e.select(F.col("id"), *PLANES).join(pairs, "id").join(e.select(F.col("id").alias("ref_id"), *(F.col(p).alias(f"{p}_b") for p in PLANES)), "ref_id")
        best = {r.id: r.similarity for r in joins.best(csidf.score_pairs(flat, np.array(weights), "dedup")).collect()}
        assert {r.id: r.similarity for r in route.query_weighted(e, "id", e, "id", np.array(weights), 0.9, "dedup", "fast").collect()} == pytest.approx(best)
