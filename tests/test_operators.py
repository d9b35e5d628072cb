import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from simdex.functions import encode
from simdex.functions import similarity as S
from simdex.functions.lens import LENSES
from simdex.operators import csidf, dedup, evalmetrics, fields, joins, route, stage2
from simdex.sources import readers
from simdex.streaming.scan import stream_scan

BASE = ["connection timeout on server alpha", "user cannot log in to portal", "disk is nearly full on node seven", "payment was declined by the bank", "the report did not render at all"]
TEXTS = [t for k, b in enumerate(BASE) for t in (b, b + " again", b.upper(), b.replace("e", "a"), f"case {k} " + b)] + ["", "zzz"]


def sim(a, b, lens="dedup"):
    x, y = (encode.encode_text(t).astype(float).reshape(4, 60) for t in (a, b))
    w = np.array(LENSES[lens])
    n = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    return float((np.where(n > 0, (x * y).sum(1) / np.where(n > 0, n, 1), 0) * w).sum() / w.sum())


PAIRS = {(i, j): sim(TEXTS[i], TEXTS[j]) for i, j in itertools.combinations(range(len(TEXTS)), 2)}


@pytest.fixture(scope="module")
def enc(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string")
    return encode.add_planes(df).drop("text").cache()


def greedy(t):
    kept, out = [], {}
    for j in range(len(TEXTS)):
        hits = [(PAIRS[i, j], -i) for i in kept if PAIRS[i, j] >= t]
        if hits:
            out[j] = -max(hits)[1]
        else:
            kept.append(j)
    return out


@pytest.mark.parametrize("t", [0.5, 0.75])
def test_pairs(enc, t):
    got = {(r.i, r.j): r.similarity for r in joins.pairs(enc, "id", t).collect()}
    want = {p: s for p, s in PAIRS.items() if s >= t}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


@pytest.mark.parametrize("t", [0.4, 0.5, 0.6, 0.75])
def test_scan_is_the_sequential_loop(enc, t):
    got = {r.id: r.match_id for r in dedup.scan(enc, "id", t).collect() if r.is_duplicate}
    assert got == greedy(t)


def test_rounds_against_loop_on_random_graphs(spark):
    rng = np.random.default_rng(0)
    for _ in range(4):
        edges = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 25, (30, 2)).tolist() if a != b}
        gone = set()
        for j in range(25):
            if any(i not in gone for i, k in edges if k == j):
                gone.add(j)
        df = spark.createDataFrame(sorted(edges), "i bigint, j bigint")
        assert {r.id for r in dedup.dropped(df).collect()} == gone


def test_scan_summary_and_index(enc):
    t = 0.6
    dup = greedy(t)
    row = dedup.summary(enc, "id", t).first()
    assert (row.total, row.duplicates, row.kept, row.clusters) == (len(TEXTS), len(dup), len(TEXTS) - len(dup), len(set(dup.values())))
    index, rest = enc.where("id % 5 = 0"), enc.where("id % 5 <> 0")
    ids = [i for i in range(len(TEXTS)) if i % 5]
    new = []
    for j in ids:
        if not any(PAIRS[min(i, j), max(i, j)] >= t for i in [*range(0, len(TEXTS), 5), *new]):
            new.append(j)
    got = dedup.append(rest, "id", index, "id", t).collect()
    assert sorted(r.id for r in got if r.is_new) == new and len(got) == len(new) + len(range(0, len(TEXTS), 5))


def test_clusters_follow_best_earlier_rows(enc):
    t, up = 0.55, {}
    for j in range(len(TEXTS)):
        hits = [(PAIRS[i, j], -i) for i in range(j) if PAIRS[i, j] >= t]
        if hits:
            up[j] = -max(hits)[1]

    def root(x):
        while x in up:
            x = up[x]
        return x

    want = {}
    for j in up:
        want.setdefault(root(j), []).append(j)
    assert {r.canonical: r.members for r in dedup.clusters(enc, "id", t).collect()} == want


def test_nearest_topk_semi_anti(enc):
    a, b = enc.where("id >= 10"), enc.where("id < 10")
    for r in joins.nearest(a, "id", b, "id", 0.6).collect():
        want = max((PAIRS[i, r.id], -i) for i in range(10))
        assert (r.match_id, r.is_duplicate) == (-want[1], want[0] >= 0.6)
    top = joins.top_k(a, "id", b, "id", 3, "dedup").where("id = 12").orderBy("rank").collect()
    assert [r.ref_id for r in top] == [-i for _, i in sorted(((PAIRS[i, 12], -i) for i in range(10)), reverse=True)[:3]]
    like = {j for j in range(10, len(TEXTS)) if any(PAIRS[i, j] >= 0.3 for i in range(10))}
    assert {r.id for r in joins.similar_to_any(a, "id", b, "id", 0.3).collect()} == like
    assert {r.id for r in joins.similar_to_any(a, "id", b, "id", 0.3, anti=True).collect()} == set(range(10, len(TEXTS))) - like
    both = {(r.id, r.ref_id) for r in joins.pairs_with_reference(a, "id", b, "id", 0.3).collect()}
    assert both == {(j, i) for i in range(10) for j in range(10, len(TEXTS)) if PAIRS[i, j] >= 0.3}


def test_empty_tables(enc):
    none = enc.limit(0)
    assert joins.pairs(none, "id", 0.5).count() == dedup.scan(none, "id", 0.5).count() == dedup.clusters(none, "id", 0.5).count() == 0
    assert dedup.summary(none, "id", 0.5).first().total == 0 and route.candidates(none, "id", enc, "id").count() == 0


def test_band_buckets():
    want = {"a": [175, 1717, 2744, 1311], "hello world": [60, 2531, 4053, 2077], "the quick brown fox": [3884, 1568, 2407, 3772], "café": [1956, 2993, 2236, 276]}
    for text, buckets in want.items():
        assert route.band_hash(encode.encode_text(text)[None])[0].tolist() == buckets


def test_routing_finds_copies(spark, enc):
    got = {(r.id, r.ref_id) for r in route.candidates(enc, "id", enc, "id", "strict", not_self=True).collect()}
    same = {(i, j) for (i, j), s in PAIRS.items() if s > 0.9999999}
    assert same <= got
    small = route.query(enc, "id", enc.where("id < 3"), "id", 0.6).collect()
    assert len(small) == len(TEXTS)


def test_corpus_weights(enc):
    x = np.stack([encode.encode_text(t) for t in TEXTS]).astype(float)
    df = (x > 0).sum(0)
    freq = csidf.document_frequency(enc.repartition(3))
    assert [r.df for r in freq.orderBy("channel").collect()] == df.tolist()
    raw = np.log2(len(TEXTS) / (1 + df))
    assert np.allclose(csidf.collect_weights(freq), np.maximum(raw / raw.max(), 0.01))
    merged = csidf.merge(csidf.document_frequency(enc.where("id < 5")), csidf.document_frequency(enc.where("id >= 5")))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, freq.collect()))
    assert (csidf.collect_weights(csidf.document_frequency(enc.limit(0))) == 1).all()


def test_fields(spark):
    cfg = fields.parse_fields("title,body", "title=2")
    assert cfg.weights == (2.0, 1.0) and cfg.route == "body"
    with pytest.raises(ValueError):
        fields.parse_fields("a", "b=1")
    lines = [json.dumps({"id": "x", "title": "the cat", "body": "sat \\ \u00e9"}), json.dumps({"text": "only text"}), "not json"]
    rows = fields.from_json(spark.createDataFrame([(x,) for x in lines], "line string"), fields.FieldConfig(), "line").collect()
    assert [(r.tag, r.title, r.body) for r in rows] == [("x", "the cat", "sat \\ é"), (None, None, "only text"), (None, None, None)]
    df = spark.createDataFrame([(1, "the cat", "sat on it"), (2, "the cat", "ran away")], "id int, t string, b string")
    e = fields.encode_fields(df, cfg, {"title": "t", "body": "b"})
    got = e.alias("a").join(e.alias("b"), F.expr("a.id = 1 and b.id = 2")).select(F.expr(fields.field_cosine(cfg))).first()[0]
    assert abs(got - (2 * sim("the cat", "the cat", "uniform") + sim("sat on it", "ran away", "uniform")) / 3) < 1e-9


def test_projections_against_loops():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (4, 240)).astype(np.uint8)
    w = stage2.random_projection(9)
    sign = np.array([0, -1, 1])

    def vote(rows):
        return [b if b == c and a != b else a for a, b, c in zip(*rows)]

    for mode, one in {
        "mod3": lambda wk, v: [sum(int(a) * int(b) for a, b in zip(r, v)) % 3 for r in wk],
        "sign": lambda wk, v: [int(np.sign(sum((int(a) - 1) * (int(b) - 1) for a, b in zip(r, v)))) + 1 for r in wk],
        "sparse": lambda wk, v: [int(np.sign(sum(int(sign[a]) * (int(b) - 1) for a, b in zip(r, v)))) + 1 for r in wk],
    }.items():
        assert stage2.project(x[:1], w, mode)[0].tolist() == vote([one(wk, x[0]) for wk in w])
    blocks = stage2.random_blocks(5)
    want = [vote([[sum(int(a) * int(b) for a, b in zip(r, x[1][60 * c : 60 * c + 60])) % 3 for r in wk[c]] for wk in blocks]) for c in range(4)]
    assert stage2.project(x[1:2], blocks, "block")[0].tolist() == [v for c in want for v in c]
    assert (stage2.project(x, stage2.identity_projection()) == x).all() and (stage2.project(x, stage2.identity_blocks(), "block") == x).all()


def test_cascade_and_depths(spark, enc):
    x = np.stack([encode.encode_text(t) for t in TEXTS])
    for kind in ("random", "layered", "local"):
        c = stage2.topology(kind, 50, 3)
        out = x[0].astype(int).copy()
        for e, s, d in zip(c.endo, c.src, c.dst):
            out[d] += stage2.ENDO[e][x[0][s]]
        assert (c.tick(x[:1])[0] == out % 3).all()
    model = stage2.Model.random(64, 5)
    rows = stage2.encode_depths(enc, "id", model, 3).where("id = 1").orderBy("depth").collect()
    for r in rows:
        got = encode.trits_of(np.array([[r[p] for p in encode.PLANES]]))[0]
        assert (got == model.encode(x[1:2], r.depth)[0]).all()
    assert (stage2.Model.identical().encode(x, 5) == x).all()
    planes = stage2.gate_planes(stage2.Model(stage2.random_projection(8), "diagonal"))
    got = enc.select("id", *(c.alias(n) for n, c in planes.items())).orderBy("id").collect()
    want = stage2.project(x, stage2.random_projection(8), "diagonal")
    assert (encode.trits_of(np.array([[r[p] for p in encode.PLANES] for r in got])) == want).all()


def test_hebbian_training(spark, enc, tmp_path):
    e = enc.alias("a").join(enc.alias("b"), F.expr("b.id = a.id + 1"))
    rows = e.select(F.expr(S.lens_cosine("a.", "b.", "uniform")).alias("s"), F.col("a.id").alias("id"), *(F.col(f"a.{p}") for p in encode.PLANES), *(F.col(f"b.{p}").alias(f"{p}_b") for p in encode.PLANES))
    cfg = stage2.HebbianConfig(threshold=0.5, weighted=True)
    rows = rows.withColumn("w", stage2.signed_magnitude(F.col("s"), cfg))
    x = np.stack([encode.encode_text(t) for t in TEXTS]).astype(int) - 1
    want = np.zeros((240, 240), int)
    for i in range(len(TEXTS) - 1):
        d = sim(TEXTS[i], TEXTS[i + 1], "uniform") - 0.5
        want += (1 + int(d * 10) if d > 0 else -(1 + int(-d * 3))) * np.outer(x[i + 1], x[i])
    acc = stage2.accumulate(rows, "w").cache()
    got = np.zeros((240, 240), int)
    for r in acc.collect():
        got[r.i, r.j] = r.counter
    assert (got == want).all()
    t = stage2.auto_threshold(acc, 0.15).first()[0]
    most = int(0.15 * want.size)
    assert (abs(want) > t).sum() <= most and (t == 0 or (abs(want) > t - 1).sum() > most)
    frozen = stage2.freeze(acc, t)
    assert stage2.freeze_stats(frozen).first().positive == (want > t).sum()
    sparse = stage2.freeze_sparse(acc, 5).groupBy("i").agg(F.count_if(F.col("weight") != 0).alias("n")).collect()
    assert max(r.n for r in sparse) <= 5
    assert stage2.accumulate(rows, "w", blocks=True).count() == 4 * 3600
    model = stage2.train(rows.drop("w"), "s", cfg, schedule=(0.5, 0.6), rounds=1)
    model.alpha = tuple([0.5] * 10)
    model.save(spark, str(tmp_path / "m"))
    back = stage2.Model.load(spark, str(tmp_path / "m"))
    assert (back.projection == model.projection).all() and back.alpha == model.alpha and back.mode == "diagonal"
    weighted = stage2.source_weight(rows.withColumn("source", F.lit("q")), {"q": 3.0}, magnitude="w")
    assert weighted.agg(F.sum("w")).first()[0] == 3 * rows.agg(F.sum("w")).first()[0]
    assert {r.counter for r in stage2.unfreeze(frozen, 7).select("counter").distinct().collect()} <= {-7, 0, 7}


def test_metrics(spark):
    rows = [(1.0, 2.0, True), (2.0, 1.0, False), (2.0, 3.0, True), (4.0, 4.0, True)]
    df = spark.createDataFrame(rows, "x double, y double, t boolean")
    d2 = (1 - 2) ** 2 + (2.5 - 1) ** 2 + (2.5 - 3) ** 2
    assert abs(evalmetrics.spearman(df, "x", "y").first().rho - (1 - 6 * d2 / 60)) < 1e-12
    r = evalmetrics.threshold_sweep(df, "x", "t", [2.0]).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 1) and abs(r.f1 - 2 / 3) < 1e-12
    assert evalmetrics.mean_absolute_error(df, "x", "y").first().mae == 0.75
    assert evalmetrics.latency_percentiles(df, "x").first().p50 == 2.0


def test_adaptive_alpha_against_grid(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), float(g)) for a, b, g in np.round(rng.random((60, 3)), 4)]
    got = {r.bucket: r.alpha for r in evalmetrics.adaptive_alpha(spark.createDataFrame([*rows, (1.0, 0.0, 0.0)], "s1 double, s2 double, g double"), "s1", "s2", "g").collect()}

    def rho(x, y):
        rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
        d = rank(x) - rank(y)
        return 1 - 6 * (d * d).sum() / (len(x) * (len(x) ** 2 - 1))

    for b in range(10):
        own = np.array([r for r in rows if int(r[0] * 10) == b])
        if len(own) < 3:
            assert got[b] == 0.5
        else:
            scores = [round(rho(np.round(k / 10 * own[:, 0] + (1 - k / 10) * own[:, 1], 9), own[:, 2]), 12) for k in range(11)]
            assert got[b] == int(np.argmax(scores)) / 10


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\r\nthree\n")
    (tmp_path / "b.jsonl").write_text('\n{"id": "k", "text": "one \\u00e9"}\n{"text": ""}\n{"text": "two"}\n')
    got = readers.read_documents(spark, str(tmp_path / "a.txt")).orderBy("line").collect()
    assert [(r.line, r.text) for r in got] == [(0, "one"), (1, "two"), (2, "three")]
    got = readers.read_documents(spark, str(tmp_path / "b.jsonl")).orderBy("line").collect()
    assert [(r.id, r.text) for r in got] == [("k", "one é"), ("1", "two")]
    (tmp_path / "p.jsonl").write_text('{"text_a": "x", "text_b": "y", "score": 0.5, "label": "neutral", "source": "sts"}\n{"text_a": "", "text_b": "y"}\n')
    pairs = readers.read_pairs(spark, str(tmp_path / "p.jsonl"))
    assert pairs.count() == 1 and evalmetrics.validate_pairs(pairs).first().bad_score == 0
    body = spark.createDataFrame([('{"documents": [{"text": "a", "tag": "t"}, {"text": "b"}]}',)], "body string")
    assert [tuple(r) for r in readers.explode_documents(body, "body").collect()] == [(0, "a", "t"), (1, "b", None)]
    index = readers.build_index(spark.createDataFrame([(1, "x", "t")], "id int, text string, tag string"), "id", tag="tag")
    readers.save_index(index, str(tmp_path / "i"), threshold=0.6, lens="dedup")
    back, cfg = readers.load_index(spark, str(tmp_path / "i"))
    assert back.count() == 1 and cfg == {"lens": "dedup", "threshold": 0.6}
    s = spark.createDataFrame([(3.0, "entailment")], "s double, l string")
    assert s.select(readers.score_prepared("sick", F.col("s")), readers.label_of(F.lit(0.45)), readers.snli_score(F.col("l"))).first()[:] == (0.5, "neutral", 1.0)


def test_split_shares(spark):
    out = evalmetrics.stratified_split(spark.range(200).withColumn("source", F.col("id") % 2), "id", "source")
    assert {(r.source, r.split): r["count"] for r in out.groupBy("source", "split").count().collect()} == {(s, k): n for s in (0, 1) for k, n in (("train", 70), ("validation", 15), ("test", 15))}


def test_stream_scan_is_the_batch_scan(spark, tmp_path):
    src = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if i % 3 == k], "id bigint, text string").coalesce(1).write.mode("append").parquet(str(src))
    spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string").coalesce(1).write.mode("overwrite").parquet(str(src))
    stream = spark.readStream.schema("id bigint, text string").parquet(str(src))
    writer = stream_scan(stream, str(tmp_path / "index"), str(tmp_path / "out"), str(tmp_path / "cp"), threshold=0.6)
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(120)
    dup = greedy(0.6)
    got = {r.id: r.match_id for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.is_duplicate}
    assert got == dup and spark.read.parquet(str(tmp_path / "index")).count() == len(TEXTS) - len(dup)
    spark.createDataFrame([(100, TEXTS[0]), (101, "entirely new words here")], "id bigint, text string").coalesce(1).write.mode("append").parquet(str(src))
    writer.trigger(availableNow=True).start().awaitTermination(120)
    last = {r.id: r.is_duplicate for r in spark.read.parquet(str(tmp_path / "out")).where("id >= 100").collect()}
    assert last == {100: True, 101: False}
