"""Stored indexes and counters, dataset readers, outputs, bounded buckets, generators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from simdex import api
from simdex.functions import codec, generate
from simdex.functions.encode import add_planes
from simdex.operators import csidf, evalmetrics, fields, route, stage2
from simdex.operators.storage import shared_dir
from simdex.sources import readers

TEXTS = ["the quick brown fox", "a lazy dog sleeps", "THE QUICK BROWN FOX", "an error in the server", ""]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string")


def test_an_index_is_replaced_in_one_step(spark, docs, tmp_path):
    path = f"file://{tmp_path}/index"
    index = api.Index.build(docs, "id", threshold=0.9, lens=(1, 0.5, 0.2, 0.1), calibrate=False)
    index.save(path)
    old = api.Index.load(spark, path)
    old.add(index).save(path)  # to where it was read from
    assert old.count() == 5 and api.Index.load(spark, path).count() == 10
    back = api.Index.load(spark, path)
    assert (back.threshold, back.lens, back.calibrate) == (0.9, (1, 0.5, 0.2, 0.1), False)
    index.save(path)
    versions = [p.name for p in (tmp_path / "index").iterdir() if p.is_dir()]
    assert len(versions) == 2 and not [p for p in (tmp_path / "index").iterdir() if p.name.startswith(".v-")]


def test_a_damaged_index_is_refused(spark, docs, tmp_path):
    api.Index.build(docs, "id").save(str(tmp_path / "i"))
    meta = json.loads((tmp_path / "i" / "CURRENT.json").read_text())
    where = str(tmp_path / "i" / meta["version"])
    rows = spark.read.parquet(where).collect()
    spark.createDataFrame([(*r[:-1], 1.0) for r in rows], spark.read.parquet(where).schema).write.mode("overwrite").parquet(where)
    with pytest.raises(ValueError, match="checksum"):
        api.Index.load(spark, str(tmp_path / "i"))
    assert readers.load_index(spark, str(tmp_path / "i"), verify=False)[0].count() == 5


def test_a_router_keeps_mode_weights_and_fields(spark, docs, tmp_path):
    router = api.Router.build(docs, "id", threshold=0.8).set_recall("strict").enable_weights()
    router.save(str(tmp_path / "r"))
    back = api.Router.load(spark, str(tmp_path / "r"))
    assert back.mode == "strict" and np.allclose(back.weights, router.weights) and back.add(router).mode == "strict"
    assert {r.id for r in back.query_weighted(router.rows, "id").collect() if r.is_duplicate} == {0, 1, 2, 3}
    cfg = fields.FieldConfig(("title", "body"), (1.0, 0.5), "title")
    rows = fields.encode_fields(docs.withColumn("body", F.lit("same body")), cfg, {"title": "text", "body": "body"})
    held = fields.field_vectors(rows, cfg, "id")
    router = api.FieldRouter(held, threshold=0.9).with_fields(cfg)
    router.save(str(tmp_path / "f"))
    back = api.FieldRouter.load(spark, str(tmp_path / "f"))
    assert back.fields == cfg
    got = {r.id: r for r in back.query(held, "id").collect()}
    assert got[2].match_id == 0 and got[1].match_id == 1 and got[0].similarity == pytest.approx(1)


def test_bounded_buckets_give_the_same_candidates(spark, monkeypatch):
    monkeypatch.setitem(route.MODES, "fast", ((0,), 7))
    rows = spark.createDataFrame([(i, "one hot line that all share" if i % 3 else f"line number {i % 11}") for i in range(120)], "id bigint, text string")
    e = add_planes(rows).drop("text").cache()
    ask = [tuple(r) for r in route.band_keys(e, "id", (0,)).collect()]
    have = {}
    for i, band, bucket, probe in ask:
        if probe == 0:
            have.setdefault((band, bucket), []).append(i)
    for not_self in (False, True):
        want = set()
        for i in range(120):
            seen = []
            for _, band, probe, bucket in sorted((a, b, p, k) for a, b, k, p in ask if a == i):
                seen += [j for j in sorted(have.get((band, bucket), [])) if j not in seen and not (not_self and j == i)]
            want |= {(i, j) for j in seen[:7]}
        assert {tuple(r) for r in route.candidates(e, "id", e, "id", "fast", not_self).collect()} == want


def test_counters_are_kept_and_checked(spark, tmp_path):
    acc = spark.createDataFrame([(0, 0, 5), (239, 3, -7)], "i int, j int, counter bigint")
    cfg = stage2.HebbianConfig(0.7, True, 9.0, 2.0, 0.2)
    stage2.save_accumulator(acc, str(tmp_path / "a"), cfg)
    back, got = stage2.load_accumulator(spark, str(tmp_path / "a"))
    assert got == cfg and sorted(map(tuple, back.collect())) == [(0, 0, 5), (239, 3, -7)]
    for bad in ([(240, 0, 1)], [(0, 0, 1), (0, 0, 2)], [(0, 0, 1 << 40)], [(None, 0, 1)]):
        stage2.save_accumulator(spark.createDataFrame(bad, "i int, j int, counter bigint"), str(tmp_path / "b"), cfg)
        with pytest.raises(ValueError):
            stage2.load_accumulator(spark, str(tmp_path / "b"))
    api.Index.build(spark.createDataFrame([(1, "x")], "id bigint, text string"), "id").save(str(tmp_path / "c"))
    with pytest.raises(ValueError):
        stage2.load_accumulator(spark, str(tmp_path / "c"))


DATASETS = {
    "sts": ("0\tg\tf\t2012\t1\ts1\ts2\tA cat.\tA dog.\t2.5\n1\tg\tf\t2012\t1\ts1\ts2\tSame\tSame\t5.0\n2\tg\tf\t2012\t1\ts1\ts2\tno\tscore\n", [("sts-train-00000", "A cat.", "A dog.", 0.5, "neutral"), ("sts-train-00001", "Same", "Same", 1.0, "similar")]),
    "sick": ("pair_ID\tsentence_A\tsentence_B\tentailment_label\trelatedness_score\n1\tA\tB\tNEUTRAL\t4.2\n2\tC\tD\tCONTRADICTION\t3.0\n3\t\tD\tENTAILMENT\t3.0\n", [("sick-train-00000", "A", "B", 0.8, "similar"), ("sick-train-00001", "C", "D", 0.5, "dissimilar")]),
    "mrpc": ('Quality\t#1 ID\t#2 ID\t#1 String\t#2 String\n1\t7\t8\tHe said "x\tHe says\n0\t9\t10\tone\ttwo\nx\t1\t2\ta\tb\n', [("mrpc-train-00000", 'He said "x', "He says", 1.0, "similar"), ("mrpc-train-00001", "one", "two", 0.0, "dissimilar")]),
    "qqp": ("id\tqid1\tqid2\tquestion1\tquestion2\tis_duplicate\n0\t1\t2\tWhy?\tHow?\t0\n1\t3\t4\tWhere\tWhere?\t1\n", [("qqp-train-00000", "Why?", "How?", 0.0, "dissimilar"), ("qqp-train-00001", "Where", "Where?", 1.0, "similar")]),
    "snli": ('{"gold_label": "neutral", "sentence1": "a", "sentence2": "b"}\n{"gold_label": "-", "sentence1": "c", "sentence2": "d"}\n{"gold_label": "Entailment", "sentence1": "e", "sentence2": "f"}\n', [("snli-train-00000", "a", "b", 0.5, "neutral"), ("snli-train-00001", "e", "f", 1.0, "similar")]),
    "simlex": ("word1\tword2\tPOS\tSimLex999\nold\tnew\tA\t1.58\nsmart\tclever\tA\t9.2\n", [("simlex-train-00000", "old", "new", 0.158, "dissimilar"), ("simlex-train-00001", "smart", "clever", 0.92, "similar")]),
    "wordsim": ("Word 1,Word 2,Human (mean)\nlove,sex,6.77\ntiger,cat,x\n", [("wordsim-train-00000", "love", "sex", 0.677, "similar")]),
}


@pytest.mark.parametrize("kind", sorted(DATASETS))
def test_public_datasets_become_pairs(spark, tmp_path, kind):
    text, want = DATASETS[kind]
    (tmp_path / "data").write_text(text)
    rows = readers.read_prepared(spark, kind, str(tmp_path / "data"), "train")
    assert [f"{n} {t}" for n, t in rows.dtypes] == readers.PAIR_SCHEMA.split(", ")
    assert sorted(tuple(r)[:5] for r in rows.collect()) == want


def test_balanced_sample(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 10 == 0]) for i in range(100)] + [(1000, "c")], "id bigint, label string")
    got = evalmetrics.balanced(rows, "label", 25, "id").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {"a": 14, "b": 10, "c": 1}
    assert evalmetrics.balanced(rows, "label", 25, "id").collect() == evalmetrics.balanced(rows.repartition(7), "label", 25, "id").collect()


def test_output_formats(spark):
    import base64

    e = api.Encoder().encode(spark.createDataFrame([(1, "a\tb\nc"), (2, None)], "id bigint, text string"))
    one = api.Embedding.of("a\tb\nc")
    assert readers.as_trits(e, "id").where("id = 1").first().trits == "".join(map(str, one.channels.tolist()))
    assert base64.b64decode(readers.as_base64(e, "id").where("id = 1").first().packed) == one.pack()
    assert sorted(r.value for r in readers.as_tsv(e, "id", "text").collect()) == ["1\ta b c", "2\t"]
    summary = spark.createDataFrame([(3, None)], "lines bigint, rate double")
    assert [r.value for r in readers.as_summary(summary).collect()] == ["lines: 3", "rate: -"]


def test_packed_index(spark, docs, tmp_path):
    index = api.Index.build(docs, "id")
    readers.save_packed(index.rows, str(tmp_path / "p"))
    back = readers.load_packed(spark, str(tmp_path / "p"))
    cols = [c for c in back.columns]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, index.rows.select(*cols).collect()))
    index.save(str(tmp_path / "i"))
    with pytest.raises(ValueError):
        readers.load_packed(spark, str(tmp_path / "i"))
    two = spark.createDataFrame([(api.Embedding.of(TEXTS[0]).pack(), api.Embedding.of(TEXTS[3]).pack()), (None, api.Embedding.of("x").pack())], "a binary, b binary")
    got = [r.similarity for r in codec.compare_packed(two, "a", "b").collect()]
    assert got == pytest.approx([api.Embedding.of(TEXTS[0]).similarity(api.Embedding.of(TEXTS[3])), 0.0])
    for bad in (b"x" * 47, b"\xff" * 48):
        with pytest.raises(Exception, match="packed vector|above 242"):
            codec.add_unpacked(spark.createDataFrame([(bad,)], "packed binary")).collect()


def test_generators(spark):
    rows = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, ""), (3, None)], "id bigint, text string")
    made = generate.banded_pairs(rows, "id", "text").collect()
    kept = {r.band: len(set(r.text_a.split()) & set(r.text_b.split())) for r in made if r.original_id == 1}
    assert kept["identical"] == 10 and kept["unrelated"] == 0 and kept["near"] >= kept["related"] >= kept["weak"] and len(made) == 15
    assert all(r.text_b == ("" if r.original_id == 2 else None) for r in made if r.original_id > 1)
    shuffled = rows.select(generate.shuffle_words(F.col("text"), 3)).first()[0]
    assert shuffled != rows.first().text and sorted(shuffled.split()) == sorted(rows.first().text.split())
    assert len(set(generate.demo_lines())) < len(generate.demo_lines())


def test_weighted_routing_of_a_small_index_compares_all(spark, docs):
    e = add_planes(docs).drop("text")
    w = csidf.collect_weights(csidf.document_frequency(e))
    got = {r.id: r for r in route.query_weighted(e, "id", e, "id", w, 0.9).collect()}
    assert got[2].match_id == 0 and got[4].similarity == 0 and not got[4].is_duplicate


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    class Conf(dict):
        set = dict.__setitem__

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session)
    Session.sparkContext.master = "local[2]"
    assert shared_dir(Session).startswith("file://")
