from pyspark.sql import functions as F

from simdex import api
from simdex.functions import generate


def test_embedding():
    a, b = api.Embedding.of("the cat sat"), api.Embedding.of("the cat sits")
    assert abs(a.similarity(b) - 0.765171) < 1e-6 and a.similarity(a, calibrate=True) == 1.0
    assert (api.Embedding.unpack(a.pack()).channels == a.channels).all() and len(a.as_floats()) == 240
    assert api.Lens.named("edit").weights() == (1.0, 0.3, 0.1, 0.0)


def test_index_and_router(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["the quick brown fox", "a lazy dog sleeps", "THE QUICK BROWN FOX"])], "id bigint, text string")
    index = api.Index.build(docs, "id", threshold=0.9, calibrate=False)
    asked = api.Encoder("general").encode(spark.createDataFrame([(9, "  the quick   brown fox "), (8, "nothing like it")], "id bigint, text string"))
    got = {r.id: r for r in index.query(asked, "id").collect()}
    assert got[9].is_duplicate and got[9].match_id == 0 and not got[8].is_duplicate
    assert [r.id for r in index.contains(asked, "id").collect()] == [9]
    assert {r.id: r.match_id for r in index.dedup().collect() if r.is_duplicate} == {2: 0}
    index.save(str(tmp_path / "i"))
    back = api.Index.load(spark, str(tmp_path / "i"))
    assert back.add(index).count() == 6 and back.threshold == 0.9
    router = api.Router(index.rows, threshold=0.9, calibrate=False).set_recall("strict")
    assert {r.id for r in router.query(asked, "id").collect() if r.is_duplicate} == {9}
    assert router.query_weighted(asked, "id").where("id = 9").first().match_id == 0
    assert router.stats(asked, "id").first().total_entries == 3 and router.bucket_sizes().agg(F.sum("size")).first()[0] == 12


def test_generated_copies(spark):
    df = spark.createDataFrame([(1, "the big fast server has an error"), (2, "one"), (3, ""), (4, None)], "id int, text string")
    rows = generate.near_duplicates(df, "id", "text", 8).collect()
    own = [r.mutated.split() for r in rows if r.original_id == 1]
    base = set("the big fast server has an error large quick host fault".split()) | set(generate.FILLERS)
    assert all(6 <= len(w) <= 8 and set(w) <= base for w in own) and len({tuple(w) for w in own}) > 2
    assert all(r.mutated is None for r in rows if r.original_id == 4)
    char = df.where("id = 1").select(generate.perturb_character(F.col("text"), 3)).first()[0]
    assert char != "the big fast server has an error" and abs(len(char) - 32) <= 1
