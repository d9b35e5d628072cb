import pyarrow as pa
from pyspark.sql import functions as F

from simdex.functions import encode, generate


def test_a_mutation_draws_once(spark):
    """Named within a walk over the words, a digest of the text was made for each word."""
    df = spark.createDataFrame([("one two three",)], "t string")
    for one in (generate.swap_words, generate.remove_word):
        plan = df.select(one(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("md5(") == 1


def test_texts_reach_the_encoder_in_batches_of_bounded_bytes(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, rows = spark.conf.get(key), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set(key, str(1 << 30))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        df = spark.range(0, 600, 1, 1).select("id", F.repeat(F.lit("some words "), 4000).alias("text"))
        planes = encode.add_planes(df)

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

        assert planes.count() == 600
        assert max(r.n for r in df.mapInArrow(sizes, "n bigint").collect()) < 2 * encode.BATCH_BYTES
    finally:
        spark.conf.set(key, before)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
