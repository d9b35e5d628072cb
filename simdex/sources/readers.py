"""Readers and writers: text lines, JSON lines, prepared pairs, stored indexes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codec import add_packed, add_unpacked
from ..functions.encode import add_planes, trit_array

PAIR_SCHEMA = "id string, text_a string, text_b string, score double, label string, source string"


def is_jsonl(spark: SparkSession, path: str) -> bool:
    """Whether the first line that isn't blank begins an object."""
    row = spark.read.text(path).where(F.trim("value") != "").first()
    return row is not None and row.value.lstrip().startswith("{")


def _numbered(df: DataFrame) -> DataFrame:
    """Dense line numbers in file order: partition offsets plus ranks within partitions."""
    tagged = df.withColumn("__at", F.monotonically_increasing_id())
    sizes = tagged.groupBy(F.shiftright("__at", 33).alias("part")).agg(F.count("*").alias("n"))
    base = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = tagged.join(F.broadcast(base.select("part", "base")), F.shiftright("__at", 33) == F.col("part"))
    return joined.withColumn("line", F.col("base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "part", "base", "n")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, text`` of every line that isn't empty."""
    rows = spark.read.text(path).select(F.regexp_replace("value", r"[\r\n]+$", "").alias("text"))
    return _numbered(rows.where("text <> ''")).select("line", "text")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``line, id, text`` of the objects with a text; the line number stands in for an id."""
    rows = spark.read.text(path).select(F.from_json("value", "id string, text string").alias("j"))
    rows = rows.select("j.id", "j.text").where("text is not null and text <> ''")
    return _numbered(rows).select("line", F.coalesce("id", F.col("line").cast("string")).alias("id"), "text")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``line, id, text`` of either format."""
    if is_jsonl(spark, path):
        return read_jsonl(spark, path)
    return read_lines(spark, path).select("line", F.col("line").cast("string").alias("id"), "text")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Training pairs with both texts."""
    rows = spark.read.schema(PAIR_SCHEMA).json(path)
    return rows.where("text_a <> '' and text_b <> ''")


def explode_documents(df: DataFrame, body: str) -> DataFrame:
    """Documents of JSON bodies with a ``documents`` array: ``pos, text, tag``."""
    parsed = F.from_json(body, "documents array<struct<text string, tag string>>")
    return df.select(F.posexplode(parsed["documents"]).alias("pos", "d")).select("pos", "d.text", "d.tag")


def score_prepared(kind: str, score: Column) -> Column:
    """Raw similarity of a public dataset scaled to 0..1; null stays null."""
    scale = {"sts": (0, 5), "sick": (1, 4), "mrpc": (0, 1), "qqp": (0, 1), "simlex": (0, 10), "wordsim": (0, 10)}
    low, width = scale[kind]
    return F.when(score.isNotNull(), F.greatest(F.least((score - low) / width, F.lit(1.0)), F.lit(0.0)))


def label_of(score: Column) -> Column:
    return F.when(score >= 0.6, "similar").when(score >= 0.3, "neutral").otherwise("dissimilar")


def snli_score(label: Column) -> Column:
    return F.when(label == "entailment", 1.0).when(label == "neutral", 0.5).when(label == "contradiction", 0.0)


def save_index(df: DataFrame, path: str, **config: object) -> None:
    """A table with its settings, count and checksum.

    Rows go to a new folder under ``path``; then a pointer file is replaced in one
    step, so readers see the old table or the new one, and a table may be saved to
    where it was read. The version before stays for those who still read it.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    where = f"{path.rstrip('/')}/{version}"
    df.write.parquet(where)
    rows, check = _checksum(spark.read.parquet(where))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}")
    fs = at("x").getFileSystem(conf)
    before = json.loads(_read_file(spark, path, _POINTER)) if fs.exists(at(_POINTER)) else {}
    text = json.dumps({"version": version, "before": before.get("version"), "rows": rows, "checksum": check, "config": config}, sort_keys=True)
    draft = f".{version}.json"
    with_stream = fs.create(at(draft), True)
    with_stream.write(bytearray(text.encode()))
    with_stream.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(at(draft), at(_POINTER), options)
    if before.get("before"):
        fs.delete(at(before["before"]), True)


_POINTER = "CURRENT.json"


def _read_file(spark: SparkSession, path: str, name: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}")
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _checksum(df: DataFrame) -> tuple[int, str]:
    """Row count and a sum of row hashes that doesn't depend on the order."""
    row = df.agg(F.count("*"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first()
    return row[0], str(row[1] or 0)


def load_index(spark: SparkSession, path: str, verify: bool = True) -> tuple[DataFrame, dict]:
    """Table and settings of :func:`save_index`; an error where count or checksum differ."""
    meta = json.loads(_read_file(spark, path, _POINTER))
    rows = spark.read.parquet(f"{path.rstrip('/')}/{meta['version']}")
    if verify and _checksum(rows) != (meta["rows"], meta["checksum"]):
        raise ValueError(f"{path}: the checksum differs")
    return rows, meta["config"]


def save_packed(df: DataFrame, path: str, key: str = "id") -> None:
    """An index of packed vectors alone: ``key`` and 48 bytes a row."""
    save_index(add_packed(df).select(F.col(key).alias("id"), "packed"), path, kind="packed")


def load_packed(spark: SparkSession, path: str) -> DataFrame:
    """``id`` and the planes and norms of :func:`save_packed`."""
    rows, config = load_index(spark, path)
    if config.get("kind") != "packed":
        raise ValueError(f"{path}: no packed index")
    return add_unpacked(rows).drop("packed")


def build_index(df: DataFrame, key: str, text_col: str = "text", tag: str | None = None) -> DataFrame:
    src = df.select(F.col(key).alias("id"), (F.col(tag) if tag else F.lit(None).cast("string")).alias("tag"), F.col(text_col).alias("text"))
    return add_planes(src).drop("text")


def _label(score: Column, said: Column | None = None) -> Column:
    """A label by its score, or by a word for entailment where one is said."""
    if said is None:
        return label_of(score)
    word = F.lower(F.coalesce(said, F.lit("")))
    return F.when(word.contains("entail"), "similar").when(word.contains("contradict"), "dissimilar").otherwise(label_of(score))


def _separated(spark: SparkSession, path: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """All columns as strings; quotes are text, short lines have nulls."""
    return spark.read.csv(path, sep=sep, header=header, quote="" if sep == "\t" else '"', mode="PERMISSIVE")


def _named(df: DataFrame, *names: str) -> Column:
    """The first of some columns that the table has, without regard to case."""
    have = {c.lower(): c for c in df.columns}
    found = [F.col(f"`{have[n]}`") for n in names if n in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def read_prepared(spark: SparkSession, kind: str, path: str, split: str = "all") -> DataFrame:
    """Pair records (:data:`PAIR_SCHEMA`) of a public dataset in its published layout.

    ``sts`` (no header, score last), ``sick``, ``mrpc``, ``qqp``, ``simlex`` (tab-separated with
    a header), ``wordsim`` (commas), ``snli`` (JSON lines). Rows without both texts or
    without a readable score are left out. Ids count the records left, in file order.
    """
    number = lambda c: c.try_cast("double")
    said: Column | None = None
    if kind == "sts":
        df = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 6)
        a, b, raw = F.get("f", F.size("f") - 3), F.get("f", F.size("f") - 2), number(F.get("f", F.size("f") - 1))
    elif kind == "snli":
        df = spark.read.schema("gold_label string, label string, sentence1 string, sentence2 string").json(path)
        a, b, raw = F.col("sentence1"), F.col("sentence2"), snli_score(F.lower(F.trim(F.coalesce("gold_label", "label"))))
    else:
        df = _separated(spark, path, "," if kind == "wordsim" else "\t")
        pick = {
            "sick": (("sentence_a",), ("sentence_b",), ("relatedness_score", "score", "relatedness")), "mrpc": (("#1 string",), ("#2 string",), ("quality", "\ufeffquality")), "qqp": (("question1",), ("question2",), ("is_duplicate", "label", "duplicate")),
            "simlex": (("word1",), ("word2",), ("simlex999", "similarity", "score", "sim")), "wordsim": (("word 1", "word1"), ("word 2", "word2"), ("human (mean)", "score", "similarity")),
        }[kind]
        a, b, raw = _named(df, *pick[0]), _named(df, *pick[1]), number(_named(df, *pick[2]))
        said = _named(df, "entailment_label", "entailment_judgment", "label") if kind == "sick" else None
    score = raw if kind == "snli" else score_prepared(kind, raw)
    rows = df.select(F.trim(a).alias("text_a"), F.trim(b).alias("text_b"), F.round(score, 4).alias("score"), _label(score, said).alias("label"))
    rows = _numbered(rows.where("text_a <> '' and text_b <> '' and score is not null"))
    return rows.select(F.format_string(f"{kind}-{split}-%05d", "line").alias("id"), "text_a", "text_b", "score", "label", F.lit(kind).alias("source"))


def as_trits(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and the 240 channels as a string of digits."""
    return df.select(*columns, F.array_join(trit_array(), "").alias("trits"))


def as_base64(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and the packed vector in base 64."""
    return add_packed(df).select(*columns, F.base64("packed").alias("packed"))


def as_tsv(df: DataFrame, *columns: str) -> DataFrame:
    """Tab-separated lines; tabs and line breaks within a value become spaces, nulls are empty."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]", " ")
    return df.select(F.concat_ws("\t", *map(cell, columns)).alias("value"))


def as_summary(df: DataFrame) -> DataFrame:
    """``name: value`` lines of a one-row summary."""
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in df.columns]
    return df.select(F.explode(F.array(*lines)).alias("value"))


def as_json(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.to_json(F.struct(*columns)).alias("value"))
