"""The document pipeline: five stages, each reading what the one before it kept.

Language identification, near-duplicate removal, benchmark decontamination,
secret redaction and source mixing. Every stage is a function of (spark, docs,
sf_dir); :func:`run` writes each result to the shared folder and rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simdex.llm import decontaminate, jaccard, langid, mixing, secrets
from simdex.llm.common import BROADCAST_ROWS, discard, keep_only, materialize, maybe_broadcast, stored, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one of the languages has its share; null texts and texts without a word go, repeated rows stay or go together."""
    return langid.drop_unidentified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each near-duplicate group.

    Texts without a word and rows with a null id are in no group and stay. Of
    rows that repeat an id one a distinct row is taken, and each goes by its own
    text's group: by the id alone a group could go whole.
    """
    drops = materialize(jaccard.near_duplicate_drops(docs), "drops")
    drops = maybe_broadcast(drops, drops.count(), BROADCAST_ROWS)
    again = materialize(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "again")
    n_again = again.count()
    if not n_again:
        return docs.join(drops, "doc_id", "left_anti").select(*docs.columns)
    repeated = maybe_broadcast(again, n_again)
    once = docs.join(repeated, "doc_id", "left_anti").join(drops, "doc_id", "left_anti").select(*docs.columns)
    rows = jaccard.with_class(docs.join(repeated, "doc_id", "left_semi").select(*docs.columns).distinct(), "class of text")
    gone = drops.select("doc_id", F.col("fp").alias("class of text"))
    return once.unionByName(rows.join(gone, ["doc_id", "class of text"], "left_anti").select(*docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages they share with the benchmark; only a text of which nothing is left goes."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets marked out; all rows stay, null and empty texts as they are."""
    return secrets.redact_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, sources and token counts of the documents that fill equal source budgets; null sources and null or empty texts are not chosen."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", identify),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminated),
    ("secret_scan", redacted),
    ("source_mixing", mixed),
]

#: The stages hold a trained model, approximate search, regular scans of bytes and
#: a dynamic programme, none of which SQL expresses; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's tables, its input among them, are deleted once its result is stored."""
    docs, since = table(spark, sf_dir, "documents"), stored()
    for name, stage in STAGES[:-1]:
        docs = keep_only(materialize(stage(spark, docs, sf_dir), name), since)
    chosen = STAGES[-1][1](spark, docs, sf_dir)  # reads the token counts that it has stored
    discard(docs)
    return chosen
