"""Similarity joins over plane tables.

A plane table has a key, the planes and the norms (:mod:`simdex.functions.encode`).
Pairs within one table are found by matrix products in tiles and judged by the
popcount expressions. Against a reference table the predicates are inside the join
condition: the smaller side is broadcast where its counted rows allow; beyond that
Spark tiles the comparison as a cartesian product of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions.encode import NORMS, PLANES
from . import tiles
from .storage import BROADCAST_ROWS, dealt, small, store

VECTOR = (*PLANES, *NORMS)


def vectors(df: DataFrame, key: str) -> DataFrame:
    """Only the key, as ``id``, and the vector columns, which can't be null.

    Without null checks the compiled join condition is a fraction of the size.
    """
    return df.select(F.col(key).alias("id"), *solid())


def solid() -> list[Column]:
    zero = {**{p: F.lit(0).cast("bigint") for p in PLANES}, **{s: F.lit(0.0) for s in NORMS}}
    return [F.coalesce(c, z).alias(c) for c, z in zero.items()]


def score(lens: str | tuple[float, ...] = "dedup", calibrate: bool = False, a: str = "a.", b: str = "b.") -> str:
    raw = S.flat_cosine(a, b) if lens == "flat" else S.lens_cosine(a, b, lens)
    return S.calibrated(raw, a, b) if calibrate else raw


def pairs(df: DataFrame, key: str, threshold: float, lens: str | tuple[float, ...] = "dedup", calibrate: bool = False, detail: bool = False) -> DataFrame:
    """``i, j, similarity`` of all row pairs ``i < j`` at or above the threshold.

    Rows with equal vectors are compared once. ``detail`` adds the four chain
    cosines. Rows with a null key are left out.
    """
    groups = store(vectors(df, key).where("id is not null").groupBy(*VECTOR).agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("rep", F.element_at("ids", 1)), "vectors")
    groups = groups.select("ids", "rep", *solid())
    expr = score(lens, calibrate)
    chains = [F.expr(S.chain_cosine("a.", "b.", c)).alias(n) for c, n in enumerate(("edit", "morph", "phrase", "vocab"))] if detail else []
    cols = [F.expr(expr).alias("similarity"), *chains]
    names = ["similarity", *("edit morph phrase vocab".split() if detail else [])]
    both = tiles.likely_pairs(groups.select(F.col("rep").alias("id"), *PLANES), tiles.Measure(lens, calibrate), threshold)
    cross = both.where(f"a.id <> b.id AND {expr} >= {threshold!r}e0").select(F.col("a.id").alias("m"), F.col("b.id").alias("n"), *cols)
    copies = groups.where(F.size("ids") > 1).select(F.col("rep").alias("of"), "ids")
    n_copies = copies.count()
    for x in ("m", "n") if n_copies else ():
        of = F.broadcast(copies) if n_copies <= BROADCAST_ROWS else copies
        whole = cross.join(of, F.col(x) == F.col("of"), "left").withColumn(x, F.explode(F.coalesce("ids", F.array(x))))
        cross = whole.select("m", "n", *names)
    cross = cross.select(F.least("m", "n").alias("i"), F.greatest("m", "n").alias("j"), *names)
    own = groups.where(F.size("ids") > 1).alias("a").join(groups.select("rep", *VECTOR).alias("b"), F.expr("a.rep = b.rep")).where(f"{expr} >= {threshold!r}e0")
    own = own.select(F.col("a.ids").alias("x"), *cols).select("x", F.posexplode("x").alias("k", "i"), *names)
    own = own.select("i", F.explode(F.expr("slice(x, k + 2, size(x))")).alias("j"), *names)
    return cross.unionByName(own)


def pairs_with_reference(df: DataFrame, key: str, ref: DataFrame, ref_key: str, threshold: float, lens: str | tuple[float, ...] = "dedup", calibrate: bool = False) -> DataFrame:
    """``id, ref_id, similarity`` of all pairs of a row and a reference row."""
    expr = score(lens, calibrate)
    both = dealt(vectors(df, key)).alias("a").join(small(vectors(ref, ref_key)).alias("b"), F.expr(f"{expr} >= {threshold!r}e0"))
    return both.select(F.col("a.id").alias("id"), F.col("b.id").alias("ref_id"), F.expr(expr).alias("similarity"))


def scored(df: DataFrame, key: str, ref: DataFrame, ref_key: str, expr: str, where: str = "true") -> DataFrame:
    """Every row with every reference row: ``id, ref_id, similarity``."""
    both = dealt(vectors(df, key)).alias("a").join(small(vectors(ref, ref_key)).alias("b"), F.expr(where))
    return both.select(F.col("a.id").alias("id"), F.col("b.id").alias("ref_id"), F.expr(expr).alias("similarity"))


def best(rows: DataFrame, key: str = "id") -> DataFrame:
    """The reference with the largest similarity of each row, ties to the smallest.

    An aggregate, not a window: partial maxima are kept on the map side.
    """
    top = rows.groupBy(key).agg(F.max(F.struct("similarity", (-F.col("ref_id")).alias("neg"))).alias("m"))
    return top.select(key, (-F.col("m.neg")).alias("match_id"), F.col("m.similarity").alias("similarity"))


def nearest(df: DataFrame, key: str, ref: DataFrame, ref_key: str, threshold: float, lens: str | tuple[float, ...] = "dedup", calibrate: bool = False) -> DataFrame:
    """``id, is_duplicate, match_id, similarity``: each row's best reference."""
    found = best(scored(df, key, ref, ref_key, score(lens, calibrate)))
    return found.select("id", (F.col("similarity") >= threshold).alias("is_duplicate"), "match_id", "similarity")


def top_k(df: DataFrame, key: str, ref: DataFrame, ref_key: str, k: int, lens: str | tuple[float, ...] = "flat", least: float | None = None) -> DataFrame:
    """The ``k`` best references of each row in order: ``id, rank, ref_id, similarity``."""
    rows = scored(df, key, ref, ref_key, score(lens))
    if least is not None:
        rows = rows.where(F.col("similarity") >= least)
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "ref_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "rank", "ref_id", "similarity")


def similar_to_any(df: DataFrame, key: str, ref: DataFrame, ref_key: str, threshold: float, lens: str | tuple[float, ...] = "dedup", anti: bool = False) -> DataFrame:
    """Keys of the rows that have (``anti``: that have no) reference at the threshold."""
    expr = score(lens)
    both = dealt(vectors(df, key)).alias("a").join(small(vectors(ref, ref_key)).alias("b"), F.expr(f"{expr} >= {threshold!r}e0"), "left_anti" if anti else "left_semi")
    return both.select("id")


def exact_groups(df: DataFrame, key: str) -> DataFrame:
    """``first_id, members`` of the rows that share a vector, two at least."""
    rows = vectors(df, key).groupBy(*PLANES).agg(F.min("id").alias("first_id"), F.count("*").alias("members"))
    return rows.where("members > 1").select("first_id", "members")


