"""Evaluation: rank correlation, precision and recall, sweeps, splits and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encode import PLANES
from . import joins, tiles


def mid_rank(column: str, by: tuple[str, ...] = ()) -> Column:
    """Rank from 1, ties sharing the middle of theirs."""
    order = Window.partitionBy(*by).orderBy(column)
    peers = Window.partitionBy(*by, column)
    return F.rank().over(order) + (F.count("*").over(peers) - 1) / 2


def spearman(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``n, rho`` (by group): 1 - 6 sum d^2 / (n (n^2 - 1)) on mid-ranks; 0 below two rows."""
    d = df.withColumn("__d", mid_rank(x, by) - mid_rank(y, by))
    out = d.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("__d") * F.col("__d")).alias("d2"))
    rho = F.when(F.col("n") < 2, 0.0).otherwise(1 - 6 * F.col("d2") / (F.col("n") * (F.col("n") * F.col("n") - 1)))
    return out.select(*by, "n", rho.alias("rho"))


def prf(df: DataFrame, predicted: str, actual: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``tp, fp, fn, precision, recall, f1``; a ratio without a denominator is 0."""
    p, a = F.col(predicted), F.col(actual)
    c = df.groupBy(*by).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))
    ratio = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def threshold_sweep(df: DataFrame, score: str, actual: str, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 at each threshold."""
    grid = df.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    both = df.crossJoin(F.broadcast(grid)).withColumn("__p", F.col(score) >= F.col("threshold"))
    return prf(both, "__p", actual, ("threshold",))


def dedup_sweep(df: DataFrame, key: str, group: str, duplicate: str, thresholds: list[float], lens: str | tuple[float, ...] = "dedup") -> DataFrame:
    """``threshold, tp, fp, fn, precision, recall, f1`` of duplicates whose group is known.

    A duplicate's best match among all other rows is true at or above the threshold
    within its group, false in another, and missed below; every pair of other rows
    at the threshold in two groups is false too. A null group is nobody's.
    """
    grid = df.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    known, others = df.where(F.col(duplicate)), df.where(~F.coalesce(F.col(duplicate), F.lit(False)))
    of = df.select(F.col(key).alias("ref_id"), F.col(group).alias("ref_group"))
    planes = lambda x: x.select(F.col(key).alias("id"), *PLANES)
    both = tiles.likely_best(planes(known), planes(df), tiles.Measure(lens), "other")
    top = joins.best(both.select(F.col("a.id").alias("id"), F.col("b.id").alias("ref_id"), F.expr(joins.score(lens)).alias("similarity")))
    own = known.select(F.col(key).alias("id"), F.col(group).alias("own_group")).join(top, "id", "left").join(of, F.col("match_id") == F.col("ref_id"), "left")
    found = F.coalesce(F.col("similarity"), F.lit(-1.0)) >= F.col("threshold")
    same = F.coalesce(F.col("own_group") == F.col("ref_group"), F.lit(False))
    a = own.crossJoin(F.broadcast(grid)).groupBy("threshold").agg(F.count_if(found & same).alias("tp"), F.count_if(found & ~same).alias("fp"), F.count_if(~found).alias("fn"))
    # pairs in two groups: all, counted where they are compared, less those within a group
    vectors = others.select(F.col(key).alias("id"), F.col(group).alias("g"), *joins.solid())
    within = vectors.alias("a").join(vectors.alias("b"), F.expr("a.g = b.g AND a.id < b.id")).select(F.expr(joins.score(lens)).alias("similarity"))
    within = within.crossJoin(F.broadcast(grid)).where("similarity >= threshold").groupBy("threshold").agg(F.count("*").alias("inside"))
    every = tiles.counts(planes(others), tiles.Measure(lens), thresholds)
    b = every.join(within, "threshold", "left").select("threshold", (F.col("n") - F.coalesce("inside", F.lit(0))).alias("more"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    c = grid.join(a, "threshold", "left").join(b, "threshold", "left").select("threshold", zero("tp").alias("tp"), (zero("fp") + zero("more")).alias("fp"), zero("fn").alias("fn"))
    ratio = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def balanced(df: DataFrame, label: str, total: int, key: str, seed: int = 42) -> DataFrame:
    """A sample of ``total`` rows, as many of each label as of any other where there are enough.

    Rows go by a seeded hash of the key; what a short label leaves goes to the next rows of the others.
    """
    order = Window.partitionBy(label).orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key)
    rows = df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= total)
    return rows.orderBy("__r", label).limit(total).drop("__r")


def mean_absolute_error(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(F.col(x) - F.col(y))).alias("mae"))


def alpha_grid(df: DataFrame, s1: str, s2: str, gold: str, steps: int = 20) -> DataFrame:
    """``alpha, n, rho`` of the blend alpha s1 + (1 - alpha) s2 for alpha = 0 .. 1."""
    grid = df.sparkSession.range(steps + 1).select((F.col("id") / steps).alias("alpha"))
    both = df.crossJoin(F.broadcast(grid)).withColumn("__s", F.round(F.col("alpha") * F.col(s1) + (1 - F.col("alpha")) * F.col(s2), 9))
    return spearman(both, "__s", gold, ("alpha",))


def adaptive_alpha(df: DataFrame, s1: str, s2: str, gold: str) -> DataFrame:
    """``bucket, alpha``: per decile of s1 the best alpha of 0, 0.1 .. 1; 0.5 below three rows.

    A similarity of exactly 1 is in no bucket. Ties go to the smaller alpha.
    """
    spark = df.sparkSession
    rows = df.where(F.col(s1) < 1).withColumn("bucket", F.floor(F.col(s1) * 10).cast("int"))
    grid = spark.range(11).select((F.col("id") / 10).alias("alpha"))
    both = rows.crossJoin(F.broadcast(grid)).withColumn("__s", F.round(F.col("alpha") * F.col(s1) + (1 - F.col("alpha")) * F.col(s2), 9))
    rho = spearman(both, "__s", gold, ("bucket", "alpha"))
    best = rho.groupBy("bucket").agg(F.max(F.struct("rho", (-F.col("alpha")).alias("neg"))).alias("m"), F.first("n").alias("n"))
    best = best.select("bucket", F.when(F.col("n") < 3, 0.5).otherwise(-F.col("m.neg")).alias("alpha"))
    return spark.range(10).select(F.col("id").cast("int").alias("bucket")).join(best, "bucket", "left").select("bucket", F.coalesce("alpha", F.lit(0.5)).alias("alpha"))


def latency_percentiles(df: DataFrame, column: str) -> DataFrame:
    return df.agg(*(F.percentile(column, q).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)))


def stratified_split(df: DataFrame, key: str, source: str, train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """``df`` with ``split``: shares of each source, in the order of a multiplicative hash of the key."""
    h = F.pmod(F.col(key) * F.lit(2654435761), F.lit(4294967296))
    rn = F.row_number().over(Window.partitionBy(source).orderBy(h, key))
    n = F.count("*").over(Window.partitionBy(source))
    split = F.when(F.col("__r") <= F.floor(F.col("__n") * train), "train").when(F.col("__r") <= F.floor(F.col("__n") * (train + valid)), "validation").otherwise("test")
    return df.withColumn("__r", rn).withColumn("__n", n).withColumn("split", split).drop("__r", "__n")


def validate_pairs(df: DataFrame) -> DataFrame:
    """Per source: rows, and rows with a missing text, a score outside 0..1, an unknown label."""
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    return df.groupBy("source").agg(
        F.count("*").alias("rows"),
        F.count_if(empty("text_a") | empty("text_b")).alias("missing_text"),
        F.count_if(F.col("score").isNull() | ~F.col("score").between(0, 1)).alias("bad_score"),
        F.count_if(~F.coalesce(F.col("label").isin("similar", "neutral", "dissimilar"), F.lit(False))).alias("bad_label"),
    )


def cost_model(df: DataFrame, documents: str = "documents", share: str = "share_resolved", local: float = 1e-6, remote: float = 1e-3, setup: float = 0.4) -> DataFrame:
    """Cost of remote comparison alone and behind the local filter, and the saving."""
    n = F.col(documents).cast("double")
    pairs = n * (n - 1) / 2
    out = df.withColumn("remote_cost", pairs * remote).withColumn("mixed_cost", setup + pairs * local + pairs * (1 - F.col(share)) * remote)
    return out.withColumn("saving", F.when(F.col("remote_cost") > 0, 1 - F.col("mixed_cost") / F.col("remote_cost")).otherwise(0.0))
