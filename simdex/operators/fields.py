"""Documents of several fields, each with its own vector and weight."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions.encode import NORMS, PLANES, add_planes
from ..functions.lens import STATIC_IDF
from . import route, tiles
from .joins import best


@dataclass(frozen=True)
class FieldConfig:
    """Up to four fields; the vector of ``route`` serves candidate routing."""

    names: tuple[str, ...] = ("title", "body", "code")
    weights: tuple[float, ...] = (1.0, 1.0, 1.0)
    route: str = "body"

    def __post_init__(self) -> None:
        if not 1 <= len(self.names) <= 4 or len(self.names) != len(self.weights):
            raise ValueError("one to four fields, each with a weight")


PRESETS = {
    "code": FieldConfig(weights=(1.0, 0.3, 1.2)),
    "support": FieldConfig(weights=(1.0, 0.8, 0.3)),
    "policy": FieldConfig(weights=(1.0, 0.9, 0.0)),
}


def parse_fields(spec: str, weights: str | None = None) -> FieldConfig:
    """``a,b,c`` with optional ``a=1,b=0.5``; the second field routes, the only one if single."""
    names = tuple(n.strip() for n in spec.split(",") if n.strip())
    given = {}
    for part in (weights or "").split(","):
        if part.strip():
            name, eq, value = part.partition("=")
            if not eq or name.strip() not in names:
                raise ValueError(f"no such field weight: {part!r}")
            given[name.strip()] = float(value)
    route = "body" if "body" in names else names[min(1, len(names) - 1)]
    return FieldConfig(names, tuple(given.get(n, 1.0) for n in names), route)


def encode_fields(df: DataFrame, cfg: FieldConfig, columns: dict[str, str]) -> DataFrame:
    """``df`` with a vector per field; a field without a column has all zeros."""
    for i, name in enumerate(cfg.names):
        df = add_planes(df, F.col(columns[name]) if name in columns else F.lit(""), f"_{i}")
    return df


def from_json(df: DataFrame, cfg: FieldConfig, json_col: str) -> DataFrame:
    """Field columns and ``tag`` from JSON objects; ``text`` stands in for a missing body."""
    parsed = F.from_json(F.col(json_col), ", ".join(f"`{n}` string" for n in dict.fromkeys((*cfg.names, "id", "text"))))
    out = df.withColumn("__j", parsed)
    for n in cfg.names:
        value = F.col(f"__j.{n}")
        out = out.withColumn(n, F.coalesce(value, F.col("__j.text")) if n == "body" else value)
    return out.withColumn("tag", F.col("__j.id")).drop("__j")


def _suffixed(expr: str, field: int) -> str:
    for name in (*PLANES, *NORMS):
        expr = expr.replace(f".{name}", f".{name}_{field}")
    return expr


def field_cosine(cfg: FieldConfig, idf: bool = False, a: str = "a.", b: str = "b.") -> str:
    """Weighted mean over fields of the mean chain cosine (``idf``: of the flat weighted one)."""
    parts = []
    for i, w in enumerate(cfg.weights):
        if w > 0:
            one = S.idf_cosine(a, b, STATIC_IDF) if idf else S.lens_cosine(a, b, "uniform")
            parts.append(f"{w!r}e0 * {_suffixed(one, i)}")
    return f"(({' + '.join(parts)}) / {sum(w for w in cfg.weights if w > 0)!r}e0)" if parts else "0.0e0"


def measure(cfg: FieldConfig, idf: bool = False) -> tiles.Measure:
    """What :func:`field_cosine` computes, for comparison in tiles."""
    return tiles.Measure("idf" if idf else "uniform", fields=cfg.weights, suffixed=True)


def field_vectors(df: DataFrame, cfg: FieldConfig, key: str) -> DataFrame:
    """The key, as ``id``, and the fields' vectors."""
    return df.select(F.col(key).alias("id"), *(f"{n}_{i}" for i in range(len(cfg.names)) for n in (*PLANES, *NORMS)))


def solid(df: DataFrame, cfg: FieldConfig) -> DataFrame:
    """Field vectors that can't be null, so that a join condition is compiled without null checks."""
    zero = {**{p: F.lit(0).cast("bigint") for p in PLANES}, **{s: F.lit(0.0) for s in NORMS}}
    return df.select("id", *(F.coalesce(f"{n}_{i}", z).alias(f"{n}_{i}") for i in range(len(cfg.names)) for n, z in zero.items()))


def route_vector(df: DataFrame, cfg: FieldConfig, key: str) -> DataFrame:
    """The routing field's vector under the plain column names."""
    i = cfg.names.index(cfg.route)
    return df.select(F.col(key).alias("id"), *(F.col(f"{n}_{i}").alias(n) for n in (*PLANES, *NORMS)))


def nearest_routed(df: DataFrame, key: str, index: DataFrame, index_key: str, cfg: FieldConfig, threshold: float, mode: str = "balanced", idf: bool = False) -> DataFrame:
    """``id, is_duplicate, match_id, similarity``: candidates share a bucket of the routing field, fields re-rank them.

    Every entry is a candidate in small indexes; a row without one has similarity 0.
    """
    a, b = field_vectors(df, cfg, key), field_vectors(index, cfg, index_key)
    if index.count() < route.BRUTE_FORCE_BELOW:
        both = a.alias("a").crossJoin(b.alias("b"))
    else:
        by = measure(cfg, idf)
        both = route.routed(a, "id", b, "id", mode, columns=tuple(by.columns), at=cfg.names.index(cfg.route)).likely_best(by)
    top = best(both.select(F.col("a.id").alias("id"), F.col("b.id").alias("ref_id"), F.expr(field_cosine(cfg, idf)).alias("similarity")))
    sim = F.coalesce("similarity", F.lit(0.0))
    return a.select("id").join(top, "id", "left").select("id", (sim >= threshold).alias("is_duplicate"), "match_id", sim.alias("similarity"))
