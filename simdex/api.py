"""Objects over the operators, for those who prefer them to functions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import canon as _canon
from .functions.codec import pack5, unpack5
from .functions.encode import add_planes, encode_text
from .functions.lens import LENSES, parse_lens
from .operators import csidf, dedup, fields, joins, route, stage2
from .sources import readers


@dataclass(frozen=True)
class Lens:
    edit: float
    morph: float
    phrase: float
    vocab: float

    @staticmethod
    def named(name: str) -> Lens:
        return Lens(*LENSES[name])

    def weights(self) -> tuple[float, float, float, float]:
        return parse_lens((self.edit, self.morph, self.phrase, self.vocab))


@dataclass(frozen=True)
class Embedding:
    """One vector of 240 channels on the driver."""

    channels: np.ndarray

    @staticmethod
    def of(text: str | None) -> Embedding:
        return Embedding(encode_text(text))

    @staticmethod
    def unpack(data: bytes) -> Embedding:
        return Embedding(unpack5(data))

    def pack(self) -> bytes:
        return pack5(self.channels)

    def fill(self) -> float:
        return float((self.channels > 0).mean())

    def as_floats(self) -> list[float]:
        return self.channels.astype(float).tolist()

    def similarity(self, other: Embedding, lens: str | tuple[float, ...] = "dedup", calibrate: bool = False) -> float:
        x, y = (v.channels.astype(float).reshape(4, 60) for v in (self, other))
        norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
        cos = np.where(norm > 0, (x * y).sum(1) / np.where(norm > 0, norm, 1), 0)
        w = np.array(parse_lens(lens))
        raw = float(cos @ w / w.sum()) if w.sum() else 0.0
        if calibrate:
            raw = min(1.0, raw / np.sqrt(max(self.fill(), 0.05) * max(other.fill(), 0.05)))
        return raw


class Encoder:
    """Canonicalise and encode a text column."""

    def __init__(self, preset: str | int = "none"):
        self.preset = preset

    def canonical(self, text: Column) -> Column:
        return _canon.canon(text, self.preset)

    def encode(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        return add_planes(df, self.canonical(F.col(text_col)))


class Index:
    """A plane table with a threshold, a lens and a calibration flag."""

    def __init__(self, rows: DataFrame, key: str = "id", threshold: float = 0.6, lens: str = "dedup", calibrate: bool = True):
        self.rows, self.key, self.threshold, self.lens, self.calibrate = rows, key, threshold, lens, calibrate

    @classmethod
    def build(cls, df: DataFrame, key: str, text_col: str = "text", tag: str | None = None, **settings) -> Index:
        return cls(readers.build_index(df, key, text_col, tag), "id", **settings)

    def count(self) -> int:
        return self.rows.count()

    def add(self, other: Index) -> Index:
        return type(self)(self.rows.unionByName(other.rows), self.key, self.threshold, self.lens, self.calibrate)

    def query(self, vectors: DataFrame, key: str) -> DataFrame:
        return joins.nearest(vectors, key, self.rows, self.key, self.threshold, self.lens, self.calibrate)

    def contains(self, vectors: DataFrame, key: str) -> DataFrame:
        return joins.similar_to_any(vectors, key, self.rows, self.key, self.threshold, self.lens)

    def dedup(self) -> DataFrame:
        return dedup.scan(self.rows, self.key, self.threshold, self.lens, self.calibrate)

    def settings(self) -> dict:
        return {"threshold": self.threshold, "lens": self.lens, "calibrate": self.calibrate}

    def apply(self, settings: dict) -> Index:
        lens = settings["lens"]
        self.threshold, self.lens, self.calibrate = settings["threshold"], lens if isinstance(lens, str) else tuple(lens), settings["calibrate"]
        return self

    def save(self, path: str) -> None:
        readers.save_index(self.rows, path, **self.settings())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        rows, settings = readers.load_index(spark, path)
        return cls(rows, "id").apply(settings)


class Router(Index):
    """An index that is asked by band routing."""

    mode = "balanced"
    #: Corpus weights, once enabled.
    weights: np.ndarray | None = None

    def settings(self) -> dict:
        return {**super().settings(), "mode": self.mode, "weights": None if self.weights is None else self.weights.tolist()}

    def apply(self, settings: dict) -> Router:
        super().apply(settings)
        self.mode = settings.get("mode", "balanced")
        self.weights = None if settings.get("weights") is None else np.array(settings["weights"])
        return self

    def add(self, other: Index) -> Router:
        """Both indexes' rows; corpus weights, where enabled, are counted anew."""
        out = super().add(other)
        out.mode = self.mode
        return out.enable_weights() if self.weights is not None else out

    def enable_weights(self) -> Router:
        """Count the corpus weights of all rows of the index."""
        self.weights = csidf.collect_weights(csidf.document_frequency(self.rows))
        return self

    def set_recall(self, mode: str) -> Router:
        if mode not in route.MODES:
            raise ValueError(f"no recall mode {mode!r}")
        self.mode = mode
        return self

    def query(self, vectors: DataFrame, key: str) -> DataFrame:
        return route.query(vectors, key, self.rows, self.key, self.threshold, self.lens, self.mode, self.calibrate)

    def stats(self, vectors: DataFrame, key: str) -> DataFrame:
        return route.query_stats(vectors, key, self.rows, self.key, self.mode)

    def bucket_sizes(self) -> DataFrame:
        return route.bucket_sizes(self.rows, self.key)

    def query_weighted(self, vectors: DataFrame, key: str) -> DataFrame:
        """Candidates re-ranked with the corpus weights of the index."""
        if self.weights is None:
            self.enable_weights()
        return route.query_weighted(vectors, key, self.rows, self.key, self.weights, self.threshold, self.lens, self.mode)


class FieldRouter(Router):
    """A routed index of documents of several fields; rows are those of :func:`fields.field_vectors`."""

    fields = fields.FieldConfig()

    def with_fields(self, cfg: fields.FieldConfig) -> FieldRouter:
        self.fields = cfg
        return self

    def settings(self) -> dict:
        return {**super().settings(), "fields": [self.fields.names, self.fields.weights, self.fields.route]}

    def apply(self, settings: dict) -> FieldRouter:
        super().apply(settings)
        names, weights, by = settings["fields"]
        return self.with_fields(fields.FieldConfig(tuple(names), tuple(weights), by))

    def add(self, other: Index) -> FieldRouter:
        return super().add(other).with_fields(self.fields)

    def query(self, vectors: DataFrame, key: str) -> DataFrame:
        return fields.nearest_routed(vectors, key, self.rows, self.key, self.fields, self.threshold, self.mode)


class Trainer:
    """Hebbian training of a second-stage model from labelled pairs."""

    def __init__(self, config: stage2.HebbianConfig = stage2.HebbianConfig(), mode: str = "diagonal"):
        self.config, self.mode = config, mode

    def fit(self, pairs: DataFrame, similarity: str, **options) -> stage2.Model:
        return stage2.train(pairs, similarity, self.config, self.mode, **options)
