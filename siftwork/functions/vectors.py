"""Vector metrics and normalisations as columns over arrays of numbers, and a registry of metrics by name.

Vectors of different length have no metric (null), as has a null vector; ``strict=False`` gives 0 instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def _same_length(a: Column, b: Column, value: Column, strict: bool = True) -> Column:
    return F.when(F.size(a) == F.size(b), value) if strict else F.when(F.size(a) == F.size(b), value).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column, strict: bool = True, a_norm: Column | None = None, b_norm: Column | None = None) -> Column:
    """Cosine within [-1, 1]; 0 for empty vectors and such of norm 0. Norms that are known may be given."""
    n = (norm(a) if a_norm is None else a_norm) * (norm(b) if b_norm is None else b_norm)
    return _same_length(a, b, F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n))), strict)


def euclidean_distance(a: Column, b: Column) -> Column:
    return _same_length(a, b, F.sqrt(_fold(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))))


def manhattan_distance(a: Column, b: Column) -> Column:
    return _same_length(a, b, _fold(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))))


def active_jaccard(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Positions above the threshold in both over those in either; 1 if there are none."""
    both = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x > threshold) & (y > threshold)), lambda v: v))
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x > threshold) | (y > threshold)), lambda v: v))
    return _same_length(a, b, F.when(either == 0, F.lit(1.0)).otherwise(both / either))


@dataclass(frozen=True)
class Metric:
    """A similarity and the distance that goes with it."""

    similarity: Callable[[Column, Column], Column]
    distance: Callable[[Column, Column], Column]


METRICS: dict[str, Metric] = {
    "cosine": Metric(cosine, lambda a, b: 1.0 - cosine(a, b)),
    "euclidean": Metric(lambda a, b: F.exp(-euclidean_distance(a, b)), euclidean_distance),
    "manhattan": Metric(lambda a, b: 1.0 / (1.0 + manhattan_distance(a, b)), manhattan_distance),
    "dot": Metric(lambda a, b: _same_length(a, b, dot(a, b)), lambda a, b: 2.0 - 2.0 * _same_length(a, b, dot(a, b))),
    "jaccard": Metric(active_jaccard, lambda a, b: 1.0 - active_jaccard(a, b)),
}


def register_metric(name: str, metric: Metric) -> None:
    """Make a metric of one's own available by name; a known name can't be taken."""
    if name in METRICS:
        raise ValueError(f"the metric {name} exists")
    METRICS[name] = metric


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, not once for each element of an array that ``use`` goes through."""
    return F.get(F.transform(F.array(value), use), 0)


def _doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def _scaled(a: Column, n: Column) -> Column:
    return _with(n, lambda m: F.when(m > 0, F.transform(a, lambda x: x.cast("double") / m)).otherwise(_doubles(a)))


def l2_normalize(a: Column) -> Column:
    """Divided by the Euclidean norm, if that is above 0."""
    return _scaled(a, norm(a))


def l1_normalize(a: Column) -> Column:
    return _scaled(a, _fold(F.transform(a, lambda x: F.abs(x.cast("double")))))


def minmax_normalize(a: Column) -> Column:
    """Stretched to [0, 1]; unchanged if all numbers are equal."""
    ends = F.struct(F.array_min(a).cast("double").alias("low"), F.array_max(a).cast("double").alias("high"))
    return _with(ends, lambda e: F.when(e["high"] > e["low"], F.transform(a, lambda x: (x.cast("double") - e["low"]) / (e["high"] - e["low"]))).otherwise(_doubles(a)))


def zscore_normalize(a: Column) -> Column:
    """Mean 0 and population variance 1; unchanged if all numbers are equal."""

    def around(m: Column) -> Column:
        sd = F.sqrt(_fold(F.transform(a, lambda x: (x.cast("double") - m) * (x.cast("double") - m))) / F.size(a))
        return _with(sd, lambda d: F.when(d > 0, F.transform(a, lambda x: (x.cast("double") - m) / d)).otherwise(_doubles(a)))

    return _with(_fold(a) / F.size(a), around)


def int8_quantize(a: Column) -> Column:
    """``scale`` and ``codes`` of an 8-bit scalar quantisation: number = code * scale."""
    scale = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double")))) / 127.0
    return _with(scale, lambda s: F.struct(s.alias("scale"), F.transform(a, lambda x: F.when(s > 0, F.round(x.cast("double") / s)).otherwise(0).cast("tinyint")).alias("codes")))
