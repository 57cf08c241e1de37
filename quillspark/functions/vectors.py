"""Distances and scores of float arrays, added up in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.bind import let

METRICS = ("cosine", "dot", "euclidean")


def _sum(a: Column, b: Column, term) -> Column:
    # the shorter array sets the length
    pairs = F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))
    return F.aggregate(F.filter(pairs, lambda p: p.isNotNull()), F.lit(0.0), lambda s, p: s + p)


def dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where either has no length."""
    both = norm(a) * norm(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / both)


def distance(metric: str, a: Column, b: Column) -> Column:
    return {"cosine": cosine_distance, "dot": lambda x, y: -dot(x, y), "euclidean": euclidean}[metric](a, b)


def score(metric: str, away: Column) -> Column:
    """The larger the nearer: 1 - d, -d or 1 / (1 + d)."""
    return {"cosine": 1 - away, "dot": -away, "euclidean": 1 / (1 + away)}[metric]


def similarity(metric: str, a: Column, b: Column) -> Column:
    return score(metric, distance(metric, a, b))


def normalise(a: Column) -> Column:
    """To length 1; an array without length stays as it is."""
    return let(norm(a), lambda length: F.transform(a, lambda x: x.cast("double") / F.when(length == 0, F.lit(1.0)).otherwise(length)))


def is_valid(a: Column, dimensions: int) -> Column:
    """Not null, of that many components, all of them finite."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(a) == dimensions) & finite, F.lit(False))
