"""Vector distances over array<float> columns, in double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def magnitude(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / F.greatest(magnitude(a) * magnitude(b), F.lit(1e-10))


def euclidean_distance(a: Column, b: Column) -> Column:
    """Differences in the arrays' own precision, then squared in double."""
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double"))))


def dot_distance(a: Column, b: Column) -> Column:
    return -dot(a, b)


def manhattan_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")))


def normalize(a: Column) -> Column:
    """Unit length; a vector of no length stays."""
    m = magnitude(a)
    return F.when(m > 1e-10, F.transform(a, lambda x: x.cast("double") / m)).otherwise(F.transform(a, lambda x: x.cast("double")))


METRICS = {"cosine": cosine_distance, "euclidean": euclidean_distance, "dot": dot_distance, "manhattan": manhattan_distance}
