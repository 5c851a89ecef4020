"""Similarity of double arrays as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: str | Column) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """Null where a norm is zero, unless epsilon is added to the product of the norms."""
    size = norm(a) * norm(b) + F.lit(epsilon)
    return F.when(size > 0, dot(a, b) / size)


def negative_euclidean(a: Column, b: Column) -> Column:
    return F.lit(0.0) - F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine, dot or euclidean (the negative distance); any other name is 0."""
    return {"cosine": lambda: cosine(a, b, 1e-8), "dot": lambda: dot(a, b), "euclidean": lambda: negative_euclidean(a, b)}.get(metric, lambda: F.lit(0.0))()
