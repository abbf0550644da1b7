"""Vector expressions over array columns, for pairs that already meet in one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def cosine(a: Column, b: Column, floor: float = 1e-9) -> Column:
    """Cosine with a small term in the denominator, so that zero vectors give 0."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(floor))
