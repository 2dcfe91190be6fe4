"""Vectors as array columns, and a block product for large candidate sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    n = norm(a) + F.lit(EPS)
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + F.lit(EPS)) * (norm(b) + F.lit(EPS)))


def euclidean_similarity(a: Column, b: Column) -> Column:
    """One over one plus the distance of the unit vectors."""
    d = F.zip_with(unit(a), unit(b), lambda x, y: x - y)
    return F.lit(1.0) / (F.lit(1.0) + norm(d))


def is_usable(a: Column, length: int) -> Column:
    return (F.size(a) == length) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(a, lambda x: x != 0)
