"""Vector measures on array columns, folded from the left in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def norm_or_one(a: Column) -> Column:
    """A zero vector counts as one of length 1."""
    n = norm(a)
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm_or_one(a) * norm_or_one(b))


def part(a: Column, j: int | Column, size: int) -> Column:
    """The j-th slice (from 0) of so many components."""
    return F.slice(a, F.lit(j) * size + 1, F.lit(size))
