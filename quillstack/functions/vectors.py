"""Distances between arrays of numbers. Sums are taken in double; vectors of different length give null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

METRICS = ("cosine", "l2", "ip")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "cosine", b_length: float | None = None) -> Column:
    """cosine: 1 - cos (null for a zero vector); l2: squared Euclidean; ip: 1 - dot. b_length spares the length of a
    vector b that is the same for all rows."""
    if metric == "cosine":
        length = F.sqrt(dot(b, b)) if b_length is None else F.lit(b_length)
        return F.lit(1.0) - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * length, F.lit(0.0))
    if metric == "l2":
        squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
        return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)
    if metric == "ip":
        return F.lit(1.0) - dot(a, b)
    raise ValueError(f"metric must be one of {METRICS}")


def dimensions(v: Column) -> Column:
    return F.size(v)
