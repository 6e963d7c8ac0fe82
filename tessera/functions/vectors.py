"""Vector arithmetic on array columns, in double, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalise(v: Column, eps: float = 1e-6) -> Column:
    length = norm(v) + eps
    return F.transform(doubles(v), lambda x: x / length)


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))


def project(v: Column, mean: Column, axis: Column) -> Column:
    """(v - mean) . axis"""
    centred = F.zip_with(doubles(v), doubles(mean), lambda x, m: x - m)
    return dot(centred, axis)
