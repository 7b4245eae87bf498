"""Vector distances as column expressions: doubles from float components, summed from left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from findery.schemas import VectorDistance


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    )


def cosine(a: Column, b: Column) -> Column:
    """1 - cos; two zero vectors are 0 apart, a zero vector and another 1."""
    na, nb = dot(a, a), dot(b, b)
    return (
        F.when((na == 0) & (nb == 0), F.lit(0.0))
        .when((na == 0) | (nb == 0), F.lit(1.0))
        .otherwise(1 - dot(a, b) / F.nullif(F.sqrt(na) * F.sqrt(nb), F.lit(0.0)))
    )


def distance(kind: VectorDistance, a: Column, b: Column) -> Column:
    if kind == VectorDistance.L2:
        return squared_l2(a, b)
    if kind == VectorDistance.INNER_PRODUCT:
        return -dot(a, b)
    return cosine(a, b)


def not_finite(vector: Column) -> Column:
    return F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")).cast("float"))
    )
