"""Vector expressions on ARRAY<FLOAT|DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(product: Column, length_a: Column, length_b: Column) -> Column:
    """Cosine from an inner product and two lengths; 0 when either vector is zero or missing."""
    lengths = length_a * length_b
    return F.when(lengths > 0, product / lengths).otherwise(F.lit(0.0))
