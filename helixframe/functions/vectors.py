"""Vector folds as array expressions: A3, A4, F24."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products over a's elements; what b lacks counts as 0, what it has beyond a is left."""
    products = F.zip_with(a, F.slice(b, F.lit(1), F.size(a)), lambda x, y: x.cast("double") * F.coalesce(y.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def magnitude(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(query: Column, vector: Column) -> Column:
    """0 for a zero vector; the query must not be zero."""
    size = magnitude(vector)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(query, vector) / (magnitude(query) * size))
