"""Array functions on descriptors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with norms floored at 1e-8."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-8)) * F.greatest(norm(b), F.lit(1e-8)))


def observed(a: Column) -> Column:
    """A descriptor of zeros stands for an unobserved point."""
    return a.isNotNull() & F.exists(a, lambda x: x != 0)
