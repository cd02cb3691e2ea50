"""Column functions over number arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def padded(a: Column, n: int, fill: int = 0, left: bool = False) -> Column:
    """Exactly n entries: cut at the end, or filled at the end (or in front)."""
    short = F.array_repeat(F.lit(fill), F.greatest(F.lit(0), n - F.size(a)))
    return F.slice(F.concat(short, a) if left else F.concat(a, short), 1, n)
