"""Functions of vectors and fingerprints, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: positions of a fingerprint that count.
POSITIONS = 120


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of double arrays of equal length, 0 where a product of norms is next to nothing."""
    product = norm(a) * norm(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (product <= 1e-6), 0.0).otherwise(dot(a, b) / product)


def fingerprint_similarity(a: Column, b: Column, tolerance: int = 10) -> Column:
    """Share of the common first positions whose values are less than ``tolerance`` apart; 0 for none."""
    n = F.least(F.size(a), F.size(b), F.lit(POSITIONS))
    near = F.zip_with(F.slice(a, 1, F.greatest(n, F.lit(0))), F.slice(b, 1, F.greatest(n, F.lit(0))), lambda x, y: F.when(F.abs(x - y) < tolerance, 1).otherwise(0))
    return F.when(n <= 0, 0.0).otherwise(F.aggregate(near, F.lit(0), lambda s, x: s + x) / n)


def upper_median(values: Column, default: int = 30_000) -> Column:
    """The element at half the length of the sorted array."""
    return F.coalesce(F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int")), F.lit(default))
