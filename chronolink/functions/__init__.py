"""Column expressions shared by callers of the DataFrame API."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def minmax(score: Column, over: WindowSpec) -> Column:
    """Score scaled to 0 to 1 within a window; constant windows give 0."""
    low, high = F.min(score).over(over), F.max(score).over(over)
    return (score - low) / F.greatest(high - low, F.lit(1e-12))


def decay(age: Column, tau: Column | float) -> Column:
    return F.exp(-age / tau)


def last_k(values: Column, k: int) -> Column:
    """The last k elements of an array, all if it has fewer."""
    return F.slice(values, F.greatest(F.size(values) - k, F.lit(0)) + 1, k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays as sets; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def half_even_quota(share: float, width: int) -> Column:
    """A share of a width, rounded half to even."""
    return F.bround(F.lit(share * width)).cast("int")
