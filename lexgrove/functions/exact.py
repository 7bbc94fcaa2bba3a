"""Exact combinatorial counts, nearest-rank quantiles, safe rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log10_combinations(n: Column, k: int) -> Column:
    """log10 of n over k; negative infinity outside the domain."""
    out = F.lit(0.0)
    for i in range(1, k + 1):
        out = out + F.log10((n - k + i).cast("double") / i)
    return F.when((n >= k) & (n >= 0), out).otherwise(F.lit(float("-inf")))


def nearest_rank(values: Column, q: float) -> Column:
    """The value at position round-half-even((n - 1) q) of the sorted array; 0 for an empty one."""
    at = (F.rint((F.size(values) - 1) * F.lit(q)) + 1).cast("int")
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), F.greatest(at, F.lit(1)))).otherwise(F.lit(0))


def evenly_spread(values: Column, k: int) -> Column:
    """k values at even steps of the array, ends included, positions rounded half to even; all if there are no more."""
    n = F.size(values)
    if k == 1:
        return F.slice(values, 1, 1)
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.rint(i * (n - 1) / (k - 1)) + 1).cast("int"))
    return F.when(n <= k, values).otherwise(F.transform(F.array_distinct(at), lambda i: F.element_at(values, i)))


def rate(part: Column, whole: Column) -> Column:
    """Null for a zero whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def rate_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(rate(part, whole), F.lit(0.0))
