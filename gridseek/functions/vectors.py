"""Expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def log_sigmoid(x: Column) -> Column:
    """Stable for large numbers of either sign."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def mean_pool(vectors: Column, mask: Column, dim: int) -> Column:
    """Mean of the vectors (array of arrays) whose mask is 1."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda e: e["m"] == 1)
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(kept, zero, lambda s, e: F.zip_with(s, e["v"], lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / F.size(kept))


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    powers = F.transform(x, lambda v: F.exp(v - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, v: s + v)
    return F.transform(powers, lambda v: v / total)


def kl_divergence(p: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.when(a > 0, a * (F.log(a) - F.log(b))).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
