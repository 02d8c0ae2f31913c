"""Vector functions on arrays of numbers, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """VEC1: 0 where either norm is 0; unequal sizes raise. Norms may be given, so that a join computes each once."""
    na, nb = (norm(a) if norm_a is None else norm_a), (norm(b) if norm_b is None else norm_b)
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of unequal size")).cast("double"))
    return checked.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def normalise(a: Column, least: float = 1e-12) -> Column:
    """VEC2: unit length; a vector of norm up to `least` passes through."""
    n = norm(a)
    return F.when(n <= least, _d(a)).otherwise(F.transform(_d(a), lambda x: x / n))


def same_speaker(a: Column, b: Column, threshold: float = 0.25) -> Column:
    """VEC3."""
    return cosine(a, b) >= threshold


def contrast(v: Column, positive: Column, negative: Column) -> Column:
    """VEC4: similarity to one vector less that to another; minus infinity where either is missing."""
    return F.coalesce(cosine(v, positive) - cosine(v, negative), F.lit(float("-inf")))


def hamming(a: Column, b: Column) -> Column:
    """VEC6: differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b))


def minmax_scale(x: Column, low: Column, high: Column) -> Column:
    """MTH2: to 0..1; unchanged where all values are the same."""
    return F.when(high > low, (x - low) / (high - low)).otherwise(x)


def log_softmax(values: Column) -> Column:
    """MTH1 over an array: the largest value is subtracted first."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(values, lambda x: x - top - F.log(total))
