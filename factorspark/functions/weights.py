"""Scalar weighting functions as Column builders."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), x)


def sigmoid_weights(pct: Column, steepness=50.0, center=0.99) -> Column:
    """Logistic weight of a percentile rank."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-float(steepness)) * (pct - F.lit(float(center)))))


def threshold_weights(pct: Column, t: float = 0.95) -> Column:
    """1 at or above the threshold, else 0, missing ranks included."""
    return F.when(~F.isnan(pct) & (pct >= t), F.lit(1.0)).otherwise(F.lit(0.0))


def blend(a: Column, b: Column, alpha: float) -> Column:
    """alpha * a + (1 - alpha) * b."""
    return F.lit(float(alpha)) * a + F.lit(1.0 - alpha) * b


def dot(a: Column, b: Column) -> Column:
    """Inner product of two float arrays, summed in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean norm, 1 where it is 0."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def unit(a: Column) -> Column:
    """The vector over its norm, as doubles; a zero vector stays zero."""
    return F.zip_with(a, F.array_repeat(norm(a), F.size(a)), lambda x, n: x.cast("double") / n)  # the norm is taken once, not per element


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def squash(x: Column, method: str = "tanh") -> Column:
    if method == "tanh":
        return F.tanh(x)
    if method == "clip":
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    raise ValueError(f"no such squashing: {method}")


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function by a rational approximation (error below 1e-7)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * F.abs(x))
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    upper = F.exp(-x * x / 2) * F.lit(0.3989422804014327) * poly
    return F.when(x >= 0, F.lit(1.0) - upper).otherwise(upper)
