"""Column functions on values and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def minkowski(a: Column, b: Column, p: float = 3) -> Column:
    """Minkowski distance of order ``p`` of two arrays."""
    powers = F.zip_with(a, b, lambda x, y: F.pow(F.abs(x.cast("double") - y.cast("double")), F.lit(float(p))))
    return F.pow(total(powers), F.lit(1.0 / p))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(total(squares))


def minkowski_similarity(distance: Column, longest: Column) -> Column:
    """``exp(-5 d / longest)`` of a Minkowski distance."""
    return F.exp(-5.0 * distance / longest)


def euclidean_similarity(a: Column, b: Column) -> Column:
    return 1 / (1 + euclidean(a, b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if one has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def finite(value: Column) -> Column:
    """The value, or 0 where it is missing, NaN or infinite."""
    value = value.cast("double")
    broken = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(broken, 0.0).otherwise(value)


def vector_distance(dists: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    """Length of a vector of source distances; one source alone keeps its value.

    ``weights`` defaults to ones and any number of dimensions is accepted.
    """
    if len(dists) == 1 and weights is None:
        return dists[0]
    weights = [1.0] * len(dists) if weights is None else list(weights)
    if len(weights) != len(dists):
        raise ValueError("one weight per dimension is needed")
    squares = [w * d * d for w, d in zip(weights, dists)]
    return F.sqrt(sum(squares[1:], squares[0]))


def rounded_distance(distance: Column, digits: int = 8) -> Column:
    return F.round(distance, digits)


def score(value: Column, digits: int = 4) -> Column:
    """Scores of the text sources are kept to four digits."""
    return F.round(value, digits)


def log_shifted(value: Column) -> Column:
    return F.log(value + 1e-6)
