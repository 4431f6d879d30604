"""Column expressions over ARRAY<DOUBLE>: all stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(x: ColumnLike) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + v)


def dot(x: ColumnLike, y: ColumnLike) -> Column:
    return total(F.zip_with(_c(x), _c(y), lambda a, b: a * b))


def add(x: ColumnLike, y: ColumnLike, scale: Column | float = 1.0) -> Column:
    """x + scale * y."""
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.zip_with(_c(x), _c(y), lambda a, b: a + s * b)


def scaled(x: ColumnLike, s: Column | float) -> Column:
    by = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(_c(x), lambda v: v * by)


def sqdist(x: ColumnLike, y: ColumnLike) -> Column:
    return total(F.zip_with(_c(x), _c(y), lambda a, b: (a - b) * (a - b)))


def norm1(x: ColumnLike) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + F.abs(v))


def literal(values: Sequence[float] | np.ndarray) -> Column:
    """A small vector of the driver as an array."""
    return F.array(*[F.lit(float(v)) for v in np.asarray(values, float).ravel()])


def rows(matrix: np.ndarray) -> list[Column]:
    """The rows of a small matrix of the driver."""
    return [literal(r) for r in np.asarray(matrix, float)]


def matvec(matrix: np.ndarray, x: ColumnLike) -> Column:
    """matrix @ x for a small matrix of the driver."""
    return F.array(*[dot(r, x) for r in rows(matrix)])


def sqdists(x: ColumnLike, points: np.ndarray) -> Column:
    """Squared distances from x to each of a few points."""
    return F.array(*[sqdist(x, p) for p in rows(points)])


def normalised(x: ColumnLike) -> Column:
    """x over its sum: a row of a right-stochastic matrix."""
    s = total(x)
    return F.transform(_c(x), lambda v: v / s)


def simplex_project(x: ColumnLike) -> Column:
    """Euclidean projection on the probability simplex.

    The threshold is the largest of (sum of the k largest - 1) / k over k. A
    vector with NaN gives 0 everywhere.
    """
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k"), F.lit(float("-inf")).alias("theta"))

    def step(a: Column, v: Column) -> Column:
        s, k = a["s"] + v, a["k"] + 1
        return F.struct(s.alias("s"), k.alias("k"), F.greatest(a["theta"], (s - 1) / k).alias("theta"))

    theta = F.aggregate(F.sort_array(_c(x), asc=False), start, step, lambda a: a["theta"])
    return F.transform(_c(x), lambda v: F.when(F.isnan(theta), F.lit(0.0)).otherwise(F.greatest(v - theta, F.lit(0.0))))


def argmin(x: ColumnLike) -> Column:
    """Place of the smallest value from 0, the first one among equals."""
    return (F.array_position(_c(x), F.array_min(_c(x))) - 1).cast("int")


def argmax(x: ColumnLike) -> Column:
    """Place of the largest value from 0, the first one among equals."""
    return (F.array_position(_c(x), F.array_max(_c(x))) - 1).cast("int")


def one_hot(place: ColumnLike, k: int) -> Column:
    return F.array(*[F.when(_c(place) == i, 1.0).otherwise(0.0) for i in range(k)])


def weighted_rows(weights: ColumnLike, matrix: np.ndarray) -> Column:
    """weights @ matrix: a mixture of the matrix's rows."""
    return F.array(*[dot(weights, c) for c in rows(np.asarray(matrix, float).T)])
