"""Numeric functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pointmill.config import Axis


def approx(a: Column, b: Column, absolute: float = 1e-6, relative: float = 1e-3) -> Column:
    """Equal within either tolerance."""
    return (F.abs(a - b) <= absolute) | (F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b)))


def axis_value(i: Column, axis: Axis, shift: float = 0.0) -> Column:
    return axis.low + (i + shift) * axis.width


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, factor: Column | float) -> Column:
    return F.transform(a, lambda x: x * factor)


def distance(a: Column, b: Column) -> Column:
    return norm(subtract(a, b))


def cross(a: Column, b: Column) -> Column:
    return F.array(*[a[i] * b[j] - a[j] * b[i] for i, j in ((1, 2), (2, 0), (0, 1))])


def normalized(a: Column) -> Column:
    return scale(a, 1 / norm(a))


def decay(n: Column, kind: str, time: float) -> Column:
    """Linear 1 - n / (2 time), exponential exp(-n / time), or none."""
    return {"linear": F.greatest(F.lit(0.0), 1 - n / (2 * time)), "exponential": F.exp(-n / time), "none": F.lit(1.0)}[kind]


def per_nanometre(q: Column, last: Column) -> Column:
    """q in reciprocal Angstrom: values that reach beyond 1 are taken to be in reciprocal nanometres."""
    return F.when(last > 1, q / 10).otherwise(q)
