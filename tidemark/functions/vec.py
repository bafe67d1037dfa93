"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, by) -> Column:
    return F.transform(a, lambda x: x * by)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def pad(a: Column, length: int, value: float = 0.0) -> Column:
    """Filled up with ``value`` to ``length``, longer vectors stay whole."""
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(a), F.lit(0))))


def pad_or_cut(a: Column, length: int, value: float = 0.0) -> Column:
    """Filled up with ``value`` or cut to ``length``."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(value), length)), 1, length)


def finite(a: Column) -> Column:
    """True if no component is null, NaN or infinite."""
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def joined(*parts: Column) -> Column:
    """The parts one after the other; null parts are left out."""
    return F.concat(*[F.coalesce(p, F.array().cast("array<double>")) for p in parts])
