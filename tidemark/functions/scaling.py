"""Normalisation and rescaling of vectors against statistics of the same length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def standardized(x: Column, mean: Column, std: Column, eps: float = 1e-6) -> Column:
    return (x - mean) / (std + eps)


def unstandardized(x: Column, mean: Column, std: Column, eps: float = 1e-6) -> Column:
    return x * (std + eps) + mean


def bounded(x: Column, low: Column, high: Column, eps: float = 1e-8, clip: bool = True) -> Column:
    """From [low, high] to [-1, 1]; ``clip`` holds values from outside there."""
    y = (x - low) / (high - low + eps) * 2.0 - 1.0
    return F.least(F.greatest(y, F.lit(-1.0)), F.lit(1.0)) if clip else y


def unbounded(x: Column, low: Column, high: Column, eps: float = 1e-8) -> Column:
    return (x + 1.0) / 2.0 * (high - low + eps) + low


def rescaled(x: Column, low: float, high: float, to_low: float = -1.0, to_high: float = 1.0, margin: float = 0.0) -> Column:
    """From [low, high] to [to_low, to_high], held inside it by ``margin``."""
    y = (x - low) / (high - low) * (to_high - to_low) + to_low
    return F.least(F.greatest(y, F.lit(to_low + margin)), F.lit(to_high - margin))


def vector(fn, x: Column, a: Column, b: Column, **options) -> Column:
    """``fn`` by component; components beyond the statistics pass through."""
    zipped = F.arrays_zip(x.alias("x"), a.alias("a"), b.alias("b"))
    return F.transform(zipped, lambda z: F.when(z["a"].isNull(), z["x"]).otherwise(fn(z["x"], z["a"], z["b"], **options)))


def state_bins(x: Column, n_bins: int = 256) -> Column:
    """The bin of a state in [-1, 1]: -1 below, the last bin from its left edge on."""
    return F.when(x < -1.0, F.lit(-1)).otherwise(F.least(F.floor((x + 1.0) / 2.0 * n_bins), F.lit(n_bins - 1))).cast("int")
