"""Reproducible randomness: every draw is a digest of a salt and a key, the same in any run, order or engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _word(salt, key: Column) -> Column:
    text = F.concat(F.lit(str(salt)), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def bucket(salt, key: Column, n: int) -> Column:
    """An integer from 0 to n-1 for each key; salt and key are joined without a separator."""
    return F.pmod(_word(salt, key), F.lit(n))


def uniform(salt, key: Column) -> Column:
    """A double in [0, 1) for each key."""
    return _word(salt, key) / F.lit(4294967296.0)


def in_validation(salt, key: Column, fraction: float) -> Column:
    """Whether a key is in the validation split: bucket of 1000 below the whole part of 1000 times the fraction."""
    return bucket(salt, key, 1000) < int(fraction * 1000)


def choose(salt, key: Column, options: Column) -> Column:
    """One element of an array for each key; null for an empty or null array."""
    at = F.pmod(_word(salt, key), F.greatest(F.size(options), F.lit(1)).cast("bigint")).cast("int")
    return F.get(options, at)


def weighted_choice(salt, key: Column, weights: list[tuple[str, float]]) -> Column:
    """One name by weight: cumulative shares against a uniform draw."""
    total = sum(w for _, w in weights)
    u, reached, out = uniform(salt, key), 0.0, None
    for name, w in weights[:-1]:
        reached += w / total
        out = F.when(u < reached, F.lit(name)) if out is None else out.when(u < reached, F.lit(name))
    return F.lit(weights[-1][0]) if out is None else out.otherwise(F.lit(weights[-1][0]))


def normal(salt, key: Column) -> Column:
    """A standard normal draw for each key, by Box and Muller from two uniform ones."""
    radius = F.sqrt(-2 * F.log(1 - uniform(f"{salt}a", key)))
    return radius * F.cos(2 * F.pi() * uniform(f"{salt}b", key))
