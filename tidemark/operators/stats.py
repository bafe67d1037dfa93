"""Statistics of vectors by dimension, and their merging over datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_dimension(rows: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """Wide rows as (keep, dim, x) rows, one for each column."""
    cells = F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("double").alias("x")) for c in columns])
    return rows.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.dim", "c.x")


def moments(long: DataFrame, keys: list[str]) -> DataFrame:
    """n, min, max, mean and population std of the finite values of each key; both are merged from partial sums."""
    good = long.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs(F.col("x")) < float("inf")))
    return good.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def histogram_quantiles(long: DataFrame, keys: list[str], quantiles: list[float], bins: int = 4096) -> DataFrame:
    """``(keys, q, value)``: the left edge of the first of equal bins between min and max where the count reaches q of all; min where they are equal.

    Counts are pre-aggregated, so at most ``bins`` rows of a key meet in the running sum.
    """
    ends = long.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("total"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))
    bin_of = F.coalesce(F.least(F.floor((F.col("x") - F.col("lo")) / span * bins), F.lit(bins - 1)), F.lit(0))
    counts = long.join(ends, keys).withColumn("bin", bin_of).groupBy(*keys, "lo", "hi", "total", "bin").count()
    running = counts.withColumn("cum", F.sum("count").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    edge = F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins
    asked = running.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    return asked.where(F.col("cum") >= F.col("q") * F.col("total")).groupBy(*keys, "q").agg(F.min(edge).alias("value"))


def merged(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics (n, mean, std, q01, q99, lo, hi) of several datasets as one.

    Quantiles are an envelope: the smallest q01 and the largest q99, not quantiles of the union.
    """
    total = stats.groupBy(*keys).agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        (F.sum(F.col("n") * (F.col("std") * F.col("std") + F.col("mean") * F.col("mean"))) / F.sum("n")).alias("__m2"),
        F.min("q01").alias("q01"), F.max("q99").alias("q99"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    return total.withColumn("std", F.sqrt(F.greatest(F.col("__m2") - F.col("mean") * F.col("mean"), F.lit(0.0)))).drop("__m2")


def masked_mean(x: Column, mask: Column) -> Column:
    """The mean of x where the mask holds, 0 if it never does."""
    return F.coalesce(F.sum(F.when(mask, x)), F.lit(0.0)) / F.greatest(F.count_if(mask), F.lit(1))


def shares(rows: DataFrame, key: str) -> DataFrame:
    """``(key, n, percent)`` of all rows; the total is over one row per key."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def token_histogram(rows: DataFrame, text: str, separator: str = ",") -> DataFrame:
    """``(token, n)`` of separated tokens, what stands before their last colon left out."""
    token = F.element_at(F.split(F.trim(F.col("w")), ":"), -1)
    return rows.select(F.explode(F.split(text, separator)).alias("w")).where("trim(w) <> ''").groupBy(token.alias("token")).agg(F.count(F.lit(1)).alias("n"))


def first_seen_counts(rows: DataFrame, keys: list[str], kind: str, order: str) -> DataFrame:
    """``(keys, counted)``: kinds by first appearance with their counts, as ``kind×n,kind×n``."""
    counted = rows.groupBy(*keys, kind).agg(F.min(order).alias("at"), F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("at", F.col(kind).alias("k"), "n")))
    return counted.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda s: F.concat(s["k"], F.lit("×"), s["n"].cast("string"))), ",").alias("counted"))


def quantile_sketches(rows: DataFrame, keys: list[str], value: str, k: int = 200) -> DataFrame:
    """``(keys, n, lo, hi, sketch)``: a KLL sketch of each group's finite values, made by partial aggregation and fit to be stored and merged.

    ``k`` sets the size (about 3 k numbers, whatever the group's size) and the error: at 200 a quantile's true rank lies within 1.65 % of the asked one with 99 % confidence.
    """
    good = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))
    x = F.col(value).cast("double")
    return good.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.kll_sketch_agg_double(x, k).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of all groups that share ``keys``, as if their values had been sketched together."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, shares: list[float]) -> DataFrame:
    """The sketched quantiles as columns ``q<percent>`` beside the other columns; the ends are exact."""
    asked = [F.kll_sketch_get_quantile_double("sketch", F.lit(s)).alias(f"q{round(100 * s)}") for s in shares]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *asked)
