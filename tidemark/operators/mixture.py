"""Mixing datasets by weight, reproducible shuffles, batches and fair selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import uniform


def quota_sample(rows: DataFrame, weights: DataFrame, dataset: str, key: str, total: int, salt: str = "mix") -> DataFrame:
    """Of each dataset the ``round(weight share * total)`` rows of smallest hash, or all if it has fewer.

    A dataset's cut is found on a histogram of 4096 equal ranges of the hash; rows are ranked within their range only, so a
    dataset with a third of all rows isn't sorted in one task.
    """
    share = weights.withColumn("__quota", F.bround(F.col("weight") / F.sum("weight").over(Window.partitionBy()) * total, 0).cast("bigint"))
    marked = rows.join(share.select(dataset, "__quota"), dataset).withColumn("__u", uniform(salt, F.col(key))).withColumn("__b", F.floor(F.col("__u") * 4096).cast("int"))
    cumulative = Window.partitionBy(dataset).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    counts = marked.groupBy(dataset, "__b").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.sum("__n").over(cumulative) - F.col("__n"))
    placed = marked.join(counts, [dataset, "__b"]).where("__before < __quota")
    rank = F.row_number().over(Window.partitionBy(dataset, "__b").orderBy("__u", key)) + F.col("__before")
    return placed.withColumn("__rank", rank).where("__rank <= __quota").select(*rows.columns)


def shuffled(rows: DataFrame, key: str, salt: str = "shuffle") -> DataFrame:
    """All rows in an order that only salt and key decide."""
    return rows.orderBy(uniform(salt, F.col(key)), key)


def effective_length(sizes: DataFrame) -> DataFrame:
    """How many draws pass the largest dataset once: max of size / weight share."""
    return sizes.withColumn("__w", F.col("weight") / F.sum("weight").over(Window.partitionBy())).agg(F.max(F.col("n") / F.col("__w")).alias("length"))


def allocation(weights: DataFrame, dataset: str, total: int) -> DataFrame:
    """``(dataset, slots)``: whole slots by largest remainder, at least one each; as many rows as there are datasets."""
    exact = F.col("weight") / F.sum("weight").over(Window.partitionBy()) * total
    base = weights.withColumn("__e", exact).withColumn("__f", F.greatest(F.floor("__e"), F.lit(1)).cast("bigint"))
    left = F.lit(total) - F.sum("__f").over(Window.partitionBy())
    nth = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.col("__e") - F.floor("__e")), dataset))
    return base.select(dataset, (F.col("__f") + F.when(nth <= left, 1).otherwise(0)).alias("slots"))


def with_batches(rows: DataFrame, order: Column, key: str, size: int, block_rows: int = 1_000_000) -> DataFrame:
    """``batch`` for each row in the given order (uniform in [0, 1)), without the last partial batch.

    Rows are numbered within equal blocks of the order, about ``block_rows`` each, and by the blocks' running counts; so
    no task sorts more than a block, and one number per block is summed in order.
    """
    blocks = max(64, rows.count() // block_rows)
    ranked = rows.withColumn("__o", order).withColumn("__blk", F.floor(F.col("__o") * blocks).cast("int"))
    counts = ranked.groupBy("__blk").agg(F.count(F.lit(1)).alias("__c"))
    ahead = F.sum("__c").over(Window.partitionBy().orderBy("__blk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")
    counts = counts.withColumn("__ahead", ahead).withColumn("__total", F.sum("__c").over(Window.partitionBy()))
    at = F.row_number().over(Window.partitionBy("__blk").orderBy("__o", key)) - 1 + F.col("__ahead")
    numbered = ranked.join(counts, "__blk").withColumn("batch", F.floor(at / size).cast("bigint"))
    return numbered.where(F.col("batch") < F.floor(F.col("__total") / size)).select(*rows.columns, "batch")


def stepped(batched: DataFrame, steps: int, skip: int = 0, restart: bool = True) -> DataFrame:
    """``step`` for each row of (.., batch): what a loop over the batches takes in ``steps`` steps after leaving out the first ``skip``.

    With ``restart`` the loop begins anew, again after the skipped ones, when the batches end; else it ends with them.
    """
    left = (batched.agg(F.max("batch")).first()[0] or 0) + 1 - skip
    if left <= 0:
        return batched.where("false").withColumn("step", F.lit(0).cast("bigint"))
    first = F.col("batch") - skip
    laps = F.sequence(first, F.lit(steps - 1), F.lit(left)) if restart else F.array(first)
    return batched.where((first >= 0) & (first < steps)).withColumn("step", F.explode(laps))


def nulls_last_places(rows: DataFrame, order: str, key: str, block_rows: int = 1_000_000) -> DataFrame:
    """``place`` from 1 for each row by a numeric ``order``, nulls last, then by a numeric ``key``.

    Rows are numbered within blocks, ranges of ``order`` or for its nulls of ``key`` that hold about as many rows each, and by
    the blocks' running counts.  The cuts between blocks are the only values that reach the driver, one for ``block_rows`` rows.
    """
    blocks = max(64, rows.count() // block_rows)
    at = F.coalesce(order, key)
    steps = F.array(*[F.lit(k / blocks) for k in range(1, blocks)])
    found = rows.groupBy(F.col(order).isNull().alias("last")).agg(F.percentile_approx(at, steps, F.lit(100 * blocks)).alias("cuts")).collect()
    cuts = {r["last"]: sorted(set(r["cuts"] or [])) for r in found}
    block = lambda last: F.size(F.filter(F.array(*[F.lit(c) for c in cuts.get(last, [])]), lambda c: c < at)) if cuts.get(last) else F.lit(0)
    marked = rows.withColumn("__blk", F.when(F.col(order).isNull(), F.greatest(block(True), F.lit(0)) + blocks).otherwise(block(False)))
    counts = marked.groupBy("__blk").agg(F.count(F.lit(1)).alias("__c"))
    ahead = F.sum("__c").over(Window.partitionBy().orderBy("__blk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")
    within = Window.partitionBy("__blk").orderBy(F.asc_nulls_last(order), F.asc_nulls_last(key))
    numbered = marked.join(counts.withColumn("__ahead", ahead), "__blk")
    return numbered.withColumn("place", (F.row_number().over(within) + F.col("__ahead")).cast("bigint")).select(*rows.columns, "place")


def fair_order(rows: DataFrame, group: str, key: str, salt: str = "fair") -> DataFrame:
    """``turn``: the row's place within its group by hash, so that ordering by turn takes groups by turns.

    Followed by a limit on ``turn``, Spark cuts every group down before the shuffle, so large groups cost no more than small ones.
    """
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(uniform(salt, F.col(key)), key)))


def sample_elements(array: Column, k: int, salt: Column) -> Column:
    """``k`` elements of an array of strings, by hash of a salt and the element."""
    marked = F.transform(array, lambda x: F.struct(F.md5(F.concat(salt, x)).alias("h"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(marked), 1, k), lambda s: s["x"])


def epochs(rows: DataFrame, n: int) -> DataFrame:
    """The rows ``n`` times, with ``epoch``."""
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
