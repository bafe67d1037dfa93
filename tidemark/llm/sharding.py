"""Sharding by a two-pass external shuffle.

Pass one scatters the rows uniformly into buckets that fit in memory, by a seeded hash.  Pass two permutes each
bucket with a seeded Fisher-Yates shuffle.  The buckets laid end to end are a uniform permutation of the whole
table (Rao's scheme), which is then cut into shards whose row counts differ by one at most: the law ``rows``.
Copies of a text, rows of one source and repeated keys are spread like any others, so no shard or bucket is hot.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation of 0..n-1: position i swaps with a uniform position not after it."""
    order = np.arange(n)
    if n > 1:
        picks = np.random.default_rng(seed).integers(0, np.arange(n, 0, -1))
        for i, j in zip(range(n - 1, 0, -1), picks.tolist(), strict=False):
            if i != j:
                order[i], order[j] = order[j], order[i]
    return order


def shuffled(
    rows: DataFrame, n_shards: int, text: str = "text", seed: int = 0, bucket_bytes: int = 16 << 20
) -> DataFrame:
    """``rows`` with ``shard`` int and ``slot`` long (gapless from 0 in each shard), in shuffled order.

    ``bucket_bytes`` bounds what one task holds: the buckets are as many as the table's bytes need.  Only one count per
    bucket goes to the driver, 8 bytes for each ``bucket_bytes`` of input.  A row is scattered by the seed and its place in the input, so
    repeated rows and keys spread too; its place is the same when a task runs again, as long as the input is
    a file scan or a written table.  Null texts count as no bytes.  An empty table gives an empty result.  Columns of ``rows``
    named ``shard`` or ``slot`` are replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + F.lit(8) if text else F.lit(8)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).first()
    n_rows, n_bytes = total["n"], total["bytes"] or 0
    n_buckets = max(2 * n_shards, math.ceil(n_bytes / bucket_bytes), math.ceil(n_rows / 2_000_000))
    place = F.monotonically_increasing_id()
    placed = rows.withColumn("__place", place).withColumn(
        "__bucket", F.pmod(F.xxhash64(F.lit(seed), F.col("__place")), F.lit(n_buckets)).cast("int")
    )
    counts = np.zeros(n_buckets + 1, dtype=np.int64)
    for bucket, n in (
        rows.select(F.pmod(F.xxhash64(F.lit(seed), place), F.lit(n_buckets)).cast("int").alias("b")).groupBy("b").count().collect()
    ):
        counts[bucket + 1] = n
    start = np.cumsum(counts)
    starts = spark.sparkContext.broadcast(start)
    ends = np.array([(k * n_rows) // n_shards for k in range(n_shards + 1)], dtype=np.int64)
    out = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def permute(bucket: pa.Table) -> pa.Table:
        b = bucket.column("__bucket")[0].as_py()
        by_place = np.argsort(bucket.column("__place").to_numpy(), kind="stable")
        order = by_place[fisher_yates(bucket.num_rows, (seed << 32) + b)]
        at = starts.value[b] + np.arange(bucket.num_rows)
        shard = np.searchsorted(ends, at, side="right") - 1
        bucket = bucket.drop_columns(["__place", "__bucket"]).take(pa.array(order))
        bucket = bucket.append_column("shard", pa.array(shard.astype(np.int32)))
        return bucket.append_column("slot", pa.array(at - ends[shard]))

    return placed.groupBy("__bucket").applyInArrow(permute, out)


def write_shards(rows: DataFrame, path: str, n_shards: int, **options) -> None:
    """Write each bucket into its shard's folder, ordered by slot within every file."""
    shuffled(rows, n_shards, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
