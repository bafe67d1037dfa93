"""Named queries over the fixture tables, each with SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import Episode

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
EP = Episode()

#: Frames in SQL: an episode is a user, its frames are the user's events in order; g is a signal from 0 to 1.
FRAMES = """frames as (select user_id as episode_id, row_number() over (partition by user_id order by ts, event_id) - 1 as t,
  event_id, ts, value, value - floor(value) as g, event_type, props from events)"""
#: Poses in SQL: an episode is a label, its frames are the vectors in order.
POSES = "poses as (select label as episode_id, row_number() over (partition by label order by vec_id) - 1 as t, vec_id, " + ", ".join(f"embedding[{k}]::double as e{k}" for k in range(1, 17)) + " from embeddings)"


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under a name."""

    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("episode_id"), (F.row_number().over(w) - 1).cast("bigint").alias("t"), "event_id", "ts", "value",
        (F.col("value") - F.floor("value")).alias("g"), "event_type", "props",
    )


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    parts = [F.get("embedding", F.lit(k - 1)).cast("double").alias(f"e{k}") for k in range(1, 17)]
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("episode_id"), (F.row_number().over(w) - 1).cast("bigint").alias("t"), "vec_id", *parts)


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded, without negative zeros."""
    return F.round(value, digits) + F.lit(0.0)
