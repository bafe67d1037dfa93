"""Writers of results: each is one Spark job, whole or absent when executors are lost."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_new(rows: DataFrame, path: str, key: str, done: str = "true") -> None:
    """Append the rows whose key isn't among the finished ones of the table at ``path``."""
    spark = rows.sparkSession
    if exists(spark, path):
        rows = rows.join(spark.read.json(path).where(done).select(key).distinct(), key, "left_anti")
    rows.write.mode("append").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def as_lines(rows: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def write_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").parquet(path)


def read_stats(spark: SparkSession, *paths: str) -> DataFrame | None:
    """The first of several places that holds statistics; the old field name is brought up to date."""
    for path in paths:
        if exists(spark, path):
            found = spark.read.parquet(path)
            return found.withColumn("field", F.when(F.col("field") == "state_eef_pose", "state").otherwise(F.col("field"))) if "field" in found.columns else found
    return None


def audit_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def append_log(rows: DataFrame, path: str) -> bool:
    """Append JSON lines to a log of calls; a log that can't be written is reported and never fails its caller."""
    try:
        rows.write.mode("append").json(path)
        return True
    except (PySparkException, Py4JError) as e:
        logging.getLogger(__name__).warning("log %s not written: %s", path, str(e).splitlines()[0])
        return False


def export_episodes(frames: DataFrame, episodes: DataFrame, key: str, path: str) -> None:
    """Episodes that stand alone: ``path/meta`` has a JSON line for each, ``path/frames`` their frames, clustered by episode."""
    episodes.write.mode("overwrite").json(f"{path}/meta")
    frames.join(episodes.select(key).distinct(), key, "left_semi").repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/frames")
