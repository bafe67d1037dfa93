"""Lookup tables that are built once and shared by many datasets, and mappings kept from run to run while their files stay the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import shared_dir
from tidemark.sources.sinks import exists


class SharedLookup:
    """A table bucketed and sorted by its key: any number of joins on that key move their own rows only.

    ``buckets`` should be about the lookup's bytes over 128 MB, or what the joined tables are dealt over anyway.
    """

    def __init__(self, spark: SparkSession, name: str, key: str):
        self.spark, self.key = spark, key
        self.name = re.sub(r"\W", "_", f"lookup_{name}")

    @classmethod
    def build(cls, rows: DataFrame, name: str, key: str, buckets: int = 16) -> SharedLookup:
        """Write the lookup, unless a table of that name is there; rows with a null key can't be found and are left out."""
        spark = rows.sparkSession
        out = cls(spark, name, key)
        if not spark.catalog.tableExists(out.name):
            place = f"{shared_dir(spark)}/tidemark/{out.name}"
            dealt = rows.where(F.col(key).isNotNull()).repartition(buckets, key)
            dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", place).saveAsTable(out.name)
        return out

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def join(self, rows: DataFrame, key: str, how: str = "left") -> DataFrame:
        """``rows`` with the lookup's columns, by a merge join that takes the lookup's buckets as they lie; the key column keeps the name ``key``."""
        told = self.rows.hint("merge") if key == self.key else self.rows.withColumnRenamed(self.key, key).hint("merge")
        return rows.join(told, key, how)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")


def group_digests(files: DataFrame, group: Column, rules: str) -> DataFrame:
    """``(group, digest)``: what a group's mapping depends on, its files' paths, lengths and times in any order, and the version of the rules."""
    own = F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")), 256)
    word = lambda k: F.conv(F.substring(own, 1 + 15 * k, 15), 16, 10).cast("bigint")
    parts = [F.bit_xor(word(k)).cast("string") for k in range(4)] + [F.sum(word(k).cast("decimal(38,0)")).cast("string") for k in range(2)]
    told = files.groupBy(group.alias("group")).agg(F.concat_ws("|", F.lit(rules), F.count(F.lit(1)).cast("string"), *parts).alias("t"))
    return told.select("group", F.sha2(F.concat_ws("|", F.col("group").cast("string"), "t"), 256).alias("digest"))


def cached_mapping(files: DataFrame, group: Column, build: Callable[[list[str]], DataFrame], path: str, rules: str = "1") -> DataFrame:
    """``build``'s rows ``(group, ...)`` for all groups of ``files`` ``(path, length, modificationTime)``, taken from the cache at ``path`` where nothing has changed.

    ``build`` gets the paths of the groups that are new or changed, and only these are read.  It must give each row the group of its file.  A group's rows are found by
    its digest, so older ones stay for those who still have the older files.  A finished group is listed last, in one append: what a lost driver leaves
    half done is made again, and its rows count once.  Groups without rows are remembered too.
    """
    spark = files.sparkSession
    now = group_digests(files, group, rules)
    done = spark.read.schema("digest string, run string").parquet(f"{path}/done") if exists(spark, f"{path}/done") else spark.createDataFrame([], "digest string, run string")
    missing = now.join(done, "digest", "left_anti")
    stale = files.withColumn("group", group).join(missing, "group", "left_semi").select("path")
    paths = [r["path"] for r in stale.toLocalIterator()]
    if paths:
        run = spark.range(1).select(F.expr("uuid()")).first()[0]
        made = build(paths).join(missing, "group").withColumn("run", F.lit(run))
        made.write.mode("append").partitionBy("digest", "run").parquet(f"{path}/rows")
        # From the listing as it was before: rows and list agree even if files change meanwhile, as these get another digest.
        missing.select("digest", F.lit(run).alias("run")).write.mode("append").parquet(f"{path}/done")
        done = spark.read.schema("digest string, run string").parquet(f"{path}/done")
    first = done.groupBy("digest").agg(F.min("run").alias("run"))
    if not exists(spark, f"{path}/rows"):
        return build([]).limit(0)
    wanted = now.join(first, "digest").select("digest", "run")
    return spark.read.parquet(f"{path}/rows").join(wanted, ["digest", "run"], "left_semi").drop("digest", "run")
