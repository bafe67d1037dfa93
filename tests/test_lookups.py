"""Shared lookups join without moving; cached mappings read only what has changed."""

from __future__ import annotations

import os
import re

from pyspark.sql import functions as F

from tidemark.sources import lookups, readers


def test_lookup_side_is_not_exchanged(spark):
    rows = spark.range(2000).select(F.when(F.col("id") != 7, F.col("id")).alias("key"), (F.col("id") * 2).alias("twice"))
    told = lookups.SharedLookup.build(rows, "test-twice", "key", 4)
    try:
        assert lookups.SharedLookup.build(rows.limit(0), "test-twice", "key", 4).rows.count() == 1999  # built once
        for name in ("key", "user"):
            asked = spark.range(0, 3000, 3).select(F.col("id").alias(name), F.lit(name).alias("set"))
            found = told.join(asked, name)
            got = {r[name]: r["twice"] for r in found.collect()}
            assert got == {k: 2 * k if k < 2000 and k != 7 else None for k in range(0, 3000, 3)}
            plan = found._jdf.queryExecution().executedPlan().toString()
            plan = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
            assert len(re.findall(r"\bExchange ", plan)) == 1 and "SortMergeJoin" in plan and "Bucketed: true" in found._jdf.queryExecution().toString()
    finally:
        told.drop()


def test_only_changed_groups_are_read_again(spark, tmp_path):
    source, cache, read = tmp_path / "in", str(tmp_path / "cache"), []
    group = F.element_at(F.split("path", "/"), -2)

    def put(folder, name, text):
        os.makedirs(source / folder, exist_ok=True)
        (source / folder / name).write_text(text)

    def build(paths):
        read.append(len(paths))
        lines = spark.read.text(paths) if paths else spark.createDataFrame([], "value string").withColumn("p", F.lit(""))
        name = F.col("_metadata.file_path") if paths else F.col("p")
        return lines.select(F.element_at(F.split(name, "/"), -2).alias("group"), "value").where("value not like '#%'")

    def mapping(rules="1"):
        return sorted(tuple(r) for r in lookups.cached_mapping(readers.file_listing(spark, str(source)), group, build, cache, rules).select("group", "value").collect())

    for folder in "abc":
        put(folder, "1.txt", f"{folder}1\n{folder}2\n")
        put(folder, "2.txt", f"{folder}3\n")
    whole = [(g, f"{g}{k}") for g in "abc" for k in (1, 2, 3)]
    assert mapping() == whole and read == [6]
    assert mapping() == whole and read == [6]  # a hit reads no file
    put("b", "1.txt", "b9\n")
    assert mapping() == sorted([*[w for w in whole if w[0] != "b"], ("b", "b3"), ("b", "b9")]) and read == [6, 2]
    put("d", "1.txt", "# nothing to map\n")
    mapping()
    assert read == [6, 2, 1] and mapping() and read == [6, 2, 1]  # a group without rows is remembered
    os.remove(source / "c" / "2.txt")
    assert ("c", "c3") not in mapping() and read == [6, 2, 1, 1]
    mapping("2")
    assert read == [6, 2, 1, 1, 6]


def test_empty_listing(spark, tmp_path):
    os.makedirs(tmp_path / "none")
    files = spark.createDataFrame([], "path string, length bigint, modificationTime timestamp")
    build = lambda paths: spark.createDataFrame([], "group string, value string")
    assert lookups.cached_mapping(files, F.col("path"), build, str(tmp_path / "c")).count() == 0
