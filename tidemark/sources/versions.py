"""A table that writers replace whole, one after another, and that readers always see whole.

Every version is a folder of its own, named by a small file with the version's number.  Such a file is made only if it isn't there yet, so of two
writers that change the same version one wins and the other hears of it and changes the new one.  This needs a store that makes a file or fails in one step, as HDFS does.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer has made this version."""


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def current(spark: SparkSession, path: str) -> int:
    """The newest version's number, 0 if there is none."""
    fs, to_path = _store(spark, path)
    folder = to_path(f"{path}/versions")
    if not fs.exists(folder):
        return 0
    return max((int(s.getPath().getName().split("-")[0]) for s in fs.listStatus(folder)), default=0)


def _folder(spark: SparkSession, path: str, version: int) -> str:
    fs, to_path = _store(spark, path)
    (mark,) = [s.getPath().getName() for s in fs.listStatus(to_path(f"{path}/versions")) if s.getPath().getName().split("-")[0] == f"{version:012d}"]
    with_name = fs.open(to_path(f"{path}/versions/{mark}"))
    try:
        return f"{path}/{with_name.readUTF()}"
    finally:
        with_name.close()


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version, or a numbered one."""
    return spark.read.parquet(_folder(spark, path, version or current(spark, path)))


def publish(rows: DataFrame, path: str, after: int) -> int:
    """Write ``rows`` as the version that follows ``after``; raises ``Conflict`` and leaves no trace if there is one already."""
    spark = rows.sparkSession
    fs, to_path = _store(spark, path)
    name = f"data-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    try:
        out = fs.create(to_path(f"{path}/versions/{after + 1:012d}"), False)
    except Py4JJavaError as e:
        fs.delete(to_path(f"{path}/{name}"), True)
        if "FileAlreadyExists" in str(e.java_exception.getClass()):
            raise Conflict(f"version {after + 1} of {path} is there already") from None
        raise
    out.writeUTF(name)
    out.close()
    return after + 1


def update(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame], tries: int = 10) -> int:
    """Replace the newest version by what ``change`` makes of it (of nothing at first); done again if another writer was faster."""
    for _ in range(tries):
        at = current(spark, path)
        try:
            return publish(change(read(spark, path, at) if at else None), path, at)
        except Conflict:
            continue
    raise Conflict(f"{tries} tries to change {path} came too late")


def prune(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the newest ``keep`` versions."""
    fs, to_path = _store(spark, path)
    newest = current(spark, path)
    for status in fs.listStatus(to_path(f"{path}/versions")) if newest else []:
        version = int(status.getPath().getName().split("-")[0])
        if version <= newest - keep:
            fs.delete(to_path(_folder(spark, path, version)), True)
            fs.delete(status.getPath(), False)
