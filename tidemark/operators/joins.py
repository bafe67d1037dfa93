"""Joins that the data needs beyond equality: lookups with defaults, ranges, bands, as-of, nearest and entity matching.

Range-like joins always carry an equality key, so they plan as hash or merge joins and shuffle by that key, never as nested loops.
A lookup is broadcast by Spark's own size check only; no join here forces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, default=None) -> DataFrame:
    """``rows`` with the table's value, or ``default``; the table's keys must be unique."""
    found = rows.join(table.select(key, value), key, "left")
    return found if default is None else found.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def keep_ranges(rows: DataFrame, ranges: DataFrame, key: str, at: str) -> DataFrame:
    """Rows whose frame lies in one of their key's ranges [start, end): ranges become frames, so the join is on equality."""
    frames = ranges.where(F.col("start") < F.col("end")).select(key, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias(at)) if "end" in ranges.columns else ranges
    return rows.join(frames.distinct(), [key, at], "left_semi")


def first_interval(rows: DataFrame, intervals: DataFrame, key: str, at: str, order: str) -> DataFrame:
    """Each row with the first of its key's intervals [start, end) that holds its frame; rows without one stay with nulls.

    Intervals become frames, the first of each frame is kept, and the join is on equality: rows that share a frame all stay.
    """
    held = [c for c in intervals.columns if c != key]
    frames = intervals.where(F.col("start") < F.col("end")).select(key, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("__at"), F.struct(*held).alias("__held"))
    first = frames.groupBy(key, "__at").agg(F.min_by("__held", F.struct(F.col(f"__held.{order}").isNull(), F.col(f"__held.{order}"))).alias("__held"))
    met = rows.join(first.withColumnRenamed(key, "__key"), (rows[key] == F.col("__key")) & (rows[at] == F.col("__at")), "left")
    return met.select(*[rows[c] for c in rows.columns], *[F.col(f"__held.{c}").alias(c) for c in held])


def near_edges(rows: DataFrame, intervals: DataFrame, key: str, at: str, reach: int) -> DataFrame:
    """Rows within ``reach`` of the start or end of one of their key's intervals: edges become frames, so the join is on equality."""
    edges = intervals.select(key, F.explode(F.array("start", "end")).alias("e"))
    frames = edges.select(key, F.explode(F.sequence(F.col("e") - reach, F.col("e") + reach)).alias(at)).distinct()
    return rows.join(frames, [key, at], "left_semi")


def asof(rows: DataFrame, events: DataFrame, key: str, at: str, value: str, forward: bool = False) -> DataFrame:
    """Each row with the value of the last event at or before its frame (``forward``: of the first one after it), null if none.

    One union, sort and scan by key: no pair of a row and an event is ever formed.
    """
    both = rows.select(*rows.columns, F.lit(1).alias("__side"), F.lit(None).cast(events.schema[value].dataType).alias("__value")).unionByName(
        events.select(key, at, F.lit(0).alias("__side"), F.col(value).alias("__value")), allowMissingColumns=True
    )
    # Backward, an event at the row's frame counts: it sorts first.  Forward, it doesn't: it sorts first too.
    w = Window.partitionBy(key).orderBy(at, "__side")
    if forward:
        found = F.first("__value", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    else:
        found = F.last("__value", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(value, found).where("__side = 1").drop("__side", "__value")


def nearest(rows: DataFrame, events: DataFrame, key: str, at: str, tie_low: bool = True) -> DataFrame:
    """Each row with ``nearest_at``, the closest event's frame; of two as close the earlier one, or with ``tie_low=False`` the later."""
    marks = events.select(key, at, F.col(at).alias("__e")).distinct()
    before = asof(rows, marks, key, at, "__e").withColumnRenamed("__e", "__before")
    after = asof(before, marks, key, at, "__e", forward=True)
    a, b, t = F.col("__before"), F.col("__e"), F.col(at)
    closer = (b - t < t - a) if tie_low else (b - t <= t - a)
    return after.withColumn("nearest_at", F.when(a.isNull() | (b.isNotNull() & closer), b).otherwise(a)).drop("__before", "__e")


def match_entities(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_order: str) -> DataFrame:
    """Each left row with one of the right rows that share its keys: number ``left_id mod candidates`` in ``right_order``."""
    w = Window.partitionBy(*keys)
    numbered = right.withColumn("__k", F.row_number().over(w.orderBy(right_order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    sizes = numbered.groupBy(*keys).agg(F.max("__n").alias("__m"))
    picked = left.join(sizes, keys).withColumn("__k", F.pmod(F.col(left_id), F.col("__m")).cast("int"))
    return picked.join(numbered.drop("__n"), [*keys, "__k"]).drop("__k", "__m")


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left to do after an interruption."""
    return rows.join(done, key, "left_anti")


def merge_insert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows, and those of ``new`` whose key they lack."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def positions(left: DataFrame, right: DataFrame, key: str, at: str) -> DataFrame:
    """A full outer join by key and position, with ``side`` both, left or right."""
    a, b = left.withColumn("__l", F.lit(True)), right.withColumn("__r", F.lit(True))
    side = F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left").otherwise("right")
    return a.join(b, [key, at], "full").withColumn("side", side).drop("__l", "__r")


def first_containing(names: DataFrame, patterns: DataFrame, name: str, pattern: str, priority: str, most: int = 10_000) -> DataFrame:
    """Each name with the pattern equal to it, else the first by priority that it contains, else null.

    Patterns are a registry's: at most ``most`` of them become part of the plan, more are refused.
    """
    found = patterns.select(pattern, priority).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} patterns")
    listed = [r[pattern] for r in sorted(found, key=lambda r: (r[priority], r[pattern]))]
    every = F.array(*[F.lit(p) for p in listed]) if listed else F.array().cast("array<string>")
    exact = F.when(F.array_contains(every, F.col(name)), F.col(name))
    inside = F.get(F.filter(every, lambda p: F.contains(F.col(name), p)), F.lit(0))
    return names.withColumn("matched", F.coalesce(exact, inside))


def composite_key(*parts: Column) -> Column:
    return F.concat_ws("::", *parts)
