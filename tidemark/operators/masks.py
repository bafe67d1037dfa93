"""Token classes and the layout of segments with their masks, on words split at white space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: words that name a direction.
DIRECTIONS = "left right forward back backward up down clockwise counterclockwise".split()


def is_number(word: Column) -> Column:
    return word.rlike("[0-9]")


def is_direction(word: Column) -> Column:
    return F.lower(word).rlike(f"^({'|'.join(DIRECTIONS)}),?$")


def is_critical(word: Column) -> Column:
    return is_number(word) | is_direction(word)


def words(text: Column) -> Column:
    """The words of a text; none of a blank or null one."""
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.length(w) > 0)


def layout(rows: DataFrame, segments: list[tuple[str, str, bool]], most: int) -> DataFrame:
    """``rows`` with ``tokens`` (cut at ``most``, filled up with ""), ``length``, ``segment_lengths``, ``loss_mask`` and ``pad_mask``.

    A segment is (name, text column, in the loss); it begins with its marker ``[name]``, which shares the segment's masks.
    """
    parts = [F.concat(F.array(F.lit(f"[{name}]")), words(F.col(c))) for name, c, _ in segments]
    marks = [F.array_repeat(F.lit(loss), F.size(p)) for p, (_, _, loss) in zip(parts, segments, strict=True)]
    out = rows.withColumn("__t", F.concat(*parts)).withColumn("__m", F.concat(*marks)).withColumn("segment_lengths", F.array(*[F.least(F.size(p), F.lit(most)).cast("bigint") for p in parts]))
    out = out.withColumn("length", F.least(F.size("__t"), F.lit(most)).cast("bigint"))
    fill = lambda c, v: F.slice(F.concat(F.col(c), F.array_repeat(F.lit(v), most)), 1, most)
    pad = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: k < F.col("length"))
    return out.withColumn("tokens", fill("__t", "")).withColumn("loss_mask", fill("__m", False)).withColumn("pad_mask", pad).drop("__t", "__m")


def with_dropout(mask: Column, drop: Column) -> Column:
    """The mask, or none of it where a row's reasoning is dropped."""
    return F.transform(mask, lambda x: x & ~drop)
