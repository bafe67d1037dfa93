"""Greedy scans of an episode's ordered elements, as folds over a sorted array.

Each element is met once with a state of fixed size, and only what is kept is appended.  An episode's elements must fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trend_runs(values: Column, start_at: float = 1.0, tolerate: float = 2.0, least: float = 20.0) -> Column:
    """array<struct<start, rise>> of maximal runs of one direction whose total change reaches ``least``.

    A run starts before the first step of ``start_at`` or more, and ends before a step that goes back by more than ``tolerate``.
    """
    state = "struct<dir:int,start:int,at:int,last:double,from:double,out:array<struct<start:int,rise:boolean>>>"

    def closed(s: Column) -> Column:
        change = s["last"] - s["from"]
        event = F.array(F.struct(s["start"].alias("start"), (change > 0).alias("rise")))
        return F.when((s["dir"] != 0) & (F.abs(change) >= least), F.concat(s["out"], event)).otherwise(s["out"])

    def step(s: Column, x: Column) -> Column:
        d = x - s["last"]
        turns = ((s["dir"] == 0) & (F.abs(d) >= start_at)) | ((s["dir"] != 0) & (d * s["dir"] < -tolerate))
        return F.struct(
            F.when(turns, F.signum(d).cast("int")).otherwise(s["dir"]).alias("dir"),
            F.when(turns, s["at"]).otherwise(s["start"]).alias("start"),
            (s["at"] + 1).alias("at"),
            x.alias("last"),
            F.when(turns, s["last"]).otherwise(s["from"]).alias("from"),
            F.when(turns, closed(s)).otherwise(s["out"]).alias("out"),
        ).cast(state)

    none = F.array().cast("array<struct<start:int,rise:boolean>>")
    first = F.get(values, F.lit(0))
    begin = F.struct(F.lit(0).alias("dir"), F.lit(0).alias("start"), F.lit(0).alias("at"), first.alias("last"), first.alias("from"), none.alias("out")).cast(state)
    return F.when(F.size(values) < 2, none).otherwise(F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), begin, step, closed))


def suppress_near(times: Column, gap: int) -> Column:
    """Of times in order of preference, those at least ``gap`` from every earlier kept one; array<int>."""
    none = F.array().cast("array<int>")
    keep = lambda kept, t: F.when(F.exists(kept, lambda k: F.abs(k - t) < gap), kept).otherwise(F.concat(kept, F.array(t)))
    return F.aggregate(times, none, keep)


def merge_close(keyframes: Column, gap: int) -> Column:
    """Of array<struct<t, prio, kind>> by time, without those closer than ``gap`` to the last kept one, unless they matter more.

    The first one and the one of kind ``end`` always stay, and none replaces one of kind ``begin``.
    """
    kind = "array<struct<t:int,prio:int,kind:string>>"

    def step(kept: Column, k: Column) -> Column:
        last = F.element_at(kept, -1)
        one = F.array(k)
        close = (k["t"] - last["t"] < gap) & (last["kind"] != "begin") & (k["kind"] != "end")
        better = F.concat(F.slice(kept, 1, F.size(kept) - 1), one)
        return F.when(F.size(kept) == 0, one).otherwise(F.when(~close, F.concat(kept, one)).when(k["prio"] > last["prio"], better).otherwise(kept)).cast(kind)

    return F.when(F.size(keyframes) <= 2, keyframes.cast(kind)).otherwise(F.aggregate(keyframes.cast(kind), F.array().cast(kind), step))


def segments(cuts: Column, length: Column, least: int = 6) -> Column:
    """array<struct<start, end>>: the stretches between cuts, none shorter than ``least`` frames but where the whole is.

    Cuts outside (0, length) don't count; a cut too soon after the last one is passed over, and a short tail joins the stretch before.
    """
    inside = F.array_sort(F.array_distinct(F.filter(cuts.cast("array<int>"), lambda c: (c > 0) & (c < length))))
    points = F.aggregate(inside, F.array(F.lit(0)), lambda p, c: F.when(c - F.element_at(p, -1) >= least, F.concat(p, F.array(c))).otherwise(p))
    short_tail = (F.size(points) > 1) & (length - F.element_at(points, -1) < least)
    starts = F.when(short_tail, F.slice(points, 1, F.size(points) - 1)).otherwise(points)
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(length.cast("int")))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def lanes(intervals: Column) -> Column:
    """array<int>: a lane for each of array<struct<start, end>> by start: the first lane whose last interval has ended."""
    state = "struct<ends:array<int>,out:array<int>>"

    def step(s: Column, i: Column) -> Column:
        free = F.array_position(F.transform(s["ends"], lambda e: e <= i["start"]), True).cast("int")
        at = F.when(free > 0, free - 1).otherwise(F.size(s["ends"]))
        ends = F.when(free > 0, F.transform(s["ends"], lambda e, k: F.when(k == at, i["end"]).otherwise(e))).otherwise(F.concat(s["ends"], F.array(i["end"])))
        return F.struct(ends.alias("ends"), F.concat(s["out"], F.array(at)).alias("out")).cast(state)

    none = F.array().cast("array<int>")
    return F.aggregate(intervals, F.struct(none.alias("ends"), none.alias("out")).cast(state), step, lambda s: s["out"])


def ordered_product(turns: Column) -> Column:
    """The product of 3x3 rotations (arrays of nine, by row), in order; the identity for none."""
    unit = F.array(*[F.lit(float(k in (0, 4, 8))) for k in range(9)])
    cell = lambda a, b, i, j: sum((F.get(a, F.lit(3 * i + k)) * F.get(b, F.lit(3 * k + j)) for k in range(1, 3)), F.get(a, F.lit(3 * i)) * F.get(b, F.lit(j)))
    return F.aggregate(turns, unit, lambda a, b: F.array(*[cell(a, b, i, j) for i in range(3) for j in range(3)]))
