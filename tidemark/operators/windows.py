"""Windows along an episode.

``Episode`` names the columns that identify an episode and order its frames; the order must be unique.  All operators of one
episode share one exchange and sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import rot


@dataclass(frozen=True)
class Episode:
    key: tuple[str, ...] = ("episode_id",)
    order: tuple[str, ...] = ("t",)

    @property
    def ordered(self):
        return Window.partitionBy(*self.key).orderBy(*self.order)

    @property
    def whole(self):
        return self.ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    @property
    def before(self):
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def after(self):
        return self.ordered.rowsBetween(0, Window.unboundedFollowing)

    def around(self, back: int, ahead: int):
        return self.ordered.rowsBetween(-back, ahead)


def number_frames(rows: DataFrame, ep: Episode, name: str = "t") -> DataFrame:
    """A frame number from 0 on in each episode."""
    return rows.withColumn(name, F.row_number().over(ep.ordered) - 1)


def _ahead(value: Column, size: int, ep: Episode) -> Column:
    """This value and the next ones, nulls in their places; shorter at the episode's end."""
    return F.transform(F.collect_list(F.struct(value.alias("v"))).over(ep.around(0, size - 1)), lambda s: s["v"])


def window_zero_padded(value: Column, size: int, ep: Episode, lengths: Column | None = None, zero: Column | None = None) -> Column:
    """The next ``size`` values as an array, zeros past the episode's end and, with ``lengths``, past the row's own length; nulls stay in their places."""
    zero = F.lit(0.0) if zero is None else zero
    seen = _ahead(value, size, ep)
    full = F.concat(seen, F.array_repeat(zero, F.lit(size) - F.size(seen)))
    return full if lengths is None else F.transform(full, lambda x, k: F.when(k < lengths, x).otherwise(zero))


def window_last_padded(value: Column, size: int, ep: Episode, lengths: Column | None = None) -> Column:
    """As ``window_zero_padded`` with the last value repeated; ``lengths`` holds each row at its own last element."""
    seen = _ahead(value, size, ep)
    full = F.concat(seen, F.array_repeat(F.element_at(seen, -1), F.lit(size) - F.size(seen)))
    return full if lengths is None else F.transform(full, lambda x, k: F.get(full, F.least(k, lengths - 1)))


def delta_to_next(value: Column, ep: Episode) -> Column:
    """The next value minus this one, 0 for the last row."""
    return F.coalesce(F.lead(value).over(ep.ordered) - value, F.lit(0.0))


def relabelled(rows: DataFrame, value: str, ep: Episode, name: str = "delta") -> DataFrame:
    """The delta to the next row, without each episode's last row; null where either value is null."""
    after = rows.withColumn("__next", F.lead(F.struct(F.col(value).alias("v"))).over(ep.ordered))
    return after.where("__next is not null").withColumn(name, F.col("__next.v") - F.col(value)).drop("__next")


def without_first(rows: DataFrame, ep: Episode) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(ep.ordered)).where("__n > 1").drop("__n")


def filled_gripper(g: Column, ep: Episode, threshold: float = 0.95) -> Column:
    """1 above the threshold, 0 below its counterpart, else the next decided value; at the end, the raw last value."""
    decided = F.when(g > threshold, 1.0).when(g < 1 - threshold, 0.0)
    return F.coalesce(F.first(decided, True).over(ep.after), F.last(g).over(ep.whole))


def absolute_gripper(g: Column, ep: Episode, least: float = 0.1) -> Column:
    """Open (1) or closed (0) from relative commands, +1 closing and -1 opening; before the first command its opposite, open if there is none."""
    command = F.when(g < -least, 1).when(g > least, -1)
    state = F.coalesce(F.last(command, True).over(ep.before), -F.first(command, True).over(ep.after), F.lit(1))
    return state / 2.0 + 0.5


def future_frame(value: Column, ahead: int, ep: Episode) -> Column:
    """The value ``ahead`` frames later, or the episode's last one."""
    return F.coalesce(F.lead(value, ahead).over(ep.ordered), F.last(value).over(ep.whole))


def chunk_relative(value: Column, size: int, ep: Episode) -> Column:
    """The next ``size`` positions relative to this one, the last repeated."""
    window = window_last_padded(value, size + 1, ep)
    return F.transform(F.slice(window, 2, size), lambda x: x - F.element_at(window, 1))


def chunk_poses(pose: list[Column], grip: Column, size: int, ep: Episode, joint: bool = False) -> Column:
    """The next ``size`` actions, each an array of seven numbers, the last row repeated.

    Joint positions stay as they are from this row on.  Poses (x, y, z, roll, pitch, yaw) are those of the rows after this
    one, as moves and turns from this one; their gripper is that of the row before.
    """
    names = [f"p{k}" for k in range(6)]
    row = F.struct(*[c.alias(n) for c, n in zip(pose, names, strict=True)], grip.alias("g"))
    if joint:
        return F.transform(window_last_padded(row, size, ep), lambda x: F.array(*[x[n] for n in names], x["g"]))
    window = window_last_padded(row, size + 1, ep)
    here = F.element_at(window, 1)
    turn = lambda x: rot.relative_euler([x[n] for n in names[3:]], [here[n] for n in names[3:]])
    return F.transform(F.slice(window, 2, size), lambda x, k: F.array(*[x[n] - here[n] for n in names[:3]], *turn(x), F.get(window, k)["g"]))


def near_flag(flag: Column, reach: int, ep: Episode) -> Column:
    return F.coalesce(F.max(flag.cast("int")).over(ep.around(reach, reach)), F.lit(0)) == 1


def pattern_of_three(kind: Column, at: Column, names: tuple[str, str, str], within: int, ep: Episode) -> Column:
    """True on the third of three consecutive events of the given kinds within a span."""
    w = ep.ordered
    same = (F.lag(kind, 2).over(w) == names[0]) & (F.lag(kind, 1).over(w) == names[1]) & (kind == names[2])
    return F.coalesce(same & (at - F.lag(at, 2).over(w) <= within), F.lit(False))


def runs(rows: DataFrame, value: str, ep: Episode) -> DataFrame:
    """Maximal stretches of an equal value: key, run, value, start, end (exclusive) of the order column."""
    order = ep.order[0]
    opens = F.coalesce((F.lag(value).over(ep.ordered) != F.col(value)).cast("int"), F.lit(1))
    numbered = rows.withColumn("__opens", opens).withColumn("run", F.sum("__opens").over(ep.before))
    return numbered.groupBy(*ep.key, "run").agg(F.first(value).alias(value), F.min(order).alias("start"), (F.max(order) + 1).alias("end"))


def evenly_spaced(rows: DataFrame, n: int, ep: Episode) -> DataFrame:
    """``n`` frames of each episode from its first to its last, by whole positions; fewer in shorter episodes."""
    last = F.count(F.lit(1)).over(ep.whole) - 1
    at = F.row_number().over(ep.ordered) - 1
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("__last") / F.lit(float(max(n - 1, 1)))))
    numbered = rows.withColumn("__last", last).withColumn("__at", at)
    return numbered.where(F.array_contains(wanted, F.col("__at").cast("bigint"))).drop("__last", "__at")


def trajectory_digest(rows: DataFrame, value: str, ep: Episode, ends: int = 64) -> DataFrame:
    """One digest per episode, of its first and last ``ends`` values where it is longer than both together."""
    n = F.count(F.lit(1)).over(ep.whole)
    at = F.row_number().over(ep.ordered)
    kept = rows.withColumn("__n", n).withColumn("__at", at).where((F.col("__at") <= ends) | (F.col("__at") > F.col("__n") - ends))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", F.col(value).cast("string").alias("v")))), lambda s: s["v"]), ",")
    return kept.groupBy(*ep.key).agg(F.md5(text).alias("digest"))
