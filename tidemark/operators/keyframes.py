"""Keyframes of an episode: its ends, gripper trends, retries, changes of motion, and fillers in long gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import folds
from tidemark.operators.windows import Episode, pattern_of_three

#: What wins where two rules name one frame, and among close keyframes.
PRECEDENCE = {"begin": 0, "end": 0, "retry": 1, "grasp": 1, "release": 1, "motion": 2, "filler": 3}
PRIORITY = {"begin": 5, "end": 5, "grasp": 4, "release": 4, "retry": 4, "motion": 2, "filler": 1}


def gripper_label(g: Column) -> Column:
    """open, partial or closed of a command from 0 (open) to 1 (closed)."""
    percent = (1.0 - g) * 100.0
    return F.when(percent > 80, "open").when(percent < 20, "closed").otherwise("partial")


def gripper_events(frames: DataFrame, ep: Episode, g: str = "g") -> DataFrame:
    """``(key, t, kind)``: grasp where a closing trend starts, release where an opening one does."""
    series = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ep.order[0]).alias("t"), F.col(g).alias("g")))), lambda s: (1.0 - s["g"]) * 100.0)
    found = frames.groupBy(*ep.key).agg(folds.trend_runs(series).alias("e"))
    return found.select(*ep.key, F.explode("e").alias("e")).select(*ep.key, F.col("e.start").alias("t"), F.when(F.col("e.rise"), "release").otherwise("grasp").alias("kind"))


def with_retries(events: DataFrame, ep: Episode, fps: float = 15.0, seconds: float = 1.5) -> DataFrame:
    """The events with ``retry`` for a grasp that follows grasp and release within the window."""
    again = pattern_of_three(F.col("kind"), F.col("t"), ("grasp", "release", "grasp"), int(seconds * fps), ep)
    return events.withColumn("kind", F.when(again, "retry").otherwise(F.col("kind")))


def motion_changes(frames: DataFrame, ep: Episode, position: tuple[str, str, str], fps: float = 15.0, window: int = 10) -> DataFrame:
    """``(key, t, cosine)``: frames where the mean velocity before and after differs in direction or speed.

    A flip has a cosine under 0.3 with over 0.02 m/s on both sides; a change of speed is over 0.05 m/s.
    """
    w, order = ep.ordered, ep.order[0]
    steps = frames
    for k, c in enumerate(position):
        steps = steps.withColumn(f"__v{k}", (F.col(c) - F.lag(c).over(w)) * fps)
    n = F.count(F.lit(1)).over(ep.whole)
    # Velocity number k belongs to frame k + 1: before frame t are those of t-window to t-1, after it those of t to t+window-1.
    before, after = [[F.avg(f"__v{k}").over(ep.around(*reach)) for k in range(3)] for reach in ((window, -1), (0, window - 1))]
    for k in range(3):
        steps = steps.withColumn(f"__b{k}", before[k]).withColumn(f"__a{k}", after[k])
    length = lambda p: F.sqrt(sum((F.col(f"__{p}{k}") * F.col(f"__{p}{k}") for k in (1, 2)), F.col(f"__{p}0") * F.col(f"__{p}0")))
    inner = sum((F.col(f"__b{k}") * F.col(f"__a{k}") for k in (1, 2)), F.col("__b0") * F.col("__a0"))
    measured = steps.withColumn("__n", n).withColumn("__sb", length("b")).withColumn("__sa", length("a")).withColumn("cosine", inner / (F.col("__sb") * F.col("__sa") + 1e-6))
    at = F.col(order)
    room = (at >= window + 1) & (at <= F.col("__n") - 1 - window) & (F.col("__n") >= 2 * window + 2)
    moving = (F.col("__sb") >= 1e-4) | (F.col("__sa") >= 1e-4)
    flip = (F.col("cosine") < 0.3) & (F.col("__sb") > 0.02) & (F.col("__sa") > 0.02)
    jump = F.abs(F.col("__sa") - F.col("__sb")) > 0.05
    return measured.where(room & moving & (flip | jump)).select(*ep.key, order, "cosine")


def sharpest(changes: DataFrame, ep: Episode, gap: int = 8) -> DataFrame:
    """Of changes of motion, the sharpest ones, at least ``gap`` frames apart; ties go to the earlier frame."""
    order = ep.order[0]
    times = F.transform(F.array_sort(F.collect_list(F.struct("cosine", F.col(order).alias("t")))), lambda s: s["t"].cast("int"))
    return changes.groupBy(*ep.key).agg(folds.suppress_near(times, gap).alias("k")).select(*ep.key, F.explode("k").alias(order))


def fillers(marks: DataFrame, ep: Episode, most: int = 60) -> DataFrame:
    """``(key, t)``: frames that divide gaps of over ``most`` between neighbouring marks evenly."""
    order = ep.order[0]
    gap = F.lead(order).over(ep.ordered) - F.col(order)
    wide = marks.withColumn("__gap", gap).where(F.col("__gap") > most).withColumn("__n", F.floor(F.col("__gap") / most).cast("int"))
    each = wide.select(*ep.key, order, "__gap", "__n", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__j"))
    return each.select(*ep.key, (F.col(order) + F.floor(F.col("__j") * F.col("__gap") / (F.col("__n") + 1))).cast("int").alias(order))


def keyframes(frames: DataFrame, ep: Episode, g: str = "g", position: tuple[str, str, str] | None = None, fps: float = 15.0) -> DataFrame:
    """``(key, t, kind)``: one keyframe for each marked frame, the strongest rule's."""
    order = ep.order[0]
    ends = frames.groupBy(*ep.key).agg(F.min(order).alias("a"), F.max(order).alias("b"))
    ends = ends.select(*ep.key, F.explode(F.array(F.struct(F.col("a").alias(order), F.lit("begin").alias("kind")), F.struct(F.col("b").alias(order), F.lit("end").alias("kind")))).alias("e")).select(*ep.key, f"e.{order}", "e.kind")
    marks = ends.unionByName(with_retries(gripper_events(frames, ep, g), Episode(ep.key, ("t",)), fps).select(*ep.key, F.col("t").cast("int").alias(order), "kind"))
    if position:
        marks = marks.unionByName(sharpest(motion_changes(frames, ep, position, fps), ep).withColumn("kind", F.lit("motion")))
    marks = strongest(marks, ep)
    return strongest(marks.unionByName(fillers(marks.select(*ep.key, order), ep).withColumn("kind", F.lit("filler"))), ep)


def strongest(marks: DataFrame, ep: Episode) -> DataFrame:
    """One row for each key and frame, by precedence of its kind; of begin and end at one frame, end."""
    rank = F.create_map(*[F.lit(x) for kv in PRECEDENCE.items() for x in kv])[F.col("kind")]
    w = Window.partitionBy(*ep.key, ep.order[0]).orderBy(rank, F.desc("kind"))
    return marks.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*ep.key, ep.order[0], "kind")


def merged(marks: DataFrame, ep: Episode, gap: int = 3) -> DataFrame:
    """Keyframes without those too close to a stronger or earlier one."""
    order = ep.order[0]
    prio = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("kind")]
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).cast("int").alias("t"), prio.alias("prio"), F.col("kind"))))
    return marks.groupBy(*ep.key).agg(folds.merge_close(listed, gap).alias("k")).select(*ep.key, F.explode("k").alias("k")).select(*ep.key, F.col("k.t").alias(order), "k.kind")


def motion_start(g: Column, at: Column, look_back: int, ep: Episode, eps: float = 0.05) -> Column:
    """Where the gripper began to leave the value of ``look_back`` frames ago, for a transition at each row's frame."""
    seen = F.collect_list(F.struct(at.alias("t"), g.alias("g"))).over(ep.around(look_back, 0))
    base = F.element_at(seen, 1)
    moved = F.filter(seen, lambda s: F.abs(s["g"] - base["g"]) > eps)
    first = F.array_min(F.transform(moved, lambda s: s["t"]))
    return F.coalesce(F.greatest(base["t"], first - 1), at)
