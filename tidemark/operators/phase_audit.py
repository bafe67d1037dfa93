"""Rules over the phases of an annotated episode, as one ordered fold, and what an episode's audit counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.audit import echoed_numbers, foreshadows
from tidemark.sources.readers import _BLANK

PHASE = "phase_type string, s string, s_pred string, a string, a_correct string, imitation_supervised boolean, frame_idx bigint, chunk_end_frame bigint"
#: Phases that only describe, the fields that must not be empty, and the longest chunk in frames.
BRACKETS = ("begin", "end")
ALWAYS, ACTING = ("phase_type", "s"), ("s_pred", "a")
LONGEST_CHUNK = 60


def _has(text: Column) -> Column:
    return F.length(F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANK))) > 0


def _issues(p: Column, first_act: Column) -> Column:
    """Names of the rules that a phase breaks, in a fixed order; ``first_act``: whether it is the episode's first acting phase."""
    acts = ~F.btrim(F.coalesce(p["phase_type"], F.lit("")), F.lit(_BLANK)).isin(*BRACKETS)
    failed = p["imitation_supervised"].eqNullSafe(F.lit(False))
    thinks = lambda c: F.contains(F.coalesce(c, F.lit("")), F.lit("<think>"))
    empty = [F.when(~_has(p[f]) & (acts if f in ACTING else F.lit(True)), f"{f}=empty") for f in (*ALWAYS, *ACTING)]
    return F.array_compact(
        F.array(
            *empty,
            F.when(foreshadows(F.coalesce(p["s"], F.lit(""))), "foreshadow-in-s"),
            F.when(~acts & (_has(p["a"]) | _has(p["s_pred"]) | _has(p["a_correct"])), "bracket-acts"),
            F.when(acts & (_has(p["a_correct"]) != failed), "correction-against-supervision"),
            F.when(acts & failed & thinks(p["a"]), "think-on-failure"),
            F.when(first_act & ~F.when(failed, thinks(p["a_correct"])).otherwise(thinks(p["a"])), "first-move-without-plan"),
            F.when(acts & echoed_numbers(F.coalesce(p["s_pred"], F.lit("")), F.coalesce(p["a"], F.lit(""))), "prediction-echoes-action"),
            F.when(acts & foreshadows(F.coalesce(p["s_pred"], F.lit(""))), "foreshadow-in-s_pred"),
        )
    )


def audit(phases: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each episode of ``(key, order, PHASE fields)``: its issues as ``number:name``, and its counts.

    ``first_diverge`` is the first acting phase without supervision (-1 if none) and ``recoveries`` counts steps from one without to one with it, both over acting phases
    only.  A chunk must end 1 to 60 frames after its phase's frame (``bounds_ok``; brackets aside); it overlaps the next phase or ends where that begins (``tiled``).
    ``passed``: no issue.  An episode is one group, so its phases are in one task.
    """
    fields = [f.split(" ")[0] for f in PHASE.split(", ")]
    ordered = F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("p"))))
    rows = phases.groupBy(key).agg(F.transform(ordered, lambda x: x["p"]).alias("ps"))
    begin = F.struct(
        F.lit(0).alias("n"), F.lit(False).alias("acted"), F.lit(None).cast("boolean").alias("before"), F.lit(-1).alias("first_diverge"), F.lit(0).cast("bigint").alias("recoveries"),
        F.array().cast("array<string>").alias("issues"), F.lit(None).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("overlaps"), F.lit(0).cast("bigint").alias("tiled"), F.lit(True).alias("bounds_ok"),
    )

    def step(s, p):
        acts = ~F.btrim(F.coalesce(p["phase_type"], F.lit("")), F.lit(_BLANK)).isin(*BRACKETS)
        told = F.transform(_issues(p, acts & ~s["acted"]), lambda name: F.concat(s["n"].cast("string"), F.lit(":"), name))
        supervised = F.when(acts, p["imitation_supervised"])
        frame, end = F.coalesce(p["frame_idx"], F.lit(0)), p["chunk_end_frame"]
        inside = end.isNull() | ((end > frame) & (end <= frame + LONGEST_CHUNK))
        return F.struct(
            (s["n"] + 1).alias("n"), (s["acted"] | acts).alias("acted"), F.coalesce(supervised, s["before"]).alias("before"),
            F.when((s["first_diverge"] < 0) & supervised.eqNullSafe(F.lit(False)), s["n"]).otherwise(s["first_diverge"]).alias("first_diverge"),
            (s["recoveries"] + (supervised.eqNullSafe(F.lit(True)) & s["before"].eqNullSafe(F.lit(False))).cast("bigint")).alias("recoveries"),
            F.concat(s["issues"], told).alias("issues"), F.when(end > 0, end).alias("end"),
            (s["overlaps"] + F.coalesce(s["end"] > frame, F.lit(False)).cast("bigint")).alias("overlaps"), (s["tiled"] + F.coalesce(s["end"] == frame, F.lit(False)).cast("bigint")).alias("tiled"),
            (s["bounds_ok"] & (inside | ~acts)).alias("bounds_ok"),
        )

    folded = rows.select(key, F.aggregate("ps", begin, step).alias("s"))
    return folded.select(key, F.col("s.n").cast("bigint").alias("n"), "s.issues", (F.size("s.issues") == 0).alias("passed"), F.col("s.first_diverge").alias("first_diverge"), "s.recoveries", "s.overlaps", "s.tiled", "s.bounds_ok")
