"""Audits of annotated keyframes, and what can be read out of a model's reply."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that an action at a grasp or release must have, and phrases that contradict the gripper's state.
GRASP = ["close", "grasp", "grip", "clamp", "squeeze", "pinch", "pick"]
RELEASE = ["open", "release", "let go", "drop", "place", "set down", "put down"]
CLOSING = ["close the gripper", "close gripper", "clamp", "squeeze"]
OPENING = ["open the gripper", "open gripper", "release the", "release it", "release onto"]
AXIS_WORDS = r"\b(yaw|pitch|roll|cm|°|degrees?|translate|tilt|rotate)\b"
#: Fixed value: ways to announce what has not happened yet.
FORESHADOW = r"\babout to\b|\b(is|are)\s+going to\b|\bwill\s+(open|close|shut|lift|raise|lower|grasp|grip|release|let go|move|begin|start|descend|rise|pull|push|insert|place|drop|reach|swing|rotate|retract|tilt|pour|tip|slide|press)\b"
MOST_WORDS, MOST_STAGE, MOST_PLAN = 22, 350, 600


def contains_any(text: Column, phrases: list[str]) -> Column:
    """Whether a text has one of the words as a whole word, or one of the phrases anywhere."""
    low = F.lower(text)
    single = [p for p in phrases if " " not in p]
    found = low.rlike(rf"\b({'|'.join(map(re.escape, single))})\b") if single else F.lit(False)
    for p in phrases:
        if " " in p:
            found = found | F.contains(low, F.lit(p))
    return found


def foreshadows(text: Column) -> Column:
    return F.lower(text).rlike(FORESHADOW)


def keyframe_rules(keyframes: DataFrame, key: str) -> DataFrame:
    """``(key, a3, a5, a7, passed)`` of (key, action, type): grasps without a grasping word, long actions, empty actions."""
    action = F.col("action")
    a3 = ((F.col("type") == "grasp") & ~contains_any(action, GRASP)) | ((F.col("type") == "release") & ~contains_any(action, RELEASE))
    a5 = F.size(F.split(F.trim(action), r"\s+")) > MOST_WORDS
    a7 = F.length(F.trim(action)) == 0
    counts = keyframes.groupBy(key).agg(F.count_if(a3).alias("a3"), F.count_if(a5).alias("a5"), F.count_if(a7).alias("a7"))
    return counts.withColumn("passed", (F.col("a3") == 0) & (F.col("a7") == 0))


def state_contradiction(action: Column, kind: Column, state: Column) -> Column:
    """Whether an action says that the gripper does what its state shows it has done; not at grasps, releases and retries."""
    steady = ~kind.isin("grasp", "release", "retry")
    return steady & (((state == "closed") & contains_any(action, OPENING)) | ((state == "open") & contains_any(action, CLOSING)))


def missing_reasoning(kind: Column, think: Column) -> Column:
    return (kind == "retry") & (F.length(F.coalesce(think, F.lit(""))) == 0)


def axis_coverage(action: Column) -> Column:
    """The share of rows whose action names an axis or unit, as an aggregate."""
    return F.avg(F.lower(F.coalesce(action, F.lit(""))).rlike(AXIS_WORDS).cast("int"))


def phase_rules(acts: bool | Column, target: Column, correction: Column, supervised: Column) -> Column:
    """Names of the rules that a phase breaks: array<string>."""
    has = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    thinks = F.contains(F.coalesce(target, F.lit("")), F.lit("<think>"))
    return F.array_compact(
        F.array(
            F.when(~acts & (has(target) | has(correction)), "bracket-not-plain"),
            F.when(acts & (has(correction) == F.coalesce(supervised, F.lit(True))), "correction-against-supervision"),
            F.when(acts & ~F.coalesce(supervised, F.lit(True)) & thinks, "reasoning-on-failure"),
        )
    )


def echoed_numbers(a: Column, b: Column) -> Column:
    """Whether two texts share a number with its unit."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"(\d+\s*(?:cm|°))"), 1)
    return F.size(F.array_intersect(numbers(a), numbers(b))) > 0


def json_object(reply: Column) -> Column:
    """The text from the first brace to the last, inside a code fence if there is one."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(F.length(fenced) > 0, fenced).otherwise(reply)
    return F.regexp_extract(body, r"(?s)(\{.*\})", 1)


def repaired(reply: Column) -> Column:
    """A JSON object out of a reply that may be cut short anywhere: all text up to the last whole member, and the brackets that are open there.

    One fold over the marks that matter (quotes, brackets, commas, escapes and what lies between) with a stack of open brackets.  A whole member is one that a comma or a bracket
    follows, or a text whose quote is closed, unless it is a name; an object or array that has just been opened counts as empty.  What follows the outer bracket is passed over, as is
    all after a bracket that closes another kind.  Null without an opening brace or if the outcome is no JSON.
    """
    at = F.instr(reply, "{")
    body = F.when(at > 0, F.substr(reply, at))
    marks = F.regexp_extract_all(body, F.lit(r"(?s)(\\.|[\"{}\[\],]|[^\\\"{}\[\],]+|\\)"), 1)
    # ``name``: the next text in an object is a member's name.
    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("text"), F.lit("").alias("open"), F.lit(False).alias("name"), F.lit(0).alias("good"), F.lit("").alias("rest"), F.lit(False).alias("over"))

    def step(s, m):
        end = s["at"] + F.char_length(m)
        opens, closes = ~s["text"] & m.isin("{", "["), ~s["text"] & m.isin("}", "]")
        quote, comma = m == '"', ~s["text"] & (m == ",")
        fits = F.substr(s["open"], F.lit(1), F.lit(1)) == m
        inner = F.substr(s["open"], F.lit(2))
        stack = F.when(opens, F.concat(F.when(m == "{", "}").otherwise("]"), s["open"])).when(closes & fits, inner).otherwise(s["open"])
        whole = opens | (closes & fits) | (quote & s["text"] & ~s["name"])
        good = F.when(whole, end).when(comma, s["at"]).otherwise(s["good"])
        in_object = F.substr(stack, F.lit(1), F.lit(1)) == "}"
        name = F.when(opens | comma, in_object).when(quote & s["text"], F.lit(False)).otherwise(s["name"])
        over = (closes & ~fits) | (closes & (stack == ""))
        now = F.struct(end.alias("at"), (s["text"] != quote).alias("text"), stack.alias("open"), name.alias("name"), good.alias("good"), F.when(whole | comma, stack).otherwise(s["rest"]).alias("rest"), over.alias("over"))
        return F.when(s["over"], s).otherwise(now)

    found = F.aggregate(marks, begin, step)
    out = F.concat(F.substr(body, F.lit(1), found["good"]), found["rest"])
    return F.when(F.try_parse_json(out).isNotNull(), out)


def top_axes(values: list[tuple[str, Column]], most: int = 2) -> Column:
    """The axes of the largest turns, as ``yaw +30 deg, roll -5 deg``."""
    listed = F.array_sort(F.array(*[F.struct((-F.abs(v)).alias("k"), F.lit(name).alias("n"), v.alias("v")) for name, v in values]))
    said = F.transform(F.slice(listed, 1, most), lambda s: F.concat(s["n"], F.lit(" "), F.format_string("%+d", F.bround(s["v"], 0).cast("int")), F.lit(" deg")))
    return F.array_join(said, ", ")
