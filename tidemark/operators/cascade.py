"""Cascade texts of task episodes: a task, a plan, the reason for the present stage, and the action in words, by task family."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.sources.readers import _BLANK

#: Reasons by the kind of phase, with the cube's colour, the arm and the place filled in.
REASONS = {
    "approach": [
        "The {color} cube is the pick target named in the task, so the {arm} arm must position above it before grasping.",
        "Because the {color} cube is the only valid pick, the {arm} arm hovers over it to set up the grasp.",
        "The task specifies the {color} cube as the pick target, and a clean approach from above is needed before closing the gripper.",
        "Approaching the {color} cube from above gives the {arm} gripper room to descend without bumping the cube sideways.",
    ],
    "grasp": [
        "The gripper must close on the {color} cube without slipping the cube, so it lowers and grips firmly.",
        "Now that the {arm} gripper is positioned over the {color} cube, lowering and closing the fingers secures the grasp.",
        "Grasping the {color} cube requires controlled descent followed by finger closure to avoid kicking the cube.",
        "The {color} cube is centered under the {arm} gripper, so closing the fingers now picks it up cleanly.",
    ],
    "transport": [
        "The {color} cube is now in hand and needs to reach {dest}, so the {arm} arm carries it through the air.",
        "Because the {color} cube is grasped, the {arm} arm transports it horizontally toward {dest}.",
        "The cube has to clear the table before placing, so the {arm} arm lifts and travels above the workspace toward {dest}.",
        "Transporting the {color} cube to {dest} requires a smooth airborne trajectory to avoid disturbing other blocks.",
    ],
    "lift_down": [
        "The {arm} arm has arrived above {dest}, so lowering and releasing places the {color} cube in position.",
        "Now that the {color} cube is over {dest}, opening the {arm} gripper drops it precisely.",
        "Placing the {color} cube at {dest} requires lowering carefully and then releasing it to set it down.",
        "The transport phase ended above {dest}, so lowering and releasing finishes the placement of the {color} cube.",
    ],
}
#: Families by dataset; a longer name that begins with one of these belongs to the first that fits.
FAMILIES = {
    "pick_place_primitive": "pick_place", "arrange_blocks_line": "arrange", "arrange_blocks_l_shape": "arrange", "arrange_blocks_u_shape": "arrange", "arrange_blocks_i_shape": "arrange",
    "stack_blocks_n_stack_n_v1_open_K3": "stack", "stack_blocks_n_stack_n_v1_open": "stack", "stack_blocks_n_stack_n_v1": "stack",
}


def family(dataset: Column) -> Column:
    """The task family; null for an unknown dataset."""
    out = F.lit(None).cast("string")
    for name, kind in reversed(FAMILIES.items()):
        out = F.when(F.startswith(dataset, F.lit(name)), kind).otherwise(out)
    return out


def _strip(text: Column, marks: str = _BLANK) -> Column:
    return F.btrim(text, F.lit(marks))


def pick_plan(descriptor: Column, place: Column) -> Column:
    return F.concat(F.lit("Pick up "), descriptor, F.lit(" and place it "), place, F.lit("."))


def plan_of_phases(phases: Column, task: Column) -> Column:
    """The phases' subgoals in order, each once and ended by a stop; the task where no phase names any."""
    named = F.array_distinct(F.filter(F.transform(phases, lambda p: _strip(F.coalesce(p["subgoal_prompt"], F.lit("")))), lambda s: s != ""))
    ended = F.transform(named, lambda s: F.when(F.endswith(s, F.lit(".")), s).otherwise(F.concat(s, F.lit("."))))
    return F.when(F.size(named) > 0, F.array_join(ended, " ")).otherwise(F.coalesce(task, F.lit("")))


def _reasons(kind: Column, color: Column, arm: Column, place: Column) -> Column:
    """The four reasons for a kind of phase; an unknown kind counts as an approach."""
    lists = {k: F.array(*map(F.lit, texts)) for k, texts in REASONS.items()}
    chosen = lists["approach"]
    for k in ("grasp", "transport", "lift_down"):
        chosen = F.when(kind == k, lists[k]).otherwise(chosen)
    fill = lambda t: F.replace(F.replace(F.replace(t, F.lit("{color}"), color), F.lit("{arm}"), arm), F.lit("{dest}"), place)
    return F.transform(chosen, fill)


def _given(texts: Column, otherwise: Column) -> Column:
    return F.when(F.size(F.coalesce(texts, F.array().cast("array<string>"))) > 0, texts).otherwise(otherwise)


def told_stage(text: Column, subgoal: Column) -> Column:
    """The part of a told phase after its subgoal mark and before its step mark; the subgoal where there is no mark."""
    text = F.coalesce(text, F.lit(""))
    before = F.split_part(text, F.lit("[Step]"), F.lit(1))
    at = F.instr(before, "[Subgoal]")
    part = F.when(at > 0, F.substr(before, at + 9)).otherwise(before)
    return F.when(F.contains(text, F.lit("[Subgoal]")), _strip(_strip(part, ". "))).otherwise(subgoal)


def texts(meta: dict[str, Column], phase: Column, number: Column, key: Column, salt: str = "cascade") -> Column:
    """struct(family, task_prompt, plan, stage, action) of one phase of an episode.

    ``meta``: columns ``dataset``, ``task_prompt``, ``phases``, ``told`` (texts by phase), ``descriptor``, ``color`` and ``place``; ``phase`` and the entries of
    ``phases`` have kind, arm_tag, subgoal_prompt, subgoal_reasoning and phase_prompts; ``number`` counts phases from 0.  Of several texts one is chosen by
    the digest of ``salt`` and ``key``.  A dataset of no known family has null texts.
    """
    group = family(meta["dataset"])
    task, subgoal = F.coalesce(meta["task_prompt"], F.lit("")), F.coalesce(phase["subgoal_prompt"], F.lit(""))
    arm = F.coalesce(phase["arm_tag"], F.lit("left"))
    picked = pick_plan(meta["descriptor"], meta["place"])
    stages = F.when(group == "pick_place", _given(phase["subgoal_reasoning"], _reasons(phase["kind"], meta["color"], arm, meta["place"])))
    stages = stages.when(group == "arrange", _given(phase["subgoal_reasoning"], F.array(told_stage(F.get(meta["told"], number), subgoal))))
    stages = stages.when(group == "stack", _given(phase["subgoal_reasoning"], F.array(subgoal)))
    hand = F.concat(F.lit("Move the "), arm, F.lit(" gripper to manipulate the cube."))
    actions = _given(phase["phase_prompts"], F.array(F.when(group == "pick_place", hand).otherwise(task)))
    known = group.isNotNull()
    return F.struct(
        group.alias("family"),
        F.when(group == "pick_place", picked).when(known, task).alias("task_prompt"),
        F.when(group == "pick_place", picked).when(known, plan_of_phases(meta["phases"], meta["task_prompt"])).alias("plan"),
        hashing.choose(f"{salt}-stage", key, stages).alias("stage"),
        F.when(known, hashing.choose(f"{salt}-action", key, actions)).alias("action"),
    )
