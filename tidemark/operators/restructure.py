"""Raw trajectories and samples as the common frame record: observations, choices by episode, constants, model inputs, local copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.operators import joins, windows

#: The camera slots of a model.
SLOTS = ("base_0_rgb", "left_wrist_0_rgb", "right_wrist_0_rgb")
#: States of a record whose hint is on the server.
HINTED = ("hinted", "annot_claimed", "annotated")


def observation(images: dict[str, Column | None], state: Column) -> Column:
    """A struct of every slot's image, "" where a slot has no camera or no picture, and the state as floats."""
    empty = F.lit("")
    slots = [(empty if images.get(s) is None else F.coalesce(images[s], empty)).alias(s) for s in SLOTS]
    return F.struct(*slots, F.coalesce(state, F.array()).cast("array<float>").alias("state"))


def vqa_observation(image: Column, state_width: int) -> Column:
    """One image, no wrist cameras and a state of zeros."""
    return observation({SLOTS[0]: image}, F.array_repeat(F.lit(0.0), state_width))


def with_constants(rows: DataFrame, dataset: str, state_type: str, bimanual: bool = False, navigation: bool = False, wrist: bool = True, rotated_wrist: bool = False) -> DataFrame:
    """The fields that are alike in all of a dataset's frames."""
    values = {"dataset_name": dataset, "state_type": state_type, "is_bimanual": bimanual, "is_navigation": navigation, "has_wrist_image": wrist, "needs_wrist_rotation": rotated_wrist}
    return rows.withColumns({name: F.lit(v) for name, v in values.items()})


def chosen_by_episode(rows: DataFrame, key: str, seed: int, instructions: list[str], cameras: tuple[str, str]) -> DataFrame:
    """``prompt`` and ``exterior``: one of the instructions and one of two cameras for a whole episode, by digests of seed and key."""
    camera = F.when(hashing.uniform(f"{seed}camera", F.col(key)) > 0.5, F.col(cameras[0])).otherwise(F.col(cameras[1]))
    prompt = hashing.choose(f"{seed}prompt", F.col(key), F.array(*instructions))
    return rows.withColumns({"prompt": prompt, "exterior": camera})


def with_step_filter(rows: DataFrame, kept: DataFrame, folder: str, file: str, at: str) -> DataFrame:
    """``step_id`` and ``passes_filter``: whether a step is in the table of kept ones (step_id); unknown steps don't pass."""
    named = rows.withColumn("step_id", F.concat_ws("--", folder, file, F.col(at).cast("string")))
    return joins.lookup(named, kept.select("step_id").distinct().withColumn("passes_filter", F.lit(True)), "step_id", "passes_filter", False)


def with_trajectory_id(rows: DataFrame, dataset: str, action: str, ep: windows.Episode, ends: int = 64) -> DataFrame:
    """``trajectory_id``: the dataset's name and a digest of the episode's first and last actions."""
    digests = windows.trajectory_digest(rows, action, ep, ends).withColumn("trajectory_id", F.concat(F.lit(f"{dataset}-"), F.md5(F.concat(F.lit(f"{dataset}::"), "digest")))).drop("digest")
    return rows.join(digests, list(ep.key), "left")


def instructed(rows: DataFrame, prompt: str) -> DataFrame:
    """Frames that have an instruction; an episode without any goes whole."""
    return rows.where(F.coalesce(F.col(prompt).rlike(r"\S"), F.lit(False)))


def within_bounds(rows: DataFrame, action: str, ep: windows.Episode, low: float = -5.0, high: float = 5.0) -> DataFrame:
    """Episodes in which no number of any action lies outside the bounds; null numbers lie in them."""
    outside = F.coalesce(F.exists(action, lambda x: (x < low) | (x > high)), F.lit(False))
    return rows.withColumn("__out", F.max(outside).over(ep.whole)).where("not __out").drop("__out")


def prepared_inputs(rows: DataFrame, action_width: int, all_masks: bool = False) -> DataFrame:
    """``inputs`` of frames with (observation, prompt, dataset_name, actions): state, images, masks, prompt and padded actions.

    A slot's mask is whether it has a picture, or true where the model takes all slots.  Prompts of datasets named like
    ``r1_lite`` are what follows their last @.
    """
    obs = F.col("observation")
    images = F.struct(*[obs[s].alias(s) for s in SLOTS])
    masks = F.struct(*[(F.lit(True) if all_masks else F.length(obs[s]) > 0).alias(s) for s in SLOTS])
    prompt = F.coalesce("prompt", F.lit(""))
    prompt = F.when(F.contains(F.coalesce("dataset_name", F.lit("")), F.lit("r1_lite")), F.element_at(F.split(prompt, "@"), -1)).otherwise(prompt)
    short = F.greatest(F.lit(action_width) - F.size("actions"), F.lit(0))
    actions = F.concat("actions", F.array_repeat(F.lit(0.0), short))
    return rows.withColumn("inputs", F.struct(obs["state"].alias("state"), images.alias("image"), masks.alias("image_mask"), prompt.alias("prompt"), actions.alias("actions")))


def prunable(copies: DataFrame, records: DataFrame, key: str, reviewed: bool = False) -> DataFrame:
    """``reason`` why a local copy (key, annotated, in_review) may go, by the server's (key, status, hint); null: it stays."""
    met = copies.join(records.select(key, "status", "hint"), key, "left")
    on_server = F.col("status").isin(*HINTED) | (F.length("hint") > 0)
    reason = (
        F.when(F.col("in_review"), F.lit("reviewed") if reviewed else F.lit(None))
        .when(F.col("annotated"), F.when(F.col("status") == "annotated", "annotation on server"))
        .when(F.coalesce(on_server, F.lit(False)), "hint on server")
    )
    return met.select(*copies.columns, reason.alias("reason"))
