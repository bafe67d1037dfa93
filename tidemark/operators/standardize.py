"""Standardisation of robot datasets, as data.

A ``Spec`` says how one source schema becomes ``state`` (pose and gripper, 1 = open), ``action``, ``language_action`` (the step to
the next pose, and the gripper) and ``instruction``.  The source's fields are array columns of one row per frame; all specs compile to column
expressions over one episode window, so a dataset costs one exchange whichever spec it has.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import hashing, rot
from tidemark.operators.windows import Episode, absolute_gripper, filled_gripper, without_first

#: Instructions for episodes that come without one.
FALLBACKS = (
    "Do something useful.",
    "Complete the task.",
    "Perform the task.",
    "Carry out the objective.",
    "Execute the current task.",
    "Accomplish the goal.",
    "Proceed with the task.",
    "Handle the task at hand.",
    "Continue the operation.",
    "Fulfill the task.",
    "Take meaningful steps.",
    "Demonstrate useful behavior.",
    "Act in a useful manner.",
    "Engage in productive actions.",
    "Make useful moves.",
    "Undertake useful actions.",
    "Behave purposefully.",
    "Start the activity.",
)


@dataclass(frozen=True)
class Spec:
    """``pose``: parts of the six pose numbers; ``grip`` and ``command``: a field, an index (from the end if negative) and steps.

    Parts: (kind, source field, offset, count), of kind take (a count of 0: all that follow, below 0: but so many), quaternion, axis_angle, zxy, matrix (4x4 by columns) or zeros.
    Steps: clip, invert, ("scale", k), ("shift", k), ("fill", threshold), absolute.
    ``language_parts``: parts that stand for the step, before the command.
    ``action``: pose (absolute pose and command), raw (the source's), or parts and command as given by ``action_parts``.
    """

    pose: tuple = (("take", "state", 0, 6),)
    grip: tuple = ("state", -1)
    command: tuple = ("action", -1)
    axes: str | None = None
    action: str = "pose"
    action_parts: tuple = ()
    step: bool = True
    language_parts: tuple = ()
    drop_first: bool = False
    relabel: bool = False
    fallback: bool = False
    instruction: str = "language_instruction"


_TAKE6 = (("take", "state", 0, 6),)
_QUAT = (("take", "state", 0, 3), ("quaternion", "state", 3, 4))
_MOVE_TURN = (("take", "world_vector", 0, 3), ("take", "rotation_delta", 0, 3))
_NATURAL = "natural_language_instruction"
_RAW = Spec(action="raw", step=False, pose=_TAKE6)
_OPEN = ("action", -1, "clip", "invert")
_MATRIX = Spec(pose=(("matrix", "state", -16, 16),), grip=("state", 7, ("scale", 1 / 0.079), "clip"), command=_OPEN)

#: The specs by name, as far as the source schemas differ.
SPECS: dict[str, Spec] = {
    "bridge_v2_oxe": Spec(grip=("state", -1, "clip"), command=("action", -1, ("fill", 0.95)), drop_first=True),
    "bridge_orig": Spec(command=("action", -1, ("fill", 0.95)), drop_first=True, relabel=True, action="parts", action_parts=(("take", "action", 0, 6),), step=False),
    "ppgm": Spec(pose=(("take", "cartesian_position", 0, 6),), grip=("gripper_position", -1), command=("action", -1, ("fill", 0.95)), action="parts", action_parts=(("take", "action", 0, 6),), step=False),
    "rt1": Spec(pose=(("take", "base_pose_tool_reached", 0, 3), ("quaternion", "base_pose_tool_reached", 3, 4)), grip=("gripper_closed", 0, "invert", "clip"), command=("gripper_closedness_action", 0, "absolute"), instruction=_NATURAL),
    "kuka": Spec(pose=(("take", "base_pose_tool_reached", 0, 3), ("quaternion", "base_pose_tool_reached", 3, 4)), grip=("gripper_closed", 0, "invert", "clip"), command=("gripper_closedness_action", 0, "absolute"), instruction=_NATURAL),
    "taco_play": Spec(pose=(("take", "robot_obs", 0, 6),), grip=("robot_obs", 6, ("scale", 12.3903), "clip"), command=("rel_actions_world", -1, ("shift", 1.0), ("scale", 0.5), "clip"), instruction=_NATURAL),
    "jaco_play": Spec(pose=(("take", "end_effector_cartesian_pos", 0, 6),), axes="jaco", grip=("end_effector_cartesian_pos", -1, ("scale", 4.33), "clip"), command=("gripper_closedness_action", 0, "absolute"), instruction=_NATURAL),
    "berkeley_cable_routing": replace(_RAW, action="parts", action_parts=_MOVE_TURN, command=("zeros", 0), instruction=_NATURAL),
    "roboturk": replace(_RAW, action="parts", action_parts=_MOVE_TURN, command=("gripper_closedness_action", 0, "clip", "invert"), instruction=_NATURAL),
    "nyu_door_opening": replace(_RAW, action="parts", action_parts=_MOVE_TURN, command=("gripper_closedness_action", 0, "absolute"), instruction=_NATURAL),
    "viola": Spec(pose=(("matrix", "ee_states", -16, 16),), grip=("gripper_states", 0, ("scale", 1 / 0.079), "clip"), command=("gripper_closedness_action", 0, "clip", "invert"), instruction=_NATURAL),
    "berkeley_autolab_ur5": Spec(pose=(("take", "robot_state", 6, 3), ("quaternion", "robot_state", 9, 4)), grip=("robot_state", 13, "invert", "clip"), command=("gripper_closedness_action", 0, "absolute"), instruction=_NATURAL),
    "toto": replace(_RAW, action="parts", action_parts=_MOVE_TURN, command=("open_gripper", 0), instruction=_NATURAL),
    "language_table": replace(_RAW, action="parts", action_parts=(("take", "action", 0, 2), ("zeros", "", 0, 4)), command=("ones", 0)),
    "pusht": replace(_RAW, action="parts", action_parts=_MOVE_TURN, command=("gripper_closedness_action", 0), instruction=_NATURAL),
    "stanford_kuka_multimodal": replace(_RAW, action="parts", action_parts=(("take", "action", 0, 3), ("zeros", "", 0, 3))),
    "nyu_rot": replace(_RAW, action="parts", action_parts=(("take", "action", 0, 6),), command=("action", 6)),
    "stanford_hydra": replace(_RAW, pose=(("take", "state", 0, 3), ("take", "state", 7, 3)), grip=("state", -3, "invert"), action="parts", action_parts=(("take", "action", 0, 6),), command=("action", -1, "invert")),
    "austin_buds": replace(_MATRIX, fallback=True),
    "nyu_franka_play": replace(_RAW, pose=(("take", "state", -6, 6),), action="parts", action_parts=(("take", "action", -8, 6),), command=("action", -2, "clip")),
    "droid": Spec(pose=(("take", "cartesian_position", 0, 6),), grip=("gripper_position", 0, "invert", ("fill", 0.5)), command=("action_gripper_position", 0, "invert", ("fill", 0.5), "clip")),
    "maniskill": replace(_RAW, grip=("state", 7)),
    "furniture_bench": Spec(pose=_QUAT, grip=("state", -1, ("scale", 1 / 0.079), "clip"), command=_OPEN),
    "cmu_franka_exploration": replace(_RAW, action="parts", action_parts=(("take", "action", 0, -1),), command=()),
    "ucsd_kitchen": replace(_RAW, action="parts", action_parts=(("take", "action", 0, -1),), command=()),
    "ucsd_pick_place": replace(_RAW, action="parts", action_parts=(("take", "action", 0, 3), ("zeros", "", 0, 3))),
    "austin_sailor": replace(_MATRIX, pose=(("matrix", "state_ee", -16, 16),), grip=("state", -1, ("scale", 1 / 0.079), "clip"), fallback=True),
    "austin_sirius": replace(_MATRIX, pose=(("matrix", "state_ee", -16, 16),), grip=("state", -1, ("scale", 1 / 0.079), "clip"), fallback=True),
    "bc_z": Spec(pose=(("take", "present_xyz", 0, 3), ("axis_angle", "present_axis_angle", 0, 3)), axes="bcz", grip=("present_sensed_close", 0, "invert", ("scale", 1.25), "clip"), command=("future_target_close", 0, "invert"), instruction=_NATURAL),
    "tokyo_pr2_opening_fridge": replace(_RAW, action="parts", action_parts=(("take", "action", 0, -1),), command=()),
    "tokyo_pr2_tabletop_manipulation": replace(_RAW, action="parts", action_parts=(("take", "action", 0, -1),), command=()),
    "utokyo_xarm_pick_place": _RAW,
    "utokyo_xarm_bimanual": replace(_RAW, action="parts", action_parts=(("take", "action", -7, 6),)),
    "robo_net": replace(_RAW, pose=(("take", "state", 0, 4), ("zeros", "", 0, 2)), action="parts", action_parts=(("take", "action", 0, 4), ("zeros", "", 0, 2))),
    "berkeley_mvp": _RAW,
    "berkeley_rpt": _RAW,
    "kaist_nonprehensible": replace(_RAW, pose=(("take", "state", -7, 6),), action="parts", action_parts=(("take", "action", 0, 6),), command=("zeros", 0)),
    "stanford_mask_vit": replace(_RAW, pose=(("take", "end_effector_pose", 0, 4), ("zeros", "", 0, 2)), grip=("end_effector_pose", -1), action="parts", action_parts=(("take", "action", 0, 4), ("zeros", "", 0, 2))),
    "tokyo_lsmo": _RAW,
    "dlr_sara_pour": _RAW,
    "dlr_sara_grid_clamp": replace(_RAW, grip=()),
    "dlr_edan_shared_control": Spec(pose=(("take", "state", 0, 3), ("zxy", "state", 3, 3)), grip=("state", -1, "invert"), command=("action", -1, "invert", "clip")),
    "asu_table_top": replace(_RAW, pose=(("take", "ground_truth_ee", 0, 6),)),
    "robocook": _RAW,
    "imperial_wristcam": replace(_RAW, action="parts", action_parts=(("take", "action", 0, -1),), command=()),
    "iamlab_pick_insert": replace(_RAW, grip=("state", 7), action="parts", action_parts=(("take", "action", 0, 3), ("quaternion", "action", 3, 4)), command=("action", 7)),
    "uiuc_d3field": replace(_RAW, action="parts", action_parts=(("take", "action", 0, 3), ("zeros", "", 0, 3)), command=("zeros", 0)),
    "utaustin_mutex": _MATRIX,
    "molmoact": Spec(pose=(("take", "state", 0, -1),), grip=("state", -1, "invert"), command=("action", -1, "invert"), language_parts=(("take", "action", 0, -1),)),
    "berkeley_fanuc": Spec(pose=(("take", "end_effector_state", 0, 3), ("quaternion", "end_effector_state", 3, 4)), grip=("state", 6, "invert", "clip"), command=("state", 6, "invert"), language_parts=(("take", "action", 0, 0),)),
    "cmu_playing_with_food": replace(_RAW, action="parts", action_parts=(("take", "action", 0, 3), ("quaternion", "action", 3, 4))),
    "playfusion": replace(_RAW, action="parts", action_parts=(("take", "action", 0, 3), ("take", "action", -4, 3))),
    "cmu_stretch": Spec(pose=(("take", "state", 0, 3), ("zeros", "", 0, 3)), grip=("state", -1, ("shift", 3.14), ("scale", 1 / 6.28)), command=("state", -1, ("shift", 3.14), ("scale", 1 / 6.28))),
    "gnm": Spec(pose=(("take", "position", 0, 2), ("zeros", "", 0, 3), ("take", "yaw", 0, 1)), grip=("zeros", 0), command=("zeros", 0)),
    "fmb": Spec(pose=(("take", "eef_pose", 0, 3), ("quaternion", "eef_pose", 3, 4)), grip=("state_gripper_pose", 0, "invert", "clip"), command=("action", -1, "invert")),
    "dobbe": Spec(axes="dobbe", grip=("state", -1, "clip")),
    "roboset": replace(_RAW, pose=(("take", "state", 0, -1),), grip=("state", -1, "clip", "invert"), action="parts", action_parts=(("take", "action", 0, 7),), command=_OPEN),
    "rh20t": replace(_RAW, pose=(("take", "tcp_base", 0, 6),), grip=("gripper_width", 0), action="parts", action_parts=(("take", "action_tcp_base", 0, 6),), command=("action_gripper", 0)),
    "tdroid": Spec(pose=(("take", "cartesian_position", 0, 6),), grip=("gripper_position", -1), command=("action", -1, ("fill", 0.95)), action="parts", action_parts=(("take", "action", 0, 6),), step=False),
    "libero": Spec(pose=(("take", "state", 0, 3), ("axis_angle", "state", 3, 3)), grip=("state", -2, ("scale", 25.0), "clip"), command=_OPEN, action="parts", action_parts=(("take", "action", 0, 6),)),
    "human": _RAW,
    "franka": Spec(grip=("state", 6, "clip", "invert"), command=_OPEN),
    "yam_jointpos": Spec(grip=("state", -1), command=("action", -1, "clip"), action="raw"),
    "yam": Spec(grip=("state", -1), command=("action", -1, "clip")),
    "planning": replace(_RAW, pose=(("take", "state", 0, 6), ("wxyz_r6", "state", 6, 4), ("take", "state", 10, 0)), grip=(), action="parts", action_parts=(("take", "action", 0, 6), ("axis_angle_r6", "action", 6, 3), ("take", "action", 9, 0)), command=()),
}
#: Specs of two arms, each with its six pose numbers and a gripper; the command is divided by 100 or inverted.
BIMANUAL = {"sample_r1_lite": (("scale", 0.01),), "agibot_large": ("invert",)}

#: Registered dataset names by spec; names that equal their spec are left out.
DATASETS = {
    "bridge_orig": [
        "bridge_orig",
        "bridge_dataset",
    ],
    "ppgm": [
        "ppgm",
        "ppgm_static",
        "ppgm_wrist",
    ],
    "rt1": [
        "fractal20220817_data",
    ],
    "nyu_door_opening": [
        "nyu_door_opening_surprising_effectiveness",
    ],
    "pusht": [
        "columbia_cairlab_pusht_real",
    ],
    "stanford_kuka_multimodal": [
        "stanford_kuka_multimodal_dataset_converted_externally_to_rlds",
    ],
    "nyu_rot": [
        "nyu_rot_dataset_converted_externally_to_rlds",
    ],
    "stanford_hydra": [
        "stanford_hydra_dataset_converted_externally_to_rlds",
    ],
    "austin_buds": [
        "austin_buds_dataset_converted_externally_to_rlds",
    ],
    "nyu_franka_play": [
        "nyu_franka_play_dataset_converted_externally_to_rlds",
    ],
    "droid": [
        "droid",
        "droid_100",
    ],
    "maniskill": [
        "maniskill_dataset_converted_externally_to_rlds",
    ],
    "furniture_bench": [
        "furniture_bench_dataset_converted_externally_to_rlds",
    ],
    "cmu_franka_exploration": [
        "cmu_franka_exploration_dataset_converted_externally_to_rlds",
    ],
    "ucsd_kitchen": [
        "ucsd_kitchen_dataset_converted_externally_to_rlds",
    ],
    "ucsd_pick_place": [
        "ucsd_pick_and_place_dataset_converted_externally_to_rlds",
    ],
    "austin_sailor": [
        "austin_sailor_dataset_converted_externally_to_rlds",
    ],
    "austin_sirius": [
        "austin_sirius_dataset_converted_externally_to_rlds",
    ],
    "tokyo_pr2_opening_fridge": [
        "utokyo_pr2_opening_fridge_converted_externally_to_rlds",
    ],
    "tokyo_pr2_tabletop_manipulation": [
        "utokyo_pr2_tabletop_manipulation_converted_externally_to_rlds",
    ],
    "utokyo_xarm_pick_place": [
        "utokyo_xarm_pick_and_place_converted_externally_to_rlds",
    ],
    "utokyo_xarm_bimanual": [
        "utokyo_xarm_bimanual_converted_externally_to_rlds",
    ],
    "berkeley_mvp": [
        "berkeley_mvp_converted_externally_to_rlds",
    ],
    "berkeley_rpt": [
        "berkeley_rpt_converted_externally_to_rlds",
    ],
    "kaist_nonprehensible": [
        "kaist_nonprehensile_converted_externally_to_rlds",
    ],
    "stanford_mask_vit": [
        "stanford_mask_vit_converted_externally_to_rlds",
    ],
    "tokyo_lsmo": [
        "tokyo_u_lsmo_converted_externally_to_rlds",
    ],
    "dlr_sara_pour": [
        "dlr_sara_pour_converted_externally_to_rlds",
    ],
    "dlr_sara_grid_clamp": [
        "dlr_sara_grid_clamp_converted_externally_to_rlds",
    ],
    "dlr_edan_shared_control": [
        "dlr_edan_shared_control_converted_externally_to_rlds",
    ],
    "asu_table_top": [
        "asu_table_top_converted_externally_to_rlds",
    ],
    "robocook": [
        "stanford_robocook_converted_externally_to_rlds",
    ],
    "imperial_wristcam": [
        "imperialcollege_sawyer_wrist_cam",
    ],
    "iamlab_pick_insert": [
        "iamlab_cmu_pickup_insert_converted_externally_to_rlds",
    ],
    "molmoact": [
        "molmoact_dataset",
    ],
    "berkeley_fanuc": [
        "berkeley_fanuc_manipulation",
    ],
    "playfusion": [
        "cmu_play_fusion",
    ],
    "gnm": [
        "berkeley_gnm_recon",
        "berkeley_gnm_cory_hall",
        "berkeley_gnm_sac_son",
    ],
    "tdroid": [
        "tdroid_carrot_in_bowl",
        "tdroid_pour_corn_in_pot",
        "tdroid_flip_pot_upright",
        "tdroid_move_object_onto_plate",
        "tdroid_knock_object_over",
        "tdroid_cover_object_with_towel",
    ],
    "libero": [
        "libero_spatial_no_noops",
        "libero_object_no_noops",
        "libero_goal_no_noops",
        "libero_10_no_noops",
        "libero_10_no_noops_mini",
        "libero_goal_no_noops_mini",
        "libero_10_no_noops_half",
        "libero_goal_no_noops_half",
        "libero_10_no_noops_quad",
        "libero_goal_no_noops_quad",
        "libero_combined",
    ],
    "human": [
        "ego4d_split_1",
        "ego4d_split_2",
        "ego4d_split_3",
        "ego4d_split_4",
    ],
    "planning": [
        "planning_dataset",
    ],
    "yam": [
        "yam_dataset",
        "yam_demo_dataset",
        "yam_rollout_dataset",
    ],
    "franka": [
        "franka_dataset",
        "franka_demo_dataset",
        "franka_towel_demo_dataset",
        "franka_rollout_dataset",
    ],
    "yam_jointpos": [
        "yam_jointpos_dataset",
        "yam_jointpos_dataset_small",
    ],
    "agibot_large": [
        "agibot_large_dataset",
    ],
}


def spec_of(dataset: str) -> str:
    """The spec's name for a registered dataset; KeyError for an unknown one."""
    for spec, names in DATASETS.items():
        if dataset in names:
            return spec
    if dataset in SPECS or dataset in BIMANUAL:
        return dataset
    raise KeyError(dataset)


def _at(source: Column, index: int) -> Column:
    return F.get(source, F.lit(index) if index >= 0 else F.size(source) + index).cast("double")


def _part(part: tuple) -> Column:
    kind, source, start, n = part
    if kind == "zeros":
        return F.array(*[F.lit(0.0)] * n)
    if kind == "take":
        column = F.col(source)
        begin = F.lit(start + 1) if start >= 0 else F.size(column) + start + 1
        length = F.lit(n) if n > 0 else F.greatest(F.size(column) + n - start, F.lit(0))
        return F.transform(F.slice(column, begin, length), lambda x: x.cast("double"))
    cells = [_at(F.col(source), start + k if start >= 0 else start + k) for k in range(n)]
    if kind == "matrix":
        return rot.as_array(rot.pose_matrix_to_euler(F.array(*cells)))
    turn = {"quaternion": rot.quaternion_to_euler, "axis_angle": rot.axis_angle_to_euler, "zxy": rot.zxy_to_euler, "wxyz_r6": rot.wxyz_to_r6, "axis_angle_r6": rot.axis_angle_to_r6}[kind]
    return rot.as_array(turn(cells))


def _gripper(recipe: tuple, ep: Episode) -> Column | None:
    if not recipe:
        return None
    source, index, *steps = recipe
    value = F.lit(0.0) if source == "zeros" else F.lit(1.0) if source == "ones" else _at(F.col(source), index)
    for s in steps:
        if s == "clip":
            value = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
        elif s == "invert":
            value = 1 - value
        elif s == "absolute":
            value = absolute_gripper(value, ep)
        elif s[0] == "scale":
            value = value * s[1]
        elif s[0] == "shift":
            value = value + s[1]
        elif s[0] == "fill":
            value = filled_gripper(value, ep, s[1])
        else:
            raise ValueError(s)
    return value


def _step(pose: str, ep: Episode, at: int = 0) -> list[Column]:
    """The six numbers of the step to the next frame, zeros for the last one."""
    now = rot.unpack(F.col(pose), at, 6)
    after = [F.lead(c).over(ep.ordered) for c in now]
    move = [b - a for a, b in zip(now[:3], after[:3], strict=True)]
    return [F.coalesce(x, F.lit(0.0)) for x in [*move, *rot.relative_euler(after[3:], now[3:])]]


def standardized(frames: DataFrame, spec: Spec, ep: Episode, digest_of: str | None = None) -> DataFrame:
    """``(key, order, state, action, language_action, instruction)`` for each frame; ``language_action`` is null where the source has no step.

    The instruction of an episode is its first one; with ``fallback`` a blank one is replaced by one of ``FALLBACKS``, chosen by a
    digest of ``digest_of``, the episode's key if it isn't given.
    """
    rows = without_first(frames, ep) if spec.drop_first else frames
    rows = rows.withColumn("__pose", F.concat(*[_part(p) for p in spec.pose]))
    if spec.axes:
        rows = rows.withColumn("__pose", rot.as_array(rot.change_axes(rot.unpack(F.col("__pose"), 0, 6), rot.constant(rot.AXES[spec.axes]))))
    none = F.lit(None).cast("double")
    grip, command = (_gripper(r, ep) for r in (spec.grip, spec.command))
    rows = rows.withColumn("__grip", none if grip is None else grip).withColumn("__command", none if command is None else command)
    if spec.relabel:
        after = F.lead("__pose").over(ep.ordered)
        rows = rows.withColumn("__after", after).where("__after is not null").withColumn("__moved", F.zip_with("__after", "__pose", lambda b, a: b - a))
    state = F.concat(F.col("__pose"), F.array_compact(F.array("__grip")))
    own = F.array_compact(F.array("__command"))
    if spec.relabel:
        action = F.concat(F.col("__moved"), own)
    elif spec.action == "pose":
        action = F.concat(F.slice("__pose", 1, 6), own)
    elif spec.action == "raw":
        action = F.transform("action", lambda x: x.cast("double"))
    else:
        action = F.concat(*[_part(p) for p in spec.action_parts], own)
    language = F.concat(F.array(*_step("__pose", ep)), own) if spec.step else F.lit(None).cast("array<double>")
    if spec.language_parts:
        language = F.concat(*[_part(p) for p in spec.language_parts], own)
    said = F.first(spec.instruction).over(ep.whole) if spec.instruction in frames.columns else F.lit(None).cast("string")
    if spec.fallback:
        key = F.concat_ws("|", *[F.col(digest_of)] if digest_of else [F.col(k).cast("string") for k in ep.key])
        said = F.when(F.length(F.trim(F.coalesce(said, F.lit("")))) > 0, said).otherwise(hashing.choose("fallback", key, F.array(*[F.lit(x) for x in FALLBACKS])))
    return rows.select(*ep.key, *ep.order, state.alias("state"), action.alias("action"), language.alias("language_action"), said.alias("instruction"))


def standardized_bimanual(frames: DataFrame, steps: tuple, ep: Episode) -> DataFrame:
    """``(key, order, action)``: each arm's step and its gripper command, of state and action with 7 numbers per arm."""
    rows = frames
    for k in (6, 13):
        rows = rows.withColumn(f"__g{k}", _gripper(("action", k, *steps), ep))
    parts = [*_step("state", ep, 0), F.col("__g6"), *_step("state", ep, 7), F.col("__g13")]
    return rows.select(*ep.key, *ep.order, F.array(*parts).alias("action"))


@dataclass(frozen=True)
class DatasetConfig:
    """What is known of a dataset besides its schema."""

    name: str
    frequency: float = 10.0
    morphology: str = "single_arm"
    has_language: bool = True
    state_encoding: str = "POS_EULER"
    action_encoding: str = "EEF_POS"
    extra: dict = field(default_factory=dict)


#: Named mixtures, dataset and weight.
MIXTURES = {
    "libero_finetune": [("libero_spatial_no_noops", 1.0), ("libero_object_no_noops", 1.0), ("libero_goal_no_noops", 1.0), ("libero_10_no_noops", 1.0)],
    "oxe_magic_soup": [
        ("bc_z", 0.05), ("droid", 2.0), ("fractal20220817_data", 1.0), ("bridge_v2_oxe", 1.0), ("taco_play", 2.0), ("jaco_play", 1.0),
        ("furniture_bench_dataset_converted_externally_to_rlds", 0.05), ("utaustin_mutex", 1.0), ("berkeley_fanuc_manipulation", 2.0), ("fmb", 0.05), ("berkeley_autolab_ur5", 1.0),
        ("austin_buds_dataset_converted_externally_to_rlds", 1.0), ("austin_sailor_dataset_converted_externally_to_rlds", 1.0), ("austin_sirius_dataset_converted_externally_to_rlds", 1.0), ("viola", 1.0), ("molmoact_dataset", 1.0),
    ],
}


def mixture_of(name: str) -> list[tuple[str, float]]:
    """A named mixture, or the dataset of that name alone; ``bridge`` stands for ``bridge_v2_oxe``."""
    if name in MIXTURES:
        return MIXTURES[name]
    dataset = "bridge_v2_oxe" if name == "bridge" else name
    spec_of(dataset)
    return [(dataset, 1.0)]


def dispatch(dataset: Column, exact: dict, matchers: list[tuple[int, str, object]], default) -> Column:
    """By exact name, else the matcher of highest priority whose text the name contains, else the default."""
    out = F.lit(default)
    for _, text, target in reversed(sorted(matchers, key=lambda m: -m[0])):
        out = F.when(F.contains(dataset, F.lit(text)), F.lit(target)).otherwise(out)
    for name, target in exact.items():
        out = F.when(dataset == name, F.lit(target)).otherwise(out)
    return out


def check_config(config: DatasetConfig, supported: tuple[str, ...] = ("EEF_POS", "EEF_R6", "ABS_EEF_POS", "JOINT_POS")) -> list[str]:
    """Raises for what can't work, returns warnings for what is doubtful."""
    if config.action_encoding not in supported:
        raise ValueError(f"{config.name}: action encoding {config.action_encoding} is not supported")
    if not config.has_language:
        raise ValueError(f"{config.name}: a language instruction is needed")
    return ["contains suboptimal data"] if config.extra.get("suboptimal") else []


#: Encodings of actions that can be read.
ENCODINGS = ("EEF_POS", "EEF_R6", "ABS_EEF_POS", "JOINT_POS", "JOINT_POS_BIMANUAL")


def config_problem(action_encoding: Column, language: Column, primary: Column) -> Column:
    """Why a dataset's configuration can't be loaded, null if it can: its action encoding, its language annotations or its main camera."""
    spoken = F.lower(F.coalesce(language, F.lit("")))
    wrong = F.when(~F.coalesce(action_encoding.isin(*ENCODINGS), F.lit(False)), "action encoding not supported")
    return wrong.when((spoken == "") | (spoken == "none"), "language annotations required").when(primary.isNull(), "primary image required")


def config_warning(suboptimal: Column) -> Column:
    """A warning for data that is known to be poor, written as ``yes``."""
    return F.when(F.lower(suboptimal) == "yes", "suboptimal data")


def first_state_text(state: Column, ep: Episode, digits: int = 6) -> Column:
    """The sum of an episode's first state as text: names an episode by what it holds, so that copies under other ids get the same fallback."""
    total = F.aggregate(state, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))
    return F.format_string(f"%.{digits}f", F.first(total).over(ep.ordered))
