"""Every standardisation of a source schema against answers written out by hand from what the schema means.

All frames of an episode turn about the upright axis only, so a pose's angles are (0, 0, turn) in whichever form they are stored, and
its step is known: a centimetre on x, two on y, one down, a tenth of a radian.  The expected columns are Python expressions over a frame's
fields; nothing in them comes from the specs.
"""

from __future__ import annotations

import math

import pytest

from tidemark.operators import standardize
from tidemark.operators.windows import Episode

N = 6
ENDING = [0.5, 1.0, 0.5, 0.0, 0.5, 0.97]  # of actions
#: What the ends become: filled backwards at 0.95, and clipped and turned round.
FILLED = [1, 1, 0, 0, 1, 1]
RELATIVE = [0.0, -1.0, 0.05, 1.0, 0.0, -0.5]
ABSOLUTE = [0, 1, 1, 0, 0, 1]
JAWS, COMMANDED = [0.2, 0.9, 0.4, 0.6, 0.45, 0.7], [0.9, 0.2, 0.1, 0.8, 0.7, 0.3]
TABLE = [-1.5, 0.0, 0.5, 1.0, 3.0, -1.0]
TABLE_HALF = [0, 0.5, 0.75, 1, 1, 0]


def clip(x):
    return min(max(x, 0.0), 1.0)


def frame(t):
    """The fields of frame t."""
    x, y, z, turn = 0.1 + 0.01 * t, -0.2 + 0.02 * t, 0.3 - 0.01 * t, 0.05 + 0.1 * t
    s, c, hs, hc = math.sin(turn), math.cos(turn), math.sin(turn / 2), math.cos(turn / 2)
    place, upright, quaternion = [x, y, z], [0.0, 0.0, turn], [0.0, 0.0, hs, hc]
    matrix = [c, s, 0.0, 0.0, -s, c, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, x, y, z, 1.0]
    more = [0.06 + 0.01 * k for k in range(18)]
    return {
        "state": [*place, *upright, *more], "action": [*(0.5 + 0.01 * k for k in range(14)), ENDING[t]], "cartesian_position": [*place, *upright], "gripper_position": [JAWS[t]],
        "action_gripper_position": [COMMANDED[t]], "gripper_closedness_action": [RELATIVE[t]], "world_vector": [0.31, 0.32, 0.33], "rotation_delta": [0.41, 0.42, 0.43], "open_gripper": [t % 2],
        "base_pose_tool_reached": [*place, *quaternion], "gripper_closed": [0.1 * t], "robot_obs": [*place, *upright, 0.05, 9.0, 9.0], "rel_actions_world": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, TABLE[t]],
        "end_effector_cartesian_pos": [*place, *upright, 0.2], "ee_states": matrix, "gripper_states": [0.0395], "robot_state": [7.0] * 6 + [*place, *quaternion, 0.3, 8.0], "state_ee": matrix,
        "present_xyz": [*place, 9.0], "present_axis_angle": [*upright, 9.0], "present_sensed_close": [0.6], "future_target_close": [t % 2], "end_effector_pose": [x, y, z, 0.4, 0.7],
        "ground_truth_ee": [*place, *upright], "end_effector_state": [*place, *quaternion], "position": [x, y], "yaw": [turn], "eef_pose": [*place, *quaternion], "state_gripper_pose": [0.35],
        "tcp_base": [*place, *upright], "gripper_width": [0.08], "action_tcp_base": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], "action_gripper": [0.25],
        "place": place, "upright": upright, "pose": [*place, *upright], "quaternion": quaternion, "matrix": matrix, "turn": turn, "t": t,
        "STEP": [0.01, 0.02, -0.01, 0, 0, 0.1] if t < N - 1 else [0] * 6, "flat": [0.01, 0.02, -0.01, 0, 0, 0] if t < N - 1 else [0] * 6,
    }


RAW = "state[:6] + state[-1:]"
#: By transform: fields of other shapes, then state, action and step. None: the source has no step; a missing state is the source's own.
ANSWERS = {
    "bridge_v2_oxe": dict(state="pose + [clip(state[-1])]", action="pose + [FILLED[t]]", step="STEP + [FILLED[t]]", frames=range(1, 6)),
    "bridge_orig": dict(state=RAW, action="[0.01, 0.02, -0.01, 0, 0, 0.1, FILLED[t]]", frames=range(1, 5)),
    "ppgm": dict(state="pose + [JAWS[t]]", action="action[:6] + [FILLED[t]]"),
    "rt1": dict(state="pose + [1 - 0.1 * t]", action="pose + [ABSOLUTE[t]]", step="STEP + [ABSOLUTE[t]]"),
    "kuka": dict(state="pose + [1 - 0.1 * t]", action="pose + [ABSOLUTE[t]]", step="STEP + [ABSOLUTE[t]]"),
    "taco_play": dict(state="pose + [0.619515]", action="pose + [TABLE_HALF[t]]", step="STEP + [TABLE_HALF[t]]"),
    "jaco_play": dict(state="[-place[1], place[0], place[2]] + upright + [0.866]", action="[-place[1], place[0], place[2]] + upright + [ABSOLUTE[t]]", step="[-STEP[1], STEP[0]] + STEP[2:] + [ABSOLUTE[t]]"),
    "berkeley_cable_routing": dict(action="world_vector + rotation_delta + [0]"),
    "roboturk": dict(action="world_vector + rotation_delta + [[1, 1, 0.95, 0, 1, 1][t]]"),
    "nyu_door_opening": dict(action="world_vector + rotation_delta + [ABSOLUTE[t]]"),
    "viola": dict(state="pose + [0.5]", action="pose + [[1, 1, 0.95, 0, 1, 1][t]]", step="STEP + [[1, 1, 0.95, 0, 1, 1][t]]"),
    "berkeley_autolab_ur5": dict(state="pose + [0.7]", action="pose + [ABSOLUTE[t]]", step="STEP + [ABSOLUTE[t]]"),
    "toto": dict(action="world_vector + rotation_delta + [t % 2]"),
    "language_table": dict(given={"action": "[0.5, 0.6]"}, action="[0.5, 0.6, 0, 0, 0, 0, 1]"),
    "pusht": dict(action="world_vector + rotation_delta + [RELATIVE[t]]"),
    "stanford_kuka_multimodal": dict(action="[0.5, 0.51, 0.52, 0, 0, 0, ENDING[t]]"),
    "nyu_rot": dict(state=RAW, action="action[:7]"),
    "stanford_hydra": dict(state="place + [0.07, 0.08, 0.09] + [1 - 0.21]", action="action[:6] + [1 - ENDING[t]]"),
    "austin_buds": dict(given={"state": "[0.1] * 7 + [0.0395] + matrix"}, state="pose + [0.5]", action="pose + [1 - clip(ENDING[t])]", step="STEP + [1 - ENDING[t]]", said="fallback"),
    "nyu_franka_play": dict(eef="state[-6:]", action="[0.57, 0.58, 0.59, 0.6, 0.61, 0.62, 0.63]"),
    "droid": dict(state="pose + [[1, 0, 1, 0, 1, 0][t]]", action="pose + [[0, 1, 1, 0, 0, 1][t]]", step="STEP + [[0, 1, 1, 0, 0, 1][t]]"),
    "maniskill": dict(state="pose + [0.07]", action="action"),
    "furniture_bench": dict(given={"state": "place + quaternion + [0.0395]"}, state="pose + [0.5]", action="pose + [1 - ENDING[t]]", step="STEP + [1 - ENDING[t]]"),
    "cmu_franka_exploration": dict(action="action[:14]"),
    "ucsd_kitchen": dict(action="action[:14]"),
    "ucsd_pick_place": dict(state=RAW, action="[0.5, 0.51, 0.52, 0, 0, 0, ENDING[t]]"),
    "austin_sailor": dict(given={"state": "[0.1] * 7 + [0.0395]"}, state="pose + [0.5]", action="pose + [1 - ENDING[t]]", step="STEP + [1 - ENDING[t]]", said="fallback"),
    "austin_sirius": dict(given={"state": "[0.1] * 7 + [0.0395]"}, state="pose + [0.5]", action="pose + [1 - ENDING[t]]", step="STEP + [1 - ENDING[t]]", said="fallback"),
    "bc_z": dict(state="[-place[1], -place[0], -place[2], 0, 0, -turn, 0.5]", action="[-place[1], -place[0], -place[2], 0, 0, -turn, 1 - t % 2]", step="[-STEP[1], -STEP[0], -STEP[2], 0, 0, -STEP[5], 1 - t % 2]"),
    "tokyo_pr2_opening_fridge": dict(state=RAW, action="action[:14]"),
    "tokyo_pr2_tabletop_manipulation": dict(state=RAW, action="action[:14]"),
    "utokyo_xarm_pick_place": dict(action="action"),
    "utokyo_xarm_bimanual": dict(action="action[8:]"),
    "robo_net": dict(state="place + [0, 0, 0, 0.23]", action="[0.5, 0.51, 0.52, 0.53, 0, 0, ENDING[t]]"),
    "berkeley_mvp": dict(action="action"),
    "berkeley_rpt": dict(action="action"),
    "kaist_nonprehensible": dict(state="state[-7:]", action="action[:6] + [0]"),
    "stanford_mask_vit": dict(state="place + [0.4, 0, 0, 0.7]", action="[0.5, 0.51, 0.52, 0.53, 0, 0, ENDING[t]]"),
    "tokyo_lsmo": dict(state=RAW, action="action"),
    "dlr_sara_pour": dict(action="action"),
    "dlr_sara_grid_clamp": dict(state="pose", action="action"),
    "dlr_edan_shared_control": dict(given={"state": "place + [turn, 0.0, 0.0, 0.3]"}, state="pose + [0.7]", action="pose + [1 - ENDING[t]]", step="STEP + [1 - ENDING[t]]"),
    "asu_table_top": dict(state="pose + [0.23]", action="action"),
    "robocook": dict(state=RAW, action="action"),
    "imperial_wristcam": dict(action="action[:14]"),
    "iamlab_pick_insert": dict(given={"action": "[0.1, 0.2, 0.3] + quaternion + [0.9]"}, grip="0.07", action="[0.1, 0.2, 0.3] + upright + [0.9]"),
    "uiuc_d3field": dict(given={"action": "[0.1, 0.2, 0.3]"}, action="[0.1, 0.2, 0.3, 0, 0, 0, 0]"),
    "utaustin_mutex": dict(given={"state": "[0.1] * 7 + [0.0395] + matrix"}, state="pose + [0.5]", action="pose + [1 - ENDING[t]]", step="STEP + [1 - ENDING[t]]"),
    "molmoact": dict(state="state[:-1] + [1 - 0.23]", action="pose + [1 - ENDING[t]]", step="action[:14] + [1 - ENDING[t]]"),
    "berkeley_fanuc": dict(state="pose + [0.94]", action="pose + [0.94]", step="action + [0.94]"),
    "cmu_playing_with_food": dict(given={"action": "[0.1, 0.2, 0.3] + quaternion + [0.9]"}, action="[0.1, 0.2, 0.3] + upright + [0.9]"),
    "playfusion": dict(action="[0.5, 0.51, 0.52, 0.61, 0.62, 0.63, ENDING[t]]"),
    "cmu_stretch": dict(state="place + [0, 0, 0, 3.37 / 6.28]", action="place + [0, 0, 0, 3.37 / 6.28]", step="flat + [3.37 / 6.28]"),
    "gnm": dict(state="place[:2] + [0, 0, 0, turn, 0]", action="place[:2] + [0, 0, 0, turn, 0]", step="STEP[:2] + [0] + STEP[3:] + [0]"),
    "fmb": dict(state="pose + [0.65]", action="pose + [1 - ENDING[t]]", step="STEP + [1 - ENDING[t]]"),
    "dobbe": dict(state="[place[1], -place[0], place[2]] + upright + [0.23]", action="[place[1], -place[0], place[2]] + upright + [ENDING[t]]", step="[STEP[1], -STEP[0]] + STEP[2:] + [ENDING[t]]"),
    "roboset": dict(state="state[:-1] + [1 - 0.23]", action="action[:7] + [1 - ENDING[t]]"),
    "rh20t": dict(state="pose + [0.08]", action="[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.25]"),
    "tdroid": dict(state="pose + [JAWS[t]]", action="action[:6] + [FILLED[t]]"),
    "libero": dict(given={"state": "pose + [0.02, 0.7]"}, state="pose + [0.5]", action="action[:6] + [1 - ENDING[t]]", step="STEP + [1 - ENDING[t]]"),
    "human": dict(action="action"),
    "franka": dict(given={"state": "pose + [0.3]"}, state="pose + [0.7]", action="pose + [1 - ENDING[t]]", step="STEP + [1 - ENDING[t]]"),
    "yam_jointpos": dict(action="action", step="STEP + [ENDING[t]]"),
    "yam": dict(action="pose + [ENDING[t]]", step="STEP + [ENDING[t]]"),
    "planning": dict(
        given={"state": "place + [0.4, 0.5, 0.6] + [quaternion[3]] + quaternion[:3] + [0.7, 0.8]", "action": "[0.1] * 6 + upright + [0.3, 0.4]"},
        state="place + [0.4, 0.5, 0.6] + [matrix[0], -matrix[1], 0, matrix[1], matrix[0], 0] + [0.7, 0.8]", action="[0.1] * 6 + [matrix[0], -matrix[1], 0, matrix[1], matrix[0], 0] + [0.3, 0.4]",
    ),
}
TWO_ARMS = {"sample_r1_lite": "STEP + [0.0056] + STEP + [0.0063]", "agibot_large": "STEP + [1 - 0.56] + STEP + [1 - 0.63]"}
EP = Episode()


def told(expression, fields):
    return eval(expression, {"clip": clip, "FILLED": FILLED, "ABSOLUTE": ABSOLUTE, "RELATIVE": RELATIVE, "ENDING": ENDING, "JAWS": JAWS, "TABLE_HALF": TABLE_HALF}, dict(fields))


def frames_of(spark, given=None):
    rows = [frame(t) for t in range(N)]
    rows = [r | {k: told(v, r) for k, v in (given or {}).items()} for r in rows]
    arrays = [k for k, v in rows[0].items() if isinstance(v, list) and k not in ("place", "upright", "pose", "quaternion", "matrix", "STEP", "flat")]
    cells = [(1, t, "" if t == 0 else "later", "say it", *[[float(x) for x in r[a]] for a in arrays]) for t, r in enumerate(rows)]
    schema = "episode_id bigint, t bigint, language_instruction string, natural_language_instruction string, " + ", ".join(f"{a} array<double>" for a in arrays)
    return rows, spark.createDataFrame(cells, schema).coalesce(1)


def test_every_transform_has_an_answer():
    assert set(ANSWERS) | set(TWO_ARMS) == set(standardize.SPECS) | set(standardize.BIMANUAL)


NATURAL = "rt1 kuka taco_play jaco_play berkeley_cable_routing roboturk nyu_door_opening viola berkeley_autolab_ur5 toto pusht bc_z".split()


@pytest.mark.parametrize("name", sorted(ANSWERS))
def test_transform(spark, name):
    want = ANSWERS[name]
    rows, table = frames_of(spark, want.get("given"))
    got = {r["t"]: r for r in standardize.standardized(table, standardize.SPECS[name], EP).collect()}
    assert sorted(got) == list(want.get("frames", range(N)))
    for t, r in got.items():
        for column, key in (("state", "state"), ("action", "action"), ("language_action", "step")):
            if key in want:
                assert r[column] == pytest.approx(told(want[key], rows[t]), abs=1e-6), (t, column)
            elif key == "step":
                assert r[column] is None
        if "eef" in want:
            assert r["state"][:6] == pytest.approx(told(want["eef"], rows[t]), abs=1e-6)
        if "grip" in want:
            assert r["state"][-1] == pytest.approx(float(want["grip"]))
        if want.get("said") == "fallback":
            assert r["instruction"] in standardize.FALLBACKS
        else:
            assert r["instruction"] == ("say it" if name in NATURAL else "" if 0 in got else "later")


@pytest.mark.parametrize("name", sorted(TWO_ARMS))
def test_two_arms(spark, name):
    given = {"state": "pose + [9.0] + pose + [9.0]"}
    rows, table = frames_of(spark, given)
    got = {r["t"]: r["action"] for r in standardize.standardized_bimanual(table, standardize.BIMANUAL[name], EP).collect()}
    for t, r in got.items():
        assert r == pytest.approx(told(TWO_ARMS[name], rows[t]), abs=1e-6)
