"""Cascade texts, question pairs, rules over phases, box questions and quantile sketches on hand-made rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.motion_text import Move
from tidemark.operators import box_questions, cascade, phase_audit, question_pairs, standardize, stats

PHASES = "array<struct<kind:string,arm_tag:string,subgoal_prompt:string,subgoal_reasoning:array<string>,phase_prompts:array<string>>>"
META = f"dataset string, task_prompt string, phases {PHASES}, told array<string>, descriptor string, color string, place string"


def cascaded(spark, row, number):
    meta = {c: F.col(c) for c in ("dataset", "task_prompt", "phases", "told", "descriptor", "color", "place")}
    table = spark.createDataFrame([row], META)
    return table.select(cascade.texts(meta, F.col("phases")[number], F.lit(number), F.lit("key")).alias("t")).first()["t"].asDict()


def test_cascade_of_each_family(spark):
    bare = ("grasp", None, None, None, None)
    got = cascaded(spark, ("pick_place_primitive_more", "ignored", [bare], None, "the red cube", "red", "on the left"), 0)
    assert got["family"] == "pick_place" and got["plan"] == got["task_prompt"] == "Pick up the red cube and place it on the left."
    assert got["stage"] in [t.format(color="red", arm="left", dest="on the left") for t in cascade.REASONS["grasp"]] and got["action"] == "Move the left gripper to manipulate the cube."
    phases = [("a", "right", " Lift it ", ["why"], ["do"]), ("a", "right", "Lift it", [], None), ("a", None, "Drop it.", None, []), ("a", None, "  ", None, None)]
    row = ("arrange_blocks_line", "Line up", phases, ["[Subgoal] no [Step] x", "[Subgoal] to lift.. [Step] go"], None, None, None)
    assert cascaded(spark, row, 0) == {"family": "arrange", "task_prompt": "Line up", "plan": "Lift it. Drop it.", "stage": "why", "action": "do"}
    assert cascaded(spark, row, 1)["stage"] == "to lift" and cascaded(spark, row, 1)["action"] == "Line up"
    assert cascaded(spark, row, 2)["stage"] == "Drop it." and cascaded(spark, row, 3)["stage"] == "  "
    stack = ("stack_blocks_n_stack_n_v1", None, [bare], None, None, None, None)
    assert cascaded(spark, stack, 0) == {"family": "stack", "task_prompt": "", "plan": "", "stage": "", "action": ""}
    assert set(cascaded(spark, ("unknown", "t", phases, None, None, None, None), 0).values()) == {None}


def test_questions_of_one_kind(spark):
    row = spark.createDataFrame([(1, 3.2, -1.6, 0.2, 0.9, 12.0, 0.0, 0.0, 0.1, "a task", "droid_100", ["x", "y", "z"]), (2, None, None, None, None, None, None, None, None, None, None, None)],
        "k int, dx double, dy double, dz double, g double, r double, p double, w double, before double, task string, dataset string, images array<string>")
    move = Move(*[F.col(c) for c in ("dx", "dy", "dz", "g", "r", "p", "w")])

    def ask(kind, style="verbose"):
        made = question_pairs.question(F.col("k"), move, F.col("before"), F.col("task"), F.col("dataset"), F.col("images"), F.lit("base frame"), [(kind, 1.0)], [(style, 1.0)])
        return [r["q"] for r in row.select(made.alias("q")).orderBy("k").collect()]

    whole, nothing = ask("delta_motion")
    assert whole["prompt"] in [t.replace("{frame_ref}", " (in base frame)") for t in question_pairs.PROMPTS["delta_motion"]] and whole["answer"] == "move forward 3 cm, move right 2 cm, open gripper"
    assert nothing["kind"] == "delta_motion" and nothing["images"] is None
    assert "tilt left" in ask("delta_motion", "verbose_with_rotation")[0]["answer"] and "tilt" in ask("delta_motion", "qualitative")[0]["answer"]
    assert ask("task_prediction")[0]["answer"] == "a task" and "move forward 3 cm" in ask("task_prediction")[0]["prompt"]
    assert ask("gripper_prediction")[0]["answer"] == "opened" and ask("embodiment_identification")[0]["answer"] == "DROID (Franka Panda)"
    order = ask("temporal_ordering")[0]
    assert (order["answer"], order["images"]) in (("first", ["x", "y", "z"]), ("second", ["y", "x", "z"]))


def test_prompts_of_boxes(spark):
    every = box_questions.box_prompts(box_questions.IN_IMAGE + box_questions.AT_BASE)
    assert len(every) == 59 and every[0] == ("Pick up the ", ", predict where it is in the image.") and every[31] == ("Navigate to the ", ", looking from the external camera.")
    row = spark.createDataFrame([(7, None, 0.1, 0.1, 0.2, 0.2)], "i int, c string, a double, b double, d double, e double")
    corners = [F.col(x) for x in "abde"]
    prompt, caption = box_questions.box_sample(F.col("i"), F.col("c"), corners, 1, direction_share=1.0)
    got = row.select(prompt.alias("p"), caption.alias("c"), box_questions.box_id("set", F.col("i"), F.col("c"), corners).alias("id")).first()
    assert got["p"] in [a + b for a, b in every] and got["c"] == "move left" and got["id"].startswith("set_7_")


def phase(kind="move", s="still", pred="goes up", a="<think>plan</think> go", fix=None, ok=True, frame=0, end=None):
    return kind, s, pred, a, fix, ok, frame, end


def audited(spark, phases):
    rows = [(1, k, *p) for k, p in enumerate(phases)]
    return phase_audit.audit(spark.createDataFrame(rows, f"e int, k int, {phase_audit.PHASE}"), "e", "k").first()


def test_rules_over_phases(spark):
    begin = phase("begin", pred=None, a=None, ok=None)
    good = audited(spark, [begin, phase(frame=10, end=30), phase(a="go", frame=30, end=50), phase(a="slip", fix="<think>fix</think> go", ok=False, frame=40, end=100), phase(a="on", frame=90, end=95)])
    assert good["passed"] and good["issues"] == [] and (good["first_diverge"], good["recoveries"], good["overlaps"], good["tiled"], good["bounds_ok"]) == (3, 1, 2, 1, True)
    bad = audited(spark, [phase("begin", pred="x", a=None), phase(s="is going to lift", pred="moves 3 cm", a="go 3 cm", end=70), phase(a="<think>no</think>", ok=False), phase(s=" ", pred=None, fix="extra", a="b")])
    assert bad["issues"] == ["0:bracket-acts", "1:foreshadow-in-s", "1:first-move-without-plan", "1:prediction-echoes-action", "2:correction-against-supervision", "2:think-on-failure", "3:s=empty", "3:s_pred=empty", "3:correction-against-supervision"]
    assert not bad["passed"] and not bad["bounds_ok"] and bad["first_diverge"] == 2


def test_merged_sketches_stay_within_their_bound(spark):
    rng = random.Random(2)
    rows = [(k % 7, rng.gauss(0, 1) * (k % 7 + 1)) for k in range(60_000)] + [(0, None), (1, float("nan")), (2, float("inf"))]
    table = spark.createDataFrame(rows, "d int, x double").repartition(5)
    merged = stats.merged_sketches(stats.quantile_sketches(table, ["d"], "x"), [])
    got = stats.sketch_quantiles(merged, [0.01, 0.25, 0.5, 0.99]).first()
    values = sorted(x for _, x in rows[:60_000])
    assert (got["n"], got["lo"], got["hi"]) == (60_000, values[0], values[-1])
    for share in (0.01, 0.25, 0.5, 0.99):
        rank = sum(v <= got[f"q{round(100 * share)}"] for v in values) / 60_000
        assert abs(rank - share) < 0.0165 * 2
    assert stats.quantile_sketches(table.where("false"), ["d"], "x").count() == 0


def test_configurations(spark):
    rows = [("EEF_POS", "english", "image", "no", None), ("POLAR", "english", "image", None, "action encoding not supported"), (None, "english", "image", None, "action encoding not supported"), ("JOINT_POS_BIMANUAL", " None".strip(), "image", "Yes", "language annotations required"), ("EEF_R6", None, "image", None, "language annotations required"), ("EEF_R6", "x", None, None, "primary image required")]
    table = spark.createDataFrame(rows, "enc string, lang string, cam string, sub string, want string")
    got = table.select("want", standardize.config_problem(F.col("enc"), F.col("lang"), F.col("cam")).alias("got"), standardize.config_warning(F.col("sub")).alias("w")).collect()
    assert all(r["want"] == r["got"] for r in got) and [r["w"] for r in got] == [None, None, None, "suboptimal data", None, None]


@pytest.mark.parametrize("copies", [1, 3])
def test_fallback_key_is_the_first_state(spark, copies):
    from tidemark.operators.windows import Episode

    rows = [(e, t, [0.1 * t + 0.5, None]) for e in range(copies) for t in range(3)]
    table = spark.createDataFrame(rows, "episode_id int, t int, state array<double>")
    assert {r["k"] for r in table.select(standardize.first_state_text(F.col("state"), Episode()).alias("k")).collect()} == {"0.500000"}
