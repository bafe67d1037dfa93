"""Small cases with hand-made answers, and properties."""

from __future__ import annotations

import contextlib
import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import boxes, hashing, motion_text, rot, scaling, vec
from tidemark.operators import audit, folds, joins, keyframes, masks, mixture, questions, restructure, standardize, stats, windows, work_queue
from tidemark.sources import readers, sinks
from tidemark.streaming import events

EP = windows.Episode()


def one(spark, column, **values):
    base = spark.range(1)
    for name, value in values.items():
        base = base.withColumn(name, F.lit(value) if not isinstance(value, list) else F.array(*[F.lit(v) for v in value]))
    return base.select(column.alias("x")).first()["x"]


def episode(spark, values, key="a"):
    return spark.createDataFrame([(key, t, v) for t, v in enumerate(values)], "episode_id string, t int, v double")


def test_windows_pad(spark):
    rows = episode(spark, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])
    last = rows.select("t", windows.window_zero_padded(F.col("v"), 3, EP).alias("z"), windows.window_last_padded(F.col("v"), 3, EP).alias("l")).where("t = 5").first()
    assert last["z"] == [5.0, 0.0, 0.0] and last["l"] == [5.0, 5.0, 5.0]
    single = episode(spark, [7.0]).select(windows.chunk_relative(F.col("v"), 2, EP).alias("c"), windows.delta_to_next(F.col("v"), EP).alias("d")).first()
    assert single["c"] == [0.0, 0.0] and single["d"] == 0.0


def test_windows_of_no_rows(spark):
    empty = episode(spark, [1.0]).where("false")
    assert windows.relabelled(empty, "v", EP).count() == 0 and windows.runs(empty, "v", EP).count() == 0


def test_gripper_fill_and_absolute(spark):
    rows = episode(spark, [0.5, 0.99, 0.5, 0.01])
    assert [r["g"] for r in rows.select("t", windows.filled_gripper(F.col("v"), EP).alias("g")).orderBy("t").collect()] == [1.0, 1.0, 0.0, 0.0]
    rows = episode(spark, [0.0, 1.0, 0.0, -1.0])
    assert [r["g"] for r in rows.select("t", windows.absolute_gripper(F.col("v"), EP).alias("g")).orderBy("t").collect()] == [1.0, 0.0, 0.0, 1.0]
    still = episode(spark, [0.0, 0.0])
    assert {r["g"] for r in still.select(windows.absolute_gripper(F.col("v"), EP).alias("g")).collect()} == {1.0}


def test_trend_runs_against_plain_python(spark):
    import random

    rng = random.Random(5)
    for _ in range(8):
        values = [rng.choice([0.0, 30.0, 50.0, 51.5, 80.0, 100.0]) for _ in range(rng.randint(0, 25))]
        got = one(spark, folds.trend_runs(F.col("v").cast("array<double>")), v=values) if values else []
        assert [(r["start"], r["rise"]) for r in got] == plain_runs(values)


def plain_runs(p):
    """By the definition: every start with a step of one or more, its longest stretch against which no step goes by over two; those inside an earlier one don't count."""
    steps = [b - a for a, b in zip(p, p[1:], strict=False)]
    reach = {}
    for s, d in enumerate(steps):
        if abs(d) >= 1:
            kept = [e for e in range(s + 1, len(p)) if all(x * d >= -2 * abs(d) for x in steps[s:e])]
            reach[s] = max(kept)
    counts = {s: False for s in reach}
    for s in reach:
        counts[s] = not any(counts[r] and r < s < reach[r] for r in reach)
    return [(s, p[e] > p[s]) for s, e in reach.items() if counts[s] and abs(p[e] - p[s]) >= 20]


def test_lanes_and_segments(spark):
    ivs = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 5), (2, 4), (4, 9))])
    assert one(spark, folds.lanes(ivs)) == [0, 1, 1]
    got = one(spark, folds.segments(F.col("c"), F.lit(30)), c=[3, 10, 14, 27])
    assert [(r["start"], r["end"]) for r in got] == [(0, 10), (10, 30)]


def test_keyframes_of_synthetic_episode(spark):
    frames = readers.synthetic_episode(spark)
    found = {(r["t"], r["kind"]) for r in keyframes.keyframes(frames, EP, "g", ("x", "y", "z")).collect()}
    assert {(0, "begin"), (199, "end"), (39, "grasp"), (49, "release"), (59, "retry"), (149, "release")} <= found


def test_rotations(spark):
    euler = [F.lit(v) for v in (0.3, -0.4, 1.1)]
    back = one(spark, F.array(*rot.matrix_to_euler(rot.euler_to_matrix(euler))))
    assert back == pytest.approx([0.3, -0.4, 1.1])
    assert one(spark, F.array(*rot.r6_to_euler(rot.euler_to_r6(euler)))) == pytest.approx([0.3, -0.4, 1.1])
    yaw = one(spark, F.array(*rot.relative_euler([F.lit(0.0), F.lit(0.0), F.lit(math.radians(30))], [F.lit(0.0)] * 3)))
    assert yaw == pytest.approx([0, 0, math.radians(30)])
    move = [F.lit(v) for v in (0.1, 0.2, 0.3, 0.1, -0.2, 0.3)]
    assert one(spark, F.array(*rot.to_base_frame(rot.to_tool_frame(move, euler), euler))) == pytest.approx([0.1, 0.2, 0.3, 0.1, -0.2, 0.3], abs=1e-6)
    assert one(spark, rot.axis_class([F.lit(0.0), F.lit(-0.3), F.lit(0.0)])) == "pitch"
    assert one(spark, rot.axis_class([F.lit(0.0), F.lit(0.26), F.lit(0.26)])) == "mixed"


def test_scaling_round_trip(spark):
    x, lo, hi = F.lit(3.0), F.lit(1.0), F.lit(7.0)
    assert one(spark, scaling.unbounded(scaling.bounded(x, lo, hi), lo, hi)) == pytest.approx(3.0)
    assert one(spark, scaling.unstandardized(scaling.standardized(x, lo, hi), lo, hi)) == pytest.approx(3.0)
    assert [one(spark, scaling.state_bins(F.lit(v))) for v in (-1.5, -1.0, 0.0, 1.0, 2.0)] == [-1, 0, 128, 255, 255]
    assert one(spark, vec.finite(F.col("a")), a=[1.0, float("nan")]) is False


def test_motion_text_round_trip(spark):
    m = motion_text.Move(F.lit(3.4), F.lit(-2.0), F.lit(0.2), F.lit(1.0), F.lit(14.0), F.lit(0.0), F.lit(-31.0))
    said = one(spark, motion_text.verbose(m))
    assert said == "move forward 3 cm, move right 2 cm, tilt left 10 degrees, rotate clockwise 30 degrees, open gripper"
    p = one(spark, motion_text.parse_verbose(F.lit(said)))
    assert (p["dx"], p["dy"], p["gripper"]) == pytest.approx((0.03, -0.02, 1.0)) and p["yaw"] == pytest.approx(-math.radians(30))
    assert one(spark, motion_text.compact(motion_text.Move(F.lit(3.0), F.lit(-2.0), F.lit(0.0), F.lit(0.0)))) == "<+03 -02 +00 0>"
    assert one(spark, motion_text.from_integers(F.lit("1000 x"), 2)) == [0.0, 0.0]
    assert one(spark, motion_text.from_integers(F.lit("1000 0"), 3)) == [1.0, -1.0, 0.0]


def test_boxes(spark):
    token = boxes.box_tokens(*[F.lit(v) for v in (0.0, 0.25, 0.5, 1.0)])
    assert one(spark, token) == "<loc0256><loc0000><loc1023><loc0512>"
    assert one(spark, boxes.rotate_tokens(boxes.rotate_tokens(token))) == "<loc0256><loc0000><loc1023><loc0512>"
    assert one(spark, boxes.rotate_tokens(F.lit(""))) == ""
    assert one(spark, boxes.rotate_direction(F.lit("move left and forward"))) == "move right and back"


def test_split_is_stable_and_whole(spark):
    rows = spark.range(4000).select("id", hashing.in_validation(3, F.col("id"), 0.025).alias("v"))
    a = {r["id"] for r in rows.where("v").collect()}
    b = {r["id"] for r in rows.orderBy(F.desc("id")).where("v").collect()}
    assert a == b and 40 < len(a) < 180


def test_quota_sample_and_batches(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 900, "big").otherwise("small").alias("ds"))
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0)], "ds string, weight double")
    got = {r["ds"]: r["count"] for r in mixture.quota_sample(rows, weights, "ds", "id", 100).groupBy("ds").count().collect()}
    assert got == {"big": 25, "small": 75}
    batches = mixture.with_batches(rows, hashing.uniform("b", F.col("id")), "id", 64)
    assert {r["count"] for r in batches.groupBy("batch").count().collect()} == {64} and batches.count() == 960


def test_asof_ties_and_nearest(spark):
    rows = spark.createDataFrame([("a", t) for t in range(6)], "k string, t int")
    marks = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y")], "k string, t int, m string")
    back = {r["t"]: r["m"] for r in joins.asof(rows, marks, "k", "t", "m").collect()}
    ahead = {r["t"]: r["m"] for r in joins.asof(rows, marks, "k", "t", "m", forward=True).collect()}
    assert back == {0: None, 1: "x", 2: "x", 3: "x", 4: "x", 5: "y"} and ahead == {0: "x", 1: "y", 2: "y", 3: "y", 4: "y", 5: None}
    near = {r["t"]: r["nearest_at"] for r in joins.nearest(rows, marks, "k", "t").collect()}
    assert near == {0: 1, 1: 1, 2: 1, 3: 1, 4: 5, 5: 5}


def test_histogram_quantile_of_equal_values(spark):
    long = spark.createDataFrame([("d", 4.0)] * 5, "dim string, x double")
    assert stats.histogram_quantiles(long, ["dim"], [0.5]).first()["value"] == 4.0


def test_queue(spark):
    commands = spark.createDataFrame([("u", k, c) for k, c in enumerate(["claim", "claim", "submit", "exclude", "claim", "undo", "claim"])], "id string, n int, c string")
    assert work_queue.states(commands, "id", ["n"], "c").first()["state"] == "hint_claimed"


def test_masks(spark):
    laid = masks.layout(spark.createDataFrame([("a b", "c d e"), (None, "")], "p string, a string"), [("prompt", "p", False), ("action", "a", True)], 6).collect()
    assert laid[0]["tokens"] == ["[prompt]", "a", "b", "[action]", "c", "d"] and laid[0]["loss_mask"] == [False, False, False, True, True, True]
    assert laid[1]["length"] == 2 and laid[1]["pad_mask"] == [True, True, False, False, False, False]


def test_json_repair(spark):
    rows = spark.createDataFrame([('x {"a": [1, {"b": "c"}, {"d": "e',), ("nothing",), (None,), ('{"a": 1, "b": tru',), ('{"a": "x{", "b": "y"} and {"c": 1}',), ('{"a": [1}',), ("{",), ('{"a" 1}',)], "r string")
    got = [r["x"] for r in rows.select(audit.repaired(F.col("r")).alias("x")).collect()]
    assert got == ['{"a": [1, {"b": "c"}, {}]}', None, None, '{"a": 1}', '{"a": "x{", "b": "y"}', '{"a": []}', "{}", None]


def test_replies_cut_at_every_place(spark):
    def closers(text):
        out, inside, k = [], False, 0
        while k < len(text):
            c = text[k]
            if inside and c == "\\":
                k += 1
            elif c == '"':
                inside = not inside
            elif not inside and c in "{[":
                out.append("}" if c == "{" else "]")
            elif not inside and c in "}]":
                out.pop()
            k += 1
        return "".join(reversed(out))

    def brute(text):
        """The longest part that ends with a bracket, a closed text or before a comma and is JSON once its brackets are closed."""
        for e in range(len(text), 0, -1):
            if text[e - 1] in '{}[]"' or text[e : e + 1] == ",":
                with contextlib.suppress(ValueError):
                    done = text[:e] + closers(text[:e])
                    return json.dumps(json.loads(done))
        return None

    whole = json.dumps({"plan": 'say "hi" {now}, \\ ok', "n": [1, -2.5, None, [], {}, [True, {"k": "v,]"}]], "é🙂": {"": "", "last": [{"a": 1, "b": "x"}, {"a": 2}]}}, ensure_ascii=False)
    cuts = [whole[:e] for e in range(1, len(whole) + 1)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(cuts)], "k int, r string")
    got = {r["k"]: r["x"] for r in rows.select("k", audit.repaired(F.col("r")).alias("x")).collect()}
    assert {k: json.dumps(json.loads(x)) for k, x in got.items()} == {k: brute(t) for k, t in enumerate(cuts)}


def test_whole_words(spark):
    assert one(spark, audit.contains_any(F.lit("move the gripper"), audit.GRASP)) is False
    assert one(spark, audit.contains_any(F.lit("Then let go of it"), audit.RELEASE)) is True


def test_every_spec_compiles(spark):
    from tidemark.operators.standardize import SPECS

    for name, spec in SPECS.items():
        fields = {p[1] for p in (*spec.pose, *spec.action_parts) if p[1]} | {r[0] for r in (spec.grip, spec.command) if r and r[0] not in ("zeros", "ones")} | {"action"}
        rows = spark.createDataFrame([("e", t) for t in range(2)], "episode_id string, t int")
        for f in fields:
            rows = rows.withColumn(f, F.array(*[F.lit(0.1 * k) for k in range(1, 30)]))
        out = standardize.standardized(rows, spec, EP)
        assert set(out.columns) == {"episode_id", "t", "state", "action", "language_action", "instruction"}, name
    assert standardize.spec_of("droid_100") == "droid"
    assert standardize.mixture_of("bridge") == [("bridge_v2_oxe", 1.0)] and all(standardize.spec_of(d) for d, _ in standardize.mixture_of("oxe_magic_soup"))
    for name, steps in standardize.BIMANUAL.items():
        both = spark.createDataFrame([("e", t, [0.1 * t] * 14, [50.0] * 14) for t in range(2)], "episode_id string, t int, state array<double>, action array<double>")
        got = [r["action"] for r in standardize.standardized_bimanual(both, steps, EP).orderBy("t").collect()]
        assert len(got[0]) == 14 and got[0][0] == pytest.approx(0.1) and got[1][0] == 0.0, name
    with pytest.raises(KeyError):
        standardize.spec_of("unknown")


def test_sources_and_sinks(spark, tmp_path):
    text = spark.createDataFrame([("# T\n## a\nhello\n## b\n<replace with x>",)], "t string")
    assert text.select(readers.hint_sections(F.col("t")).alias("h")).first()["h"] == {"a": "hello"}
    bad = spark.createDataFrame([('{"f": {"e": {"reasoning": {"0": {"task": "x"}, "z": {}}}}}',), ("{oops",)], "value string")
    assert readers.reasoning_steps(bad).count() == 0
    path = str(tmp_path / "out")
    sinks.append_new(spark.createDataFrame([(1, True), (2, False)], "id int, passed boolean"), path, "id", "passed")
    sinks.append_new(spark.createDataFrame([(1, True), (2, True)], "id int, passed boolean"), path, "id", "passed")
    assert sorted(r["id"] for r in spark.read.json(path).collect()) == [1, 2, 2]
    (tmp_path / "l.json").write_text('{"a": 1}\n{broken\n{"a": 3}\n')
    from pyspark.sql import types as T

    assert [r["a"] for r in readers.json_lines(spark, str(tmp_path / "l.json"), T.StructType([T.StructField("a", T.IntegerType())])).cache().collect()] == [1, 3]


def test_stream_matches_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(300)
    path = str(tmp_path / "in")
    source.write.parquet(path)
    live = events.run_to_table(events.tumbling(events.read_events(spark, path), "1 day", "60 days"), "live_windows", str(tmp_path / "cp"), "complete")
    live.awaitTermination(120)
    got = {(r["start"], r["event_type"], r["n"]) for r in spark.table("live_windows").collect()}
    want = {(r["start"], r["event_type"], r["n"]) for r in events.tumbling(spark.read.parquet(path), "1 day").collect()}
    assert got == want


def test_windows_keep_nulls(spark):
    rows = spark.createDataFrame([("a", t, v) for t, v in enumerate([1.0, None, 3.0, 4.0])], "episode_id string, t int, v double")
    got = rows.select("t", windows.window_zero_padded(F.col("v"), 3, EP).alias("z"), windows.window_last_padded(F.col("v"), 3, EP).alias("l")).orderBy("t").collect()
    assert [r["z"] for r in got] == [[1.0, None, 3.0], [None, 3.0, 4.0], [3.0, 4.0, 0.0], [4.0, 0.0, 0.0]]
    assert [r["l"] for r in got] == [[1.0, None, 3.0], [None, 3.0, 4.0], [3.0, 4.0, 4.0], [4.0, 4.0, 4.0]]
    assert [(r["t"], r["delta"]) for r in windows.relabelled(rows, "v", EP).orderBy("t").collect()] == [(0, None), (1, None), (2, 1.0)]


def test_chunk_poses(spark):
    rows = spark.createDataFrame([("a", t, 1.0 * t, 0.1 * t, 10.0 * t) for t in range(3)], "episode_id string, t int, x double, yaw double, g double")
    zero = F.lit(0.0)
    pose = [F.col("x"), zero, zero, zero, zero, F.col("yaw")]
    got = rows.select("t", windows.chunk_poses(pose, F.col("g"), 2, EP).alias("c"), windows.chunk_poses(pose, F.col("g"), 2, EP, joint=True).alias("j")).orderBy("t").collect()
    assert [[(round(a[0], 9), round(a[5], 9), a[6]) for a in r["c"]] for r in got] == [[(1.0, 0.1, 0.0), (2.0, 0.2, 10.0)], [(1.0, 0.1, 10.0), (1.0, 0.1, 20.0)], [(0.0, 0.0, 20.0), (0.0, 0.0, 20.0)]]
    assert [[a[0] for a in r["j"]] for r in got] == [[0.0, 1.0], [1.0, 2.0], [2.0, 2.0]]


def test_first_interval_keeps_rows_that_share_a_frame(spark):
    rows = spark.createDataFrame([("a", 1, "p"), ("a", 1, "q"), ("a", 9, "r"), (None, 1, "s")], "k string, t int, v string")
    spans = spark.createDataFrame([("a", 0, 3, 2), ("a", 1, 2, 1), ("a", 1, 5, None), ("a", 9, 9, 0)], "k string, start int, end int, n int")
    got = joins.first_interval(rows, spans, "k", "t", "n")
    assert got.columns == ["k", "t", "v", "start", "end", "n"]
    assert sorted((r["v"], r["n"]) for r in got.collect() if r["v"] in "pq") == [("p", 1), ("q", 1)]
    assert {r["v"]: r["n"] for r in got.collect() if r["v"] in "rs"} == {"r": None, "s": None}
    kept = joins.keep_ranges(rows, spans.where("n = 0").select("k", "start", "end"), "k", "t")
    assert kept.count() == 0


def test_step_loop(spark):
    batched = spark.createDataFrame([(k, k // 2) for k in range(8)], "id bigint, batch bigint")
    order = lambda rows: [r["batch"] for r in rows.select("step", "batch").distinct().orderBy("step").collect()]
    assert order(mixture.stepped(batched, 7)) == [0, 1, 2, 3, 0, 1, 2]
    assert order(mixture.stepped(batched, 7, skip=2)) == [2, 3, 2, 3, 2, 3, 2]
    assert order(mixture.stepped(batched, 7, skip=1, restart=False)) == [1, 2, 3]
    assert mixture.stepped(batched, 7, skip=4).count() == 0 and mixture.stepped(batched.where("false"), 3).count() == 0


def test_local_copies(spark):
    copies = spark.createDataFrame([(1, True, False), (2, True, False), (3, False, False), (4, False, False), (5, True, True), (None, False, False)], "id int, annotated boolean, in_review boolean")
    records = spark.createDataFrame([(1, "annotated", None), (2, "hinted", "x"), (3, "available", "x"), (5, "annotated", "")], "id int, status string, hint string")
    found = {r["id"]: r["reason"] for r in restructure.prunable(copies, records, "id").collect()}
    assert found == {1: "annotation on server", 2: None, 3: "hint on server", 4: None, 5: None, None: None}
    assert {r["id"]: r["reason"] for r in restructure.prunable(copies, records, "id", reviewed=True).collect()}[5] == "reviewed"


def test_restructured_frames(spark):
    rows = spark.createDataFrame([("a", 0, [1.0, None], "do @it@ now", "sample_r1_lite"), ("a", 1, [9.0], None, None), ("b", 0, None, " \t", "x")], "episode_id string, t int, act array<double>, say string, dataset_name string")
    assert [r["episode_id"] for r in restructure.within_bounds(rows, "act", EP).collect()] == ["b"]
    assert restructure.within_bounds(rows.where("t = 0"), "act", EP).count() == 2
    assert [r["say"] for r in restructure.instructed(rows, "say").collect()] == ["do @it@ now"]
    made = rows.withColumns({"observation": restructure.observation({}, F.col("act")), "prompt": F.col("say"), "actions": F.coalesce("act", F.array().cast("array<double>"))})
    got = {(r["episode_id"], r["t"]): r["inputs"] for r in restructure.prepared_inputs(made, 3).collect()}
    assert got["a", 0]["prompt"] == " now" and got["a", 1]["prompt"] == "" and got["b", 0]["actions"] == [0.0, 0.0, 0.0]
    assert got["a", 0]["actions"] == [1.0, None, 0.0] and not any(got["a", 0]["image_mask"]) and got["b", 0]["state"] == []
    assert all(restructure.prepared_inputs(made, 3, all_masks=True).first()["inputs"]["image_mask"])
    kept = spark.createDataFrame([("f--g--0",), ("f--g--0",)], "step_id string")
    stepped = restructure.with_step_filter(rows.withColumns({"f": F.lit("f"), "g": F.lit("g")}), kept, "f", "g", "t")
    assert sorted((r["episode_id"], r["t"], r["passes_filter"]) for r in stepped.collect()) == [("a", 0, True), ("a", 1, False), ("b", 0, True)]


def test_log_that_cannot_be_written(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    rows = spark.range(2)
    assert sinks.append_log(rows, str(tmp_path / "log")) and not sinks.append_log(rows, str(tmp_path / "file" / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_point_tokens(spark):
    rows = spark.createDataFrame([(1, [(1.0, 0.0), (0.5, 0.25), (0.0, 1.0)]), (2, []), (3, None)], "id int, points array<struct<x double, y double>>")
    got = {r["id"]: r["c"] for r in rows.select("id", questions.points_text(F.col("points")).alias("c")).collect()}
    assert got == {1: "<loc1023><loc0000><loc0256><loc0512><loc0000><loc1023>", 2: "", 3: None}
    assert rows.select(questions.points_text(F.col("points"), most=1).alias("c")).first()["c"] == "<loc0000><loc1023>"
    none = rows.select(questions.caption_sample(F.col("id"), F.array().cast("array<string>"), 1)[1].alias("c")).first()["c"]
    assert none is None
