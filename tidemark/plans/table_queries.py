"""Sources, projections, standardisation and streaming twins on the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vec
from tidemark.operators import joins, standardize
from tidemark.plans.geometry_queries import E, R, X, _turned, angles, axis, fixed_axes, flipped, named, product, shown, stage
from tidemark.plans.registry import EP, POSES, query, rounded
from tidemark.plans.registry import table as read
from tidemark.sources import readers
from tidemark.streaming import events as stream


def _cells(*ks: int) -> list[tuple[int, bool]]:
    """Places in the embedding, negative ones lifted from about -1..1 to the range of a gripper."""
    return [(abs(k), k < 0) for k in ks]


#: The source fields that specs read, made of the pose fixture.
FIELDS = {
    "state": _cells(1, 2, 3, 4, 5, 6, -7, -8), "action": _cells(9, 10, 11, 12, 13, 14, -15), "eef_pose": _cells(*range(1, 8)), "state_gripper_pose": _cells(-8),
    "cartesian_position": _cells(*range(1, 7)), "gripper_position": _cells(-8), "action_gripper_position": _cells(-15), "end_effector_cartesian_pos": _cells(1, 2, 3, 4, 5, 6, -8),
    "base_pose_tool_reached": _cells(*range(1, 8)), "gripper_closed": _cells(-8), "robot_obs": _cells(1, 2, 3, 4, 5, 6, -7), "rel_actions_world": _cells(9, 10, 11, 12, 13, 14, -15),
    "world_vector": _cells(9, 10, 11), "rotation_delta": _cells(12, 13, 14), "open_gripper": _cells(-15), "robot_state": _cells(*range(1, 7), 1, 2, 3, 4, 5, 6, 7, -8),
    "end_effector_pose": _cells(1, 2, 3, 4, -7), "ground_truth_ee": _cells(*range(1, 7)), "end_effector_state": _cells(*range(1, 8)), "position": _cells(1, 2), "yaw": _cells(3),
    "tcp_base": _cells(*range(1, 7)), "gripper_width": _cells(-7), "action_tcp_base": _cells(*range(9, 15)), "action_gripper": _cells(-15),
}


def _raw(spark, sf):
    """The pose fixture with the field names that source schemas use, each an array."""
    a = F.transform("embedding", lambda x: x.cast("double"))
    rows = read(spark, sf, "embeddings").select(F.col("label").alias("episode_id"), F.col("vec_id").alias("t"), a.alias("a"))
    part = lambda lo, n: F.slice("a", lo, n)
    lift = lambda c: F.transform(c, lambda x: x * 4 + 0.5)
    cell = lambda k, lifted: lift(part(k, 1)) if lifted else part(k, 1)
    made = [F.concat(*[cell(k, lifted) for k, lifted in cells]).alias(name) for name, cells in FIELDS.items()]
    return rows.select(
        "episode_id", "t", *made, F.transform(part(16, 1), lambda x: x * 10).alias("gripper_closedness_action"),
        F.when(F.col("t") % 2 == 0, "").otherwise("pick it").alias("language_instruction"), F.lit("say it").alias("natural_language_instruction"),
    )


def _standard(name):
    def run(spark, sf):
        out = standardize.standardized(_raw(spark, sf), standardize.SPECS[name], EP)
        show = lambda c, n, p: [rounded(F.get(c, F.lit(k))).alias(f"{p}{k}") for k in range(n)]
        return out.select("t", *show("state", 7, "s"), *show("action", 7, "a"), *show("language_action", 7, "l"), F.coalesce("instruction", F.lit("")).alias("said"))

    return run


_RAW = POSES.replace("row_number() over (partition by label order by vec_id) - 1 as t, vec_id", "vec_id as t")
_AFTER = "n as (select *, " + ", ".join(f"lead(e{k}) over (partition by episode_id order by t) as n{k}" for k in range(1, 7)) + " from {src})"
_CLIP = "least(greatest({0}, 0), 1)"


def _sql(pose: list, grip: str, action: list, command: str, said: str, ctes: str = "", source: str = "poses", step: bool = True) -> str:
    """SQL for a spec: pose columns become e1 to e6, then the step to the next row is composed from rotations."""
    cells = [*(f"{p} as e{k + 1}" for k, p in enumerate(pose)), f"{grip} as grip", f"{command} as command", *(f"{a} as c{k}" for k, a in enumerate(action)), f"{said} as said"]
    made = f"z as (select episode_id, t, {', '.join(cells)} from {source})"
    move = [X(f"n{k}") - E[k] for k in (1, 2, 3)]
    turns = f"{stage('n', 'm2', r=fixed_axes(E[4], E[5], E[6]))}, {stage('m2', 'o2', s=fixed_axes(X('n4'), X('n5'), X('n6')))}, {stage('o2', 'd', d=product(flipped(R), named(range(9), 's')))}"
    moves = [f"coalesce({x}, 0)" for x in [*move, *angles(named(range(9), "d"))]]
    own = [f"c{k}" if action else f"e{k + 1}" for k in range(6)]
    values = [*[f"e{k}" for k in range(1, 7)], "grip", *own, "command"]
    names = [*[f"s{k}" for k in range(7)], *[f"a{k}" for k in range(7)]]
    last = [f"l{k}" for k in range(7)]
    steps = shown([*moves, "command"], last) if step else ", ".join(f"null::double as {x}" for x in last)
    return f"with {_RAW}, {ctes + ', ' if ctes else ''}{made}, {_AFTER.format(src='z')}, {turns} select t, {shown(values, names)}, {steps}, said from d"


_OVER = "over (partition by episode_id order by t rows between {0})"
_POSE = [f"e{k}" for k in range(1, 7)]
_G7, _G8, _G15 = "(e7 * 4 + 0.5)", "(e8 * 4 + 0.5)", "(e15 * 4 + 0.5)"
_FIRST = "first_value(case when t % 2 = 0 then '' else 'pick it' end) over (partition by episode_id order by t)"
_ACT = [f"e{k}" for k in range(9, 15)]


def _fill(g: str, threshold: float) -> str:
    decided = f"case when {g} > {threshold} then 1.0::double when {g} < 1 - {threshold}::double then 0.0::double end"
    return f"coalesce(first_value({decided} ignore nulls) {_OVER.format('current row and unbounded following')}, last_value({g}) {_OVER.format('unbounded preceding and unbounded following')})"


def _axes(c: tuple) -> str:
    m = [X(f"{float(v)!r}::double") for v in c]
    return f"{stage('poses', 'm', r=fixed_axes(E[4], E[5], E[6]))}, {stage('m', 'w', s=product(product(m, R), flipped(m)))}"


_S = named(range(9), "s")
_COMMAND = "case when e16 * 10 < -0.1 then 1 when e16 * 10 > 0.1 then -1 end"
_ABSOLUTE = f"coalesce(last_value({_COMMAND} ignore nulls) {_OVER.format('unbounded preceding and current row')}, -first_value({_COMMAND} ignore nulls) {_OVER.format('current row and unbounded following')}, 1) / 2.0::double + 0.5::double"
_LENGTH = X("sqrt(e4 * e4 + e5 * e5 + e6 * e6)")
_TURN = f"{stage('poses', 'a', h=[_LENGTH])}, {stage('a', 'q', q=[*(e / X('h0') * X('sin(h0 / 2)') for e in E[4:7]), X('cos(h0 / 2)')])}, {stage('q', 'w', r=_turned(named(range(4), 'q')))}"
_UNIT = X("sqrt(e4 * e4 + e5 * e5 + e6 * e6 + e7 * e7)")
_QUATERNION = f"{stage('poses', 'q', q=[e / _UNIT for e in E[4:8]])}, {stage('q', 'w', r=_turned(named(range(4), 'q')))}"
_ZXY = stage("poses", "w", r=product(product(axis(2, E[4]), axis(0, E[5])), axis(1, E[6])))
_LATER = "w as (select * from poses qualify row_number() over (partition by episode_id order by t) > 1)"
_NEXT = [f"lead(e{k}) over (partition by episode_id order by t) - e{k}" for k in range(1, 7)]

query("op_std_delta_yam", _sql(_POSE, _G8, [], _CLIP.format(_G15), _FIRST))(_standard("yam"))
query("op_std_gripper_franka", _sql(_POSE, f"1 - {_CLIP.format(_G7)}", [], f"1 - {_CLIP.format(_G15)}", _FIRST))(_standard("franka"))
query("op_std_axes_dobbe", _sql(["e2", "-e1", "e3", *angles(_S)], _CLIP.format(_G8), [], _G15, _FIRST, _axes((0, 1, 0, -1, 0, 0, 0, 0, 1)), "w"))(_standard("dobbe"))
query("op_std_binarize_droid", _sql(_POSE, _fill(f"(1 - {_G8})", 0.5), [], _CLIP.format(_fill(f"(1 - {_G15})", 0.5)), _FIRST))(_standard("droid"))
query("op_std_quaternion_fmb", _sql([*_POSE[:3], *angles(R)], _CLIP.format(f"1 - {_G8}"), [], f"1 - {_G15}", _FIRST, _QUATERNION, "w"))(_standard("fmb"))
query("op_std_axis_angle_libero", _sql([*_POSE[:3], angles(R)[0], "asin(-r6)", angles(R)[2]], _CLIP.format(f"{_G7} * 25"), _ACT, f"1 - {_CLIP.format(_G15)}", _FIRST, _TURN, "w"))(_standard("libero"))
query("op_std_zxy_edan", _sql([*_POSE[:3], *angles(R)], f"1 - {_G8}", [], _CLIP.format(f"1 - {_G15}"), _FIRST, _ZXY, "w"))(_standard("dlr_edan_shared_control"))
query("op_std_relative_jaco", _sql(["-e2", "e1", "e3", *angles(_S)], _CLIP.format(f"{_G8} * 4.33::double"), [], _ABSOLUTE, "'say it'", _axes((0, -1, 0, 1, 0, 0, 0, 0, 1)), "w"))(_standard("jaco_play"))
query("op_std_relabel_bridge", _sql(_POSE, _G8, _NEXT, _fill(_G15, 0.95), _FIRST, _LATER, "w", step=False) + " where c0 is not null")(_standard("bridge_orig"))
query("op_std_drop_first_bridge", _sql(_POSE, _CLIP.format(_G8), [], _fill(_G15, 0.95), _FIRST, _LATER, "w"))(_standard("bridge_v2_oxe"))
query("op_std_zeros_ucsd", _sql(_POSE, _G8, [*_ACT[:3], "0.0::double", "0.0::double", "0.0::double"], _G15, _FIRST, step=False))(_standard("ucsd_pick_place"))


def _cell(source: str, index: int) -> str:
    if source == "gripper_closedness_action":
        return "(e16 * 10)"
    k, lifted = FIELDS[source][index]
    return f"(e{k} * 4 + 0.5)" if lifted else f"e{k}"


def _taken(part: tuple) -> list[str]:
    kind, source, start, n = part
    if kind == "zeros":
        return ["0.0::double"] * n
    size = len(FIELDS[source])
    start = start if start >= 0 else size + start
    return [_cell(source, k) for k in range(start, start + n if n > 0 else size + n)]


def _gripper_sql(recipe: tuple) -> str:
    if not recipe:
        return "null::double"
    source, index, *steps = recipe
    v = {"zeros": "0.0::double", "ones": "1.0::double"}.get(source) or _cell(source, index)
    for s in steps:
        if s == "clip":
            v = _CLIP.format(v)
        elif s == "invert":
            v = f"(1 - {v})"
        elif s == "absolute":
            v = f"({_ABSOLUTE.replace('e16 * 10', v)})"
        elif s[0] == "fill":
            v = _fill(v, s[1])
        else:
            v = f"({v} {'*' if s[0] == 'scale' else '+'} {s[1]!r}::double)"
    return v


def _spec_sql(spec: standardize.Spec) -> str:
    """SQL for a spec of taken numbers and at most one quaternion, axis angle or zxy turn in its pose."""
    pose, ctes, source = [], "", "poses"
    for part in spec.pose:
        kind, field, start, n = part
        if kind in ("take", "zeros"):
            pose += _taken(part)
            continue
        cells = [X(_cell(field, start + k)) for k in range(n)]
        source = "w"
        if kind == "quaternion":
            unit = X("sqrt(" + " + ".join(f"{c} * {c}" for c in cells) + ")")
            ctes = f"{stage('poses', 'q', q=[c / unit for c in cells])}, {stage('q', 'w', r=_turned(named(range(4), 'q')))}"
        else:
            ctes = _TURN if kind == "axis_angle" else _ZXY
        pose += [angles(R)[0], "asin(-r6)", angles(R)[2]] if kind == "axis_angle" else list(map(str, angles(R)))
    if spec.drop_first:
        ctes, source = _LATER, "w"
    own = [] if not spec.command else ["command"]
    act = [] if spec.action == "pose" else _taken(("take", "action", 0, 0)) if spec.action == "raw" else [c for p in spec.action_parts for c in _taken(p)]
    extra = [c for p in spec.language_parts for c in _taken(p)]
    cells = [*(f"{c} as e{k + 1}" for k, c in enumerate(pose)), f"{_gripper_sql(spec.grip)} as grip", f"{_gripper_sql(spec.command)} as command"]
    cells += [*(f"{c} as c{k}" for k, c in enumerate(act)), *(f"{c} as x{k}" for k, c in enumerate(extra))]
    cells.append(("'say it'" if spec.instruction.startswith("natural") else _FIRST) + " as said")
    made = f"z as (select episode_id, t, {', '.join(cells)} from {source})"
    turns = f"{stage('n', 'm2', r=fixed_axes(E[4], E[5], E[6]))}, {stage('m2', 'o2', s=fixed_axes(X('n4'), X('n5'), X('n6')))}, {stage('o2', 'd', d=product(flipped(R), named(range(9), 's')))}"
    moves = [f"coalesce({x}, 0)" for x in [*[X(f"n{k}") - E[k] for k in (1, 2, 3)], *angles(named(range(9), "d"))]]
    first7 = lambda values: [*values, *["null::double"] * 7][:7]
    state = first7([*(f"e{k + 1}" for k in range(len(pose))), *(["grip"] if spec.grip else [])])
    action = first7([*(f"c{k}" for k in range(len(act))), *([] if spec.action == "raw" else own)] if act else [*(f"e{k}" for k in range(1, 7)), *own])
    said = first7([*(f"x{k}" for k in range(len(extra))), *own] if extra else [*moves, *own] if spec.step else [])
    names = [f"{a}{k}" for a in "sal" for k in range(7)]
    return f"with {_RAW}, {ctes + ', ' if ctes else ''}{made}, {_AFTER.format(src='z')}, {turns} select t, {shown([*state, *action, *said], names)}, said from d"


def _expressible(spec: standardize.Spec) -> bool:
    kinds = {k for k, *_ in spec.pose} | {k for k, *_ in spec.action_parts}
    turns = {k for k, *_ in spec.action_parts} - {"take", "zeros"}
    read = [s for _, s, *_ in (*spec.pose, *spec.action_parts)] + [r[0] for r in (spec.grip, spec.command) if r]
    known = set(FIELDS) | {"gripper_closedness_action", "zeros", "ones", ""}
    for kind, source, start, n in (*spec.pose, *spec.action_parts, *spec.language_parts):
        size = len(FIELDS.get(source, ()))
        if kind == "take" and not 0 <= (start if start >= 0 else size + start) <= (start if start >= 0 else size + start) + max(n, 0) <= size:
            return False
    return not (spec.axes or spec.relabel or spec.fallback or turns) and kinds <= {"take", "zeros", "quaternion", "axis_angle", "zxy"} and set(read) <= known


for _name, _spec in standardize.SPECS.items():
    if _expressible(_spec):
        query(f"op_std_{_name}", _spec_sql(_spec))(_standard(_name))


@query("op_std_registry", "select name, spec from (values " + ", ".join(f"('{n}', '{standardize.spec_of(n)}')" for names in standardize.DATASETS.values() for n in names) + ") v(name, spec)")
def registry(spark, sf):
    rows = [(n, standardize.spec_of(n)) for names in standardize.DATASETS.values() for n in names]
    return spark.createDataFrame(rows, "name string, spec string")


@query("op_s5_reasoning_steps", "select conv_id::varchar as episode, turn::int as step, role as task, 3::int as n_steps from conversations where conv_id % 5 <> 0")
def s5(spark, sf):
    rows = read(spark, sf, "conversations")
    key = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("x"), F.col("turn").cast("string"))).otherwise(F.col("turn").cast("string"))
    steps = F.map_from_entries(F.collect_list(F.struct(key.alias("k"), F.struct(F.col("role").alias("task")).alias("v"))))
    lines = rows.groupBy("conv_id").agg(steps.alias("reasoning")).select(F.to_json(F.create_map(F.lit("file"), F.create_map(F.col("conv_id").cast("string"), F.struct(F.struct(F.lit(3).alias("n_steps")).alias("metadata"), F.col("reasoning").alias("reasoning"))))).alias("value"))
    return readers.reasoning_steps(lines).select("episode", "step", "task", "n_steps")


@query("op_s8_numbered_files", "select doc_id::int as number, 'data/episode' || doc_id || '.hdf5' as path from documents")
def s8(spark, sf):
    files = read(spark, sf, "documents").select(F.concat(F.lit("data/episode"), F.col("doc_id").cast("string"), F.lit(".hdf5")).alias("path"))
    return readers.numbered_files(files)


@query("op_s10_state_kind", "select vec_id, case when label % 2 = 0 then 14 else 12 end::int as width from embeddings")
def s10(spark, sf):
    joint, ends = F.slice("embedding", 1, 14), F.concat(F.slice("embedding", 1, 6), F.slice("embedding", 7, 6))
    return read(spark, sf, "embeddings").select("vec_id", F.size(F.when(F.col("label") % 2 == 0, joint).otherwise(ends)).alias("width"))


@query("op_s11_chosen_instruction", "select conv_id, turn, coalesce(nullif(trim(case when turn % 2 = 0 then '' else text end), ''), nullif(trim(role), '')) as said from conversations")
def s11(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", readers.chosen_instruction(F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("text")), F.col("role")).alias("said"))


@query("op_s12_path_parts", "select page_id, string_split(split_part(split_part(url, '?', 1), '#', 1), '/')[-2] as folder from pages")
def s12(spark, sf):
    path = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return read(spark, sf, "pages").select("page_id", readers.path_parts(path, ["folder", "name"])[0])


@query("op_s13_validity", "select doc_id, case when not length(text) >= 100 then 'too short' when not lang in ('en', 'fr') then 'language' when not n_chars < 5000 then 'too long' end as reason from documents")
def s13(spark, sf):
    checks = [("too short", F.length("text") >= 100), ("language", F.col("lang").isin("en", "fr")), ("too long", F.col("n_chars") < 5000)]
    return read(spark, sf, "documents").select("doc_id", readers.validity(checks).alias("reason"))


@query("op_s15_synthetic_episode", "select t, case when t between 40 and 49 or t between 60 and 149 then 1.0::double else 0.0::double end as g, round(least(greatest(t - 70, 0), 40) * 0.01::double, 6) as x from range(0, 200) r(t)")
def s15(spark, sf):
    return readers.synthetic_episode(spark).select("t", "g", F.round("x", 6).alias("x"))


@query("op_s17_two_roots", "select c_custkey as uuid, 'customer' as source, c_mktsegment as task from customer union all select s_suppkey, 'supplier', null from supplier")
def s17(spark, sf):
    a = read(spark, sf, "customer").select(F.col("c_custkey").alias("uuid"), F.lit("customer").alias("source"), F.col("c_mktsegment").alias("task"))
    return a.unionByName(read(spark, sf, "supplier").select(F.col("s_suppkey").alias("uuid"), F.lit("supplier").alias("source")), allowMissingColumns=True)


@query("op_s18_whitelist", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def s18(spark, sf):
    allowed = read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf, "orders").join(allowed, "o_custkey", "left_semi").select("o_orderkey")


@query("op_s19_hint_sections", "select conv_id, turn, trim(text) as hint from conversations where length(trim(text)) > 0")
def s19(spark, sf):
    text = F.concat(F.lit("# Title\n\n## other\n<replace with your hint>\n## hint\n"), F.col("text"))
    return read(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.map_values(readers.hint_sections(text))).alias("hint"))


@query("op_s20_video_frames", "select event_id, (round_even(value * 5, 0) + event_id % 7)::bigint as frame from events")
def s20(spark, sf):
    return read(spark, sf, "events").select("event_id", readers.video_frame(F.col("value"), F.col("event_id") % 7, 5.0).alias("frame"))


@query("op_p1_standard_record", "select event_id, user_id as id, event_type as instruction, round(value, 6) as state0, false as is_vqa from events")
def p1(spark, sf):
    record = F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("instruction"), F.array(F.round("value", 6)).alias("state"), F.lit(False).alias("is_vqa"))
    return read(spark, sf, "events").select("event_id", record.alias("r")).select("event_id", "r.id", "r.instruction", F.get("r.state", F.lit(0)).alias("state0"), "r.is_vqa")


@query("op_p2_vqa_record", "select item_id, length(text)::int as n, 7::int as action_width, 0.0::double as action_sum, true as is_vqa from benchmark")
def p2(spark, sf):
    zeros = F.array_repeat(F.lit(0.0), 7)
    return read(spark, sf, "benchmark").select("item_id", F.length("text").alias("n"), F.size(zeros).alias("action_width"), vec.total(zeros).alias("action_sum"), F.lit(True).alias("is_vqa"))


@query("op_p3_observation", "select vec_id, 8::int as width, coalesce(null, '') as image from embeddings")
def p3(spark, sf):
    e = F.transform("embedding", lambda x: x.cast("double"))
    state = vec.joined(F.slice(e, 1, 6), F.lit(None).cast("array<double>"), F.slice(e, 7, 2))
    return read(spark, sf, "embeddings").select("vec_id", F.size(state).alias("width"), F.coalesce(F.lit(None).cast("string"), F.lit("")).alias("image"))


@query("op_p9_repack_fallback", "select doc_id, coalesce(l.quality, d.n_chars) as value from documents d left join labels l using (doc_id)")
def p9(spark, sf):
    rows = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.col("quality").cast("bigint"), "n_chars").alias("value"))


@query("op_p16_camera_slots", "select doc_id, lang = 'en' as has_base, lang in ('en', 'fr') as has_wrist from documents")
def p16(spark, sf):
    slots = F.create_map(F.lit("base"), F.when(F.col("lang") == "en", "x"), F.lit("wrist"), F.when(F.col("lang").isin("en", "fr"), "x"))
    return read(spark, sf, "documents").select("doc_id", slots.alias("m")).select("doc_id", F.col("m")["base"].isNotNull().alias("has_base"), F.col("m")["wrist"].isNotNull().alias("has_wrist"))


@query("op_p18_config_lookup", "select s_name, case when contains(s_name, '1') then 'one' when contains(s_name, '2') then 'two' end as config from supplier")
def p18(spark, sf):
    patterns = spark.createDataFrame([("1", 1), ("2", 2)], "s string, p int")
    found = joins.first_containing(read(spark, sf, "supplier").select("s_name"), patterns, "s_name", "s", "p")
    return found.select("s_name", F.when(F.col("matched") == "1", "one").when(F.col("matched") == "2", "two").alias("config"))


@query("op_p19_fixed_ids", "select lang, id::int as id from (values ('de', 1), ('en', 2), ('es', 3), ('fr', 4)) v(lang, id)")
def p19(spark, sf):
    langs = read(spark, sf, "documents").select("lang").distinct()
    ids = spark.createDataFrame([("de", 1), ("en", 2), ("es", 3), ("fr", 4)], "lang string, id int")
    return joins.lookup(langs, ids, "lang", "id", 0)


@query("op_p21_slot_routing", "select event_id, case when event_type = 'click' then value else -value end + 0.0 as chosen from events")
def p21(spark, sf):
    return read(spark, sf, "events").select("event_id", (F.when(F.col("event_type") == "click", F.col("value")).otherwise(-F.col("value")) + F.lit(0.0)).alias("chosen"))


@query("op_p22_sample_routing", "select conv_id, turn, case when role = 'system' then 'vqa' when turn % 2 = 1 then 'prediction' else 'robot' end as route from conversations")
def p22(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "system", "vqa").when(F.col("turn") % 2 == 1, "prediction").otherwise("robot").alias("route"))


@query("op_k5_json_lines", "select event_id, (props::json ->> 'k')::int as k from events")
def k5(spark, sf):
    rows = read(spark, sf, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    line = F.to_json(F.struct("event_id", F.col("p.k").alias("k")))
    return rows.select(F.from_json(line, "event_id bigint, k int").alias("r")).select("r.event_id", "r.k")


@query("op_ext_tumbling_windows", "select time_bucket(interval '1 hour', ts) as start, time_bucket(interval '1 hour', ts) + interval '1 hour' as \"end\", event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2, 3")
def tumbling(spark, sf):
    return stream.tumbling(read(spark, sf, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query("op_ext_sessions", """with g as (select *, case when ts - lag(ts) over w < interval '6 hours' then 0 else 1 end as o from events window w as (partition by user_id order by ts)),
  s as (select *, sum(o) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from g)
  select user_id, min(ts) as start, max(ts) + interval '6 hours' as "end", count(*) as n from s group by user_id, k""")
def sessions(spark, sf):
    return stream.sessions(read(spark, sf, "events"), "6 hours")
