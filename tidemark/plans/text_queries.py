"""Motion as text, boxes as tokens, prompts, token classes, masks and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import boxes, hashing, motion_text
from tidemark.operators import audit, masks
from tidemark.plans.registry import POSES, poses, query
from tidemark.plans.registry import table as read

_MOVES = f"""{POSES}, mv as (select vec_id, episode_id, t, e1 * 30 as dx, e2 * 30 as dy, e3 * 30 as dz, e4 * 100 as roll, e5 * 100 as pitch, e6 * 100 as yaw, e7 + 0.5 as grip from poses)"""


def _moves(spark, sf):
    scale = {"dx": ("e1", 30), "dy": ("e2", 30), "dz": ("e3", 30), "roll": ("e4", 100), "pitch": ("e5", 100), "yaw": ("e6", 100)}
    return poses(spark, sf).select("vec_id", "episode_id", "t", *[(F.col(c) * by).alias(name) for name, (c, by) in scale.items()], (F.col("e7") + 0.5).alias("grip"))


def _move(turns: bool = True) -> motion_text.Move:
    names = ["dx", "dy", "dz", "grip", *(["roll", "pitch", "yaw"] if turns else [])]
    return motion_text.Move(*[F.col(c) for c in names])


_GRIP = "case when grip >= 0.5 then 'open gripper' else 'close gripper' end"


def _pair(v: str, a: str, b: str, size: str = "true") -> str:
    return f"case when {v} > 0 and {size} then {a} when {v} < 0 and {size} then {b} end"


def _cm(v: str, a: str, b: str) -> str:
    s = f"round_even(abs({v}), 0)"
    return _pair(v, f"printf('move {a} %.0f cm', {s})", f"printf('move {b} %.0f cm', {s})", f"{s} <> 0")


def _deg(v: str, a: str, b: str) -> str:
    s = f"(round_even(abs({v}) / 10, 0) * 10)::int"
    return _pair(v, f"'{a} ' || {s} || ' degrees'", f"'{b} ' || {s} || ' degrees'", f"{s} <> 0")


_VERBOSE = f"concat_ws(', ', {_cm('dx', 'forward', 'back')}, {_cm('dz', 'up', 'down')}, {_cm('dy', 'left', 'right')}, {_deg('roll', 'tilt left', 'tilt right')}, {_deg('pitch', 'tilt back', 'tilt forward')}, {_deg('yaw', 'rotate counterclockwise', 'rotate clockwise')}, {_GRIP})"


@query("op_x10_verbose_motion", f"with {_MOVES} select vec_id, {_VERBOSE} as said from mv")
def x10(spark, sf):
    return _moves(spark, sf).select("vec_id", motion_text.verbose(_move()).alias("said"))


def _nn(v: str, a: str, b: str) -> str:
    return _pair(v, f"'move {a}'", f"'move {b}'", f"round_even(abs({v}), 0) <> 0")


@query("op_x10_no_number", f"with {_MOVES} select vec_id, concat_ws(', ', {_nn('dx', 'forward', 'back')}, {_nn('dy', 'left', 'right')}, {_nn('dz', 'up', 'down')}, {_GRIP}) as said from mv")
def x10_words(spark, sf):
    return _moves(spark, sf).select("vec_id", motion_text.without_numbers(_move(False)).alias("said"))


_C3 = "printf('%+03d', round_even(dx, 0)::int), printf('%+03d', round_even(dy, 0)::int), printf('%+03d', round_even(dz, 0)::int)"


@query("op_x11_compact_motion", f"with {_MOVES} select vec_id, '<' || concat_ws(' ', {_C3}, {', '.join(f'''printf('%+03d', (round_even({a} / 5, 0) * 5)::int)''' for a in ('roll', 'pitch', 'yaw'))}, (grip >= 0.5)::int::varchar) || '>' as said from mv")
def x11(spark, sf):
    return _moves(spark, sf).select("vec_id", motion_text.compact(_move()).alias("said"))


_CM = f"'<' || concat_ws(' ', {_C3}, (grip >= 0.5)::int::varchar) || '>'"


@query("op_x12_bimanual", f"with {_MOVES}, c as (select episode_id, t, vec_id, {_CM} as c from mv), z as (select *, lead(c) over (partition by episode_id order by t) as r from c) select vec_id, '<L ' || c[2:-2] || ' R ' || r[2:-2] || '>' as said from z where r is not null")
def x12(spark, sf):
    rows = _moves(spark, sf).withColumn("c", motion_text.compact(_move(False))).withColumn("r", F.lead("c").over(Window.partitionBy("episode_id").orderBy("t")))
    return rows.where("r is not null").select("vec_id", motion_text.bimanual(F.col("c"), F.col("r"), True).alias("said"))


def _word(v: str, a: float, b: float) -> str:
    return f"case when {v} <= {a} then 'slightly' when {v} < {b} then 'moderately' else 'a lot' end"


@query("op_x13_scale_words", f"""with {_MOVES}, s as (select vec_id, unnest(string_split({_VERBOSE}, ', ')) as p, generate_subscripts(string_split({_VERBOSE}, ', '), 1) as i from mv),
  n as (select *, nullif(regexp_extract(p, '([0-9]+) (cm|degrees)$', 1), '')::double as v from s)
  select vec_id, string_agg(case when v is null then p when p like 'move %' then regexp_replace(p, ' [0-9]+ cm$', '') || ' ' || {_word('v', 3, 8)} else regexp_replace(p, ' [0-9]+ degrees$', '') || ' ' || case when v < 10 then 'slightly' when v < 30 then 'moderately' else 'a lot' end end, ', ' order by i) as said from n group by 1""")
def x13(spark, sf):
    return _moves(spark, sf).select("vec_id", motion_text.scale_words(motion_text.verbose(_move())).alias("said"))


def _back(v: str) -> str:
    return f"round(round_even(abs({v}), 0) * sign({v}) / 100, 6) + 0.0"


@query("op_x14_parse_verbose", f"with {_MOVES} select vec_id, {_back('dx')} as dx, {_back('dy')} as dy, {_back('dz')} as dz, round(round_even(abs(roll) / 10, 0) * 10 * sign(roll) * pi() / 180, 6) + 0.0 as roll, round(round_even(abs(pitch) / 10, 0) * 10 * sign(pitch) * pi() / 180, 6) + 0.0 as pitch, round(round_even(abs(yaw) / 10, 0) * 10 * sign(yaw) * pi() / 180, 6) + 0.0 as yaw, (grip >= 0.5)::int::double as gripper from mv")
def x14(spark, sf):
    parsed = _moves(spark, sf).withColumn("p", motion_text.parse_verbose(motion_text.verbose(_move())))
    return parsed.select("vec_id", *[(F.round(F.col(f"p.{c}"), 6) + F.lit(0.0)).alias(c) for c in ("dx", "dy", "dz", "roll", "pitch", "yaw")], "p.gripper")


@query("op_x14_parse_compact", f"with {_MOVES} select vec_id, round_even(dx, 0) / 100 + 0.0 as dx, round_even(dy, 0) / 100 + 0.0 as dy, round_even(dz, 0) / 100 + 0.0 as dz, (grip >= 0.5)::int::double as gripper from mv")
def x14_compact(spark, sf):
    parsed = _moves(spark, sf).withColumn("p", motion_text.parse_compact(motion_text.compact(_move(False))))
    return parsed.select("vec_id", *[(F.col(f"p.{c}") + F.lit(0.0)).alias(c) for c in ("dx", "dy", "dz")], "p.gripper")


_INTS = ", ".join(f"round_even((least(greatest(e{k} * 3, -1), 1) + 1) / 2 * 1000, 0)::int::varchar" for k in range(1, 8))


@query("op_x15_integers", f"with {POSES}, i as (select vec_id, concat_ws(' ', {_INTS}) as said from poses) select vec_id, said, round(string_split(said, ' ')[1]::int / 1000.0::double * 2 - 1, 6) + 0.0 as first_value, 10::int as width from i")
def x15(spark, sf):
    rows = poses(spark, sf).withColumn("said", motion_text.to_integers(F.array(*[F.col(f"e{k}") * 3 for k in range(1, 8)])))
    back = motion_text.from_integers(F.col("said"), 10)
    return rows.withColumn("b", back).select("vec_id", "said", (F.round(F.get("b", F.lit(0)), 6) + F.lit(0.0)).alias("first_value"), F.size("b").alias("width"))


def _q(v: str, words: tuple[str, str], least: float, small: float, large: float) -> str:
    return f"case when abs({v}) >= {least} then case when abs({v}) < {small} then 'slightly ' when abs({v}) < {large} then 'moderately ' else 'significantly ' end || case when {v} > 0 then '{words[0]}' else '{words[1]}' end end"


_T = [_q("dx", ("forward", "backward"), 0.5, 1.5, 5), _q("dy", ("left", "right"), 0.5, 1.5, 5), _q("dz", ("up", "down"), 0.5, 1.5, 5)]
_U = [_q("roll", ("tilt left", "tilt right"), 5, 10, 30), _q("pitch", ("tilt back", "tilt forward"), 5, 10, 30), _q("yaw", ("rotate counterclockwise", "rotate clockwise"), 5, 10, 30)]


@query("op_x16_qualitative", f"with {_MOVES}, p as (select vec_id, {_GRIP} as g, nullif(concat_ws(' and ', {', '.join(_T)}), '') as a, nullif(concat_ws(' and ', {', '.join(_U)}), '') as b from mv) select vec_id, concat_ws(', ', 'move ' || a, b, case when a is null and b is null then g else 'then ' || g end) as said from p")
def x16_qualitative(spark, sf):
    return _moves(spark, sf).select("vec_id", motion_text.qualitative(_move()).alias("said"))


_D1 = {a: f"(round_even({a}, 1) + 0.0)::varchar" for a in ("dx", "dy", "dz", "roll", "pitch", "yaw")}


@query("op_x16_component", f"with {_MOVES} select vec_id, 'translation: (' || concat_ws(', ', {_D1['dx']}, {_D1['dy']}, {_D1['dz']}) || ') cm; gripper: ' || {_GRIP} as said from mv")
def x16_component(spark, sf):
    return _moves(spark, sf).select("vec_id", motion_text.component(_move(False)).alias("said"))


@query("op_x16_json", f"""with {_MOVES} select vec_id, '{{"dx_cm":' || {_D1['dx']} || ',"dy_cm":' || {_D1['dy']} || ',"dz_cm":' || {_D1['dz']} || ',"gripper":"' || {_GRIP} || '"}}' as said from mv""")
def x16_json(spark, sf):
    return _moves(spark, sf).select("vec_id", motion_text.as_json(_move(False)).alias("said"))


_NUM = "['" + "','".join(motion_text.NUMBERS) + "']"


def _by(v: str, a: str, b: str) -> str:
    k = f"round_even(abs({v}), 0)::int"
    return f"case when {k} >= 1 then case when {v} > 0 then '{a}' else '{b}' end || ' by ' || coalesce(({_NUM})[{k} + 1], {k}::varchar) || ' centimeter' || case when {k} = 1 then '' else 's' end end"


@query("op_x16_sentence", f"""with {_MOVES}, l as (select vec_id, grip, list_filter([{_by('dx', 'forward', 'backward')}, {_by('dy', 'left', 'right')}, {_by('dz', 'up', 'down')}], lambda x: x is not null) as p from mv)
  select vec_id, case len(p) when 0 then 'The robot remained stationary' when 1 then 'The robot moved ' || p[1] when 2 then 'The robot moved ' || p[1] || ' and ' || p[2] else 'The robot moved ' || p[1] || ', ' || p[2] || ', and ' || p[3] end
  || case when grip >= 0.5 then ' while opening the gripper.' else ' while closing the gripper.' end as said from l""")
def x16_sentence(spark, sf):
    return _moves(spark, sf).select("vec_id", motion_text.sentence(_move(False)).alias("said"))


def _only(v: str, a: str, b: str) -> str:
    return f"case when abs({v}) >= 0.5 then case when {v} > 0 then '{a}' else '{b}' end end"


_ONLY = f"concat_ws(', ', {_only('dx', 'forward', 'backward')}, {_only('dy', 'left', 'right')}, {_only('dz', 'up', 'down')}, {_GRIP})"


@query("op_x16_direction_only", f"with {_MOVES} select vec_id, {_ONLY} as said from mv")
def x16_direction(spark, sf):
    return _moves(spark, sf).select("vec_id", motion_text.directions_only(_move(False)).alias("said"))


@query("op_x17_format_dispatch", f"with {_MOVES} select vec_id, case vec_id % 3 when 0 then {_CM} when 1 then {_ONLY} end as said from mv")
def x17(spark, sf):
    style = F.get(F.array(F.lit("compact"), F.lit("direction_only"), F.lit("other")), (F.col("vec_id") % 3).cast("int"))
    return _moves(spark, sf).withColumn("style", style).select("vec_id", motion_text.formatted(F.col("style"), _move(False)).alias("said"))


@query("op_x18_summaries", f"""with {_MOVES}, x as (select *, lead(grip) over (partition by episode_id order by t) as g2 from mv)
  select vec_id, coalesce(nullif(concat_ws(' and ', case when dx > 1 then 'forward' when dx < -1 then 'backward' end, case when dy > 1 then 'left' when dy < -1 then 'right' end, case when dz > 1 then 'up' when dz < -1 then 'down' end), ''), 'stationary') as directions,
  case when g2 > 0.5 and grip <= 0.5 then 'opened' when g2 <= 0.5 and grip > 0.5 then 'closed' else 'unchanged' end as gripper,
  case when sqrt(dx*dx + dy*dy + dz*dz) < 2 then 'small movement' when sqrt(dx*dx + dy*dy + dz*dz) < 6 then 'moderate movement' else 'large movement' end as magnitude from x""")
def x18(spark, sf):
    rows = _moves(spark, sf).withColumn("g2", F.lead("grip").over(Window.partitionBy("episode_id").orderBy("t")))
    return rows.select("vec_id", motion_text.dominant_directions(_move(False)).alias("directions"), motion_text.gripper_change(F.col("grip"), F.col("g2")).alias("gripper"), motion_text.magnitude(_move(False)).alias("magnitude"))


@query("op_f10_idle_moves", f"with {_MOVES} select vec_id, sqrt(dx*dx + dy*dy + dz*dz) < 4 and sqrt(roll*roll + pitch*pitch + yaw*yaw) < 15 as idle from mv")
def f10(spark, sf):
    return _moves(spark, sf).select("vec_id", motion_text.is_idle(_move(), 4.0, 15.0).alias("idle"))


_BOX = f"{POSES}, bx as (select vec_id, episode_id, least(greatest(0.4 + e1, 0), 1) as x0, least(greatest(0.4 + e2, 0), 1) as y0, least(greatest(0.6 + e3, 0), 1) as x1, least(greatest(0.6 + e4, 0), 1) as y1 from poses)"


def _boxes(spark, sf):
    held = lambda base, c: F.least(F.greatest(F.lit(base) + F.col(c), F.lit(0.0)), F.lit(1.0))
    return poses(spark, sf).select("vec_id", "episode_id", held(0.4, "e1").alias("x0"), held(0.4, "e2").alias("y0"), held(0.6, "e3").alias("x1"), held(0.6, "e4").alias("y1"))


_CORNERS = ("x0", "y0", "x1", "y1")
_LOC = " || ".join(f"'<loc' || lpad(round_even({c} * 1023, 0)::int::varchar, 4, '0') || '>'" for c in ("y0", "x0", "y1", "x1"))


@query("op_x3_loc_tokens", f"with {_BOX} select vec_id, {_LOC} as tokens from bx")
def x3(spark, sf):
    return _boxes(spark, sf).select("vec_id", boxes.box_tokens(*map(F.col, _CORNERS)).alias("tokens"))


_TURN = " || ".join(f"'<loc' || lpad((1023 - round_even({c} * 1023, 0)::int)::varchar, 4, '0') || '>'" for c in ("y1", "x1", "y0", "x0"))


@query("op_x4_rotate_tokens", f"with {_BOX} select vec_id, {_TURN} as tokens from bx")
def x4(spark, sf):
    return _boxes(spark, sf).select("vec_id", boxes.rotate_tokens(boxes.box_tokens(*map(F.col, _CORNERS))).alias("tokens"))


_DIR = """case when y > 2 * abs(x) then 'forward' when y < -2 * abs(x) then 'back' when x > abs(y) / 2 then 'right' when x < -abs(y) / 2 then 'left'
  else case when x < 0 then 'left' else 'right' end || ' and ' || case when y >= 0 then 'forward' else 'back' end end"""
_XY = "xy as (select *, (x0 + x1) / 2 - 0.5 as x, 0.5 - (y0 + y1) / 2 as y from bx)"


@query("op_x5_box_direction", f"with {_BOX}, {_XY} select vec_id, 'move ' || {_DIR} as direction from xy")
def x5(spark, sf):
    return _boxes(spark, sf).select("vec_id", boxes.direction(*map(F.col, _CORNERS), prefix="move ").alias("direction"))


@query("op_x6_rotate_direction", f"with {_BOX}, {_XY}, d as (select vec_id, {_DIR} as d from xy) select vec_id, array_to_string(list_transform(string_split(d, ' '), lambda w: case w when 'left' then 'right' when 'right' then 'left' when 'forward' then 'back' when 'back' then 'forward' else w end), ' ') as direction from d")
def x6(spark, sf):
    return _boxes(spark, sf).select("vec_id", boxes.rotate_direction(boxes.direction(*map(F.col, _CORNERS))).alias("direction"))


@query("op_x7_box_caption", f"with {_BOX} select episode_id, string_agg({_LOC} || ' obj' || (vec_id % 3), ' ; ' order by vec_id) as caption from bx group by 1")
def x7(spark, sf):
    one = F.struct("vec_id", F.concat(F.lit("obj"), (F.col("vec_id") % 3).cast("string")).alias("label"), boxes.box_tokens(*map(F.col, _CORNERS)).alias("loc"))
    return _boxes(spark, sf).groupBy("episode_id").agg(boxes.caption(F.array_sort(F.collect_list(one))).alias("caption"))


@query("op_x8_point_tokens", f"with {_BOX} select vec_id, '<loc' || lpad(round_even(y0 * 1023, 0)::int::varchar, 4, '0') || '><loc' || lpad(round_even(x0 * 1023, 0)::int::varchar, 4, '0') || '>' as tokens from bx")
def x8(spark, sf):
    return _boxes(spark, sf).select("vec_id", F.concat(boxes.loc_token(F.col("y0")), boxes.loc_token(F.col("x0"))).alias("tokens"))


@query("op_m29_letterbox", f"with {_BOX} select vec_id, round(x0, 6) as x, round(y0 * (126.0::double / 224) + 49.0::double / 224, 6) as y from bx")
def m29(spark, sf):
    x, y = boxes.letterbox(F.col("x0"), F.col("y0"), F.lit(640.0), F.lit(360.0), 224, 224)
    return _boxes(spark, sf).select("vec_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("op_x1_path_extract", r"select page_id, regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '(\.html)?([?#].*)?$', '') as path from pages")
def x1(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]+/", ""), r"(\.html)?([?#].*)?$", "").alias("path"))


@query("op_x2_path_parts", r"select page_id, regexp_extract(url, '^(https?)://', 1) as kind, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) as root, try_cast(regexp_extract(url, '/(\d+)', 1) as int) as number from pages")
def x2(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^(https?)://", 1).alias("kind"), F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/", 1).alias("root"), F.regexp_extract("url", r"/(\d+)", 1).try_cast("int").alias("number"))


@query("op_x9_prompt_choice", "select item_id, (['Where is it?', 'Find it.', 'Point at it.'])[1 + (('0x' || substr(md5('p' || item_id::varchar), 1, 8))::ubigint % 3)::int] as prompt from benchmark")
def x9(spark, sf):
    options = F.array(*[F.lit(p) for p in ("Where is it?", "Find it.", "Point at it.")])
    return read(spark, sf, "benchmark").select("item_id", hashing.choose("p", F.col("item_id"), options).alias("prompt"))


@query("op_x19_question_pairs", "with q as (select *, lead(text) over (partition by conv_id order by turn) as a, lead(role) over (partition by conv_id order by turn) as r from conversations) select conv_id, turn, md5('Q: ' || text || ' A: ' || a) as pair from q where role = 'user' and r = 'assistant'")
def x19(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf, "conversations").withColumn("a", F.lead("text").over(w)).withColumn("r", F.lead("role").over(w)).where("role = 'user' and r = 'assistant'")
    return rows.select("conv_id", "turn", F.md5(F.concat(F.lit("Q: "), F.col("text"), F.lit(" A: "), F.col("a"))).alias("pair"))


@query("op_x20_robot_dispatch", f"with {_MOVES} select vec_id, case when episode_id % 2 = 0 then {_CM} else {_ONLY} end as said from mv")
def x20(spark, sf):
    return _moves(spark, sf).select("vec_id", F.when(F.col("episode_id") % 2 == 0, motion_text.compact(_move(False))).otherwise(motion_text.directions_only(_move(False))).alias("said"))


@query("op_x21_prompt_assembly", f"with {POSES} select vec_id, 'Task: label ' || episode_id || ', State: ' || concat_ws(' ', {', '.join(f'least(floor((e{k} + 1) * 128), 255)::int::varchar' for k in range(1, 5))}) || case when vec_id % 4 = 0 then '' else '; Action: ' end as prompt from poses")
def x21(spark, sf):
    from tidemark.functions import scaling

    bins = F.concat_ws(" ", *[scaling.state_bins(F.col(f"e{k}")).cast("string") for k in range(1, 5)])
    tail = F.when(F.col("vec_id") % 4 == 0, "").otherwise("; Action: ")
    return poses(spark, sf).select("vec_id", F.concat(F.lit("Task: label "), F.col("episode_id").cast("string"), F.lit(", State: "), bins, tail).alias("prompt"))


@query("op_x22_token_classes", f"with {_MOVES}, w as (select vec_id, unnest(string_split({_VERBOSE}, ' ')) as w from mv) select vec_id, count_if(regexp_matches(w, '[0-9]'))::bigint as numbers, count_if(regexp_matches(lower(w), '^(left|right|forward|back|backward|up|down|clockwise|counterclockwise),?$'))::bigint as directions, count(*) as n from w group by 1")
def x22(spark, sf):
    words = _moves(spark, sf).select("vec_id", F.explode(F.split(motion_text.verbose(_move()), " ")).alias("w"))
    return words.groupBy("vec_id").agg(F.count_if(masks.is_number(F.col("w"))).alias("numbers"), F.count_if(masks.is_direction(F.col("w"))).alias("directions"), F.count(F.lit(1)).alias("n"))


@query("op_x23_segment_masks", """with s as (select conv_id, min(text) filter (where role = 'user') as p, min(text) filter (where role = 'assistant') as a from conversations group by 1),
  t as (select conv_id, len(regexp_split_to_array(trim(p), '\\s+')) as np, len(regexp_split_to_array(trim(a), '\\s+')) as na from s where p is not null and a is not null)
  select conv_id, least(np + na + 2, 64)::bigint as length, least(np + 1, 64)::bigint as prompt_tokens, greatest(least(np + na + 2, 64) - np - 1, 0)::bigint as loss_tokens from t""")
def x23(spark, sf):
    rows = read(spark, sf, "conversations").groupBy("conv_id").agg(F.min(F.when(F.col("role") == "user", F.col("text"))).alias("p"), F.min(F.when(F.col("role") == "assistant", F.col("text"))).alias("a"))
    laid = masks.layout(rows.where("p is not null and a is not null"), [("prompt", "p", False), ("action", "a", True)], 64)
    return laid.select("conv_id", "length", F.get("segment_lengths", F.lit(0)).alias("prompt_tokens"), F.aggregate("loss_mask", F.lit(0), lambda s, x: s + x.cast("int")).cast("bigint").alias("loss_tokens"))


@query("op_x26_answer_suffix", "select doc_id, list_last(string_split(text, '.')) as tail from documents")
def x26(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.element_at(F.split("text", r"\."), -1).alias("tail"))


@query("op_x27_fenced_json", """select conv_id, turn, length(text)::bigint as n, turn as parsed_turn from conversations""")
def x27(spark, sf):
    body = F.to_json(F.struct(F.col("turn").alias("turn"), F.length("text").cast("bigint").alias("n")))
    raw = F.concat(F.lit("Sure, here it is:\n```json\n"), body, F.lit("\n```\nAnything else?"))
    rows = read(spark, sf, "conversations").withColumn("j", F.from_json(audit.json_object(raw), "turn bigint, n bigint"))
    return rows.select("conv_id", "turn", "j.n", F.col("j.turn").alias("parsed_turn"))


_KF = """kf as (select conv_id, turn, text as action, case when turn = 0 then 'begin' when role = 'assistant' then 'grasp' else 'motion' end as type, case when length(text) % 2 = 0 then 'open' else 'closed' end as state from conversations)"""


@query("op_x28_audit_rules", rf"""with {_KF}, r as (select *, type = 'grasp' and not regexp_matches(lower(action), '\b(clamp|close|grasp|grip|pick|pinch|squeeze)\b') as a3, length(trim(action)) = 0 as a7, len(regexp_split_to_array(trim(action), '\s+')) > 22 as a5 from kf)
  select conv_id, count_if(a3)::bigint as a3, count_if(a5)::bigint as a5, count_if(a7)::bigint as a7, count_if(a3 or a7) = 0 as passed from r group by 1""")
def x28(spark, sf):
    kind = F.when(F.col("turn") == 0, "begin").when(F.col("role") == "assistant", "grasp").otherwise("motion")
    rows = read(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("action"), kind.alias("type"))
    return audit.keyframe_rules(rows, "conv_id")


#: What each row's text goes on with: all the announcing phrases, and two that announce nothing.
_AHEAD = [f"will {v}" for v in "open close shut lift raise lower grasp grip release let@go move begin start descend rise pull push insert place drop reach swing rotate retract tilt pour tip slide press".replace(" ", ",").replace("@", " ").split(",")]
_AHEAD += ["about to", "is going to", "are  going to", "will sleep", "was going to"]
_AHEAD_SQL = f"([{', '.join(repr(x) for x in _AHEAD)}])[1 + (conv_id % {len(_AHEAD)})::int]"


@query("op_x29_foreshadow", f"with s as (select conv_id, turn, text, {_AHEAD_SQL} as ahead from conversations) select conv_id, turn, ahead not in ('will sleep', 'was going to') as foreshadow from s")
def x29(spark, sf):
    ahead = F.get(F.array(*[F.lit(x) for x in _AHEAD]), (F.col("conv_id") % len(_AHEAD)).cast("int"))
    rows = read(spark, sf, "conversations").withColumn("said", F.concat_ws(" ", "text", ahead))
    return rows.select("conv_id", "turn", audit.foreshadows(F.col("said")).alias("foreshadow"))


@query("op_x30_verbs", r"select doc_id, regexp_matches(lower(text), '\b(the|of)\b') or contains(lower(text), 'the of') as hit from documents")
def x30(spark, sf):
    return read(spark, sf, "documents").select("doc_id", audit.contains_any(F.col("text"), ["the", "of", "the of"]).alias("hit"))


@query("op_x31_cascade_text", f"with {_MOVES} select vec_id, case episode_id % 3 when 0 then '[plan] ' || {_ONLY} when 1 then '[stage] label ' || episode_id || ' [action] ' || {_CM} else {_CM} end as said from mv")
def x31(spark, sf):
    short, only, family = motion_text.compact(_move(False)), motion_text.directions_only(_move(False)), F.col("episode_id") % 3
    stage = F.concat(F.lit("[stage] label "), F.col("episode_id").cast("string"), F.lit(" [action] "), short)
    return _moves(spark, sf).select("vec_id", F.when(family == 0, F.concat(F.lit("[plan] "), only)).when(family == 1, stage).otherwise(short).alias("said"))


@query("op_x32_plan_placement", "with u as (select doc_id, ('0x' || substr(md5('plan' || doc_id::varchar), 1, 8))::ubigint / 4294967296.0::double as u from documents) select doc_id, case when u < 0.2 then 'none' when u < 0.7 then 'prompt' else 'target' end as plan from u")
def x32(spark, sf):
    return read(spark, sf, "documents").select("doc_id", hashing.weighted_choice("plan", F.col("doc_id"), [("none", 0.2), ("prompt", 0.5), ("target", 0.3)]).alias("plan"))


@query("op_x33_top_axes", f"""with {_MOVES}, l as (select vec_id, unnest([{{'n': 'roll', 'v': roll}}, {{'n': 'pitch', 'v': pitch}}, {{'n': 'yaw', 'v': yaw}}]) as a from mv), r as (select vec_id, a.n as n, a.v as v, row_number() over (partition by vec_id order by abs(a.v) desc, a.n) as i from l)
  select vec_id, string_agg(n || ' ' || printf('%+d', round_even(v, 0)::int) || ' deg', ', ' order by i) as said from r where i <= 2 group by 1""")
def x33(spark, sf):
    return _moves(spark, sf).select("vec_id", audit.top_axes([("roll", F.col("roll")), ("pitch", F.col("pitch")), ("yaw", F.col("yaw"))]).alias("said"))


@query("op_x34_directory_names", "select doc_id, 'ep_' || lpad(doc_id::varchar, 6, '0') || '_' || replace(right(lang || '/' || source, 8), '/', '-') as name from documents")
def x34(spark, sf):
    tail = F.replace(F.right(F.concat(F.col("lang"), F.lit("/"), F.col("source")), F.lit(8)), F.lit("/"), F.lit("-"))
    return read(spark, sf, "documents").select("doc_id", F.concat(F.lit("ep_"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit("_"), tail).alias("name"))


@query("op_x35_date_from_path", "select o_orderkey, split_part(strftime(o_orderdate, 'lab/%Y-%m-%d/ep'), '/', 2) as day from orders")
def x35(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", F.split_part(F.date_format("o_orderdate", "'lab/'yyyy-MM-dd'/ep'"), F.lit("/"), F.lit(2)).alias("day"))


@query("op_x36_segment_parse", f"with {_MOVES} select vec_id, 'label ' || episode_id as stage, {_CM} as action from mv")
def x36(spark, sf):
    said = F.concat(F.lit("[stage] label "), F.col("episode_id").cast("string"), F.lit(" [action] "), motion_text.compact(_move(False)))
    part = lambda name: F.trim(F.regexp_extract("said", rf"\[{name}\]\s*([^\[]*)", 1)).alias(name)
    return _moves(spark, sf).withColumn("said", said).select("vec_id", part("stage"), part("action"))


@query("op_x37_nul_split", "select doc_id, lang as said from documents")
def x37(spark, sf):
    raw = F.encode(F.concat(F.col("lang"), F.lit("\x00\x00\x00")), "UTF-8")
    return read(spark, sf, "documents").select("doc_id", F.get(F.split(F.decode(raw, "UTF-8"), "\x00"), F.lit(0)).alias("said"))
