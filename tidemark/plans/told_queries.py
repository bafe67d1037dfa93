"""Texts told about episodes: cascades by task family, question pairs, repaired replies, rules over phases. The SQL is written out by hand."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.functions.motion_text import Move
from tidemark.operators import audit, box_questions, cascade, phase_audit, question_pairs, standardize, stats
from tidemark.plans.registry import EP, POSES, poses, query
from tidemark.plans.registry import table as read
from tidemark.plans.text_queries import _BOX, _CM, _CORNERS, _DIR, _GRIP, _LOC, _MOVES, _VERBOSE, _XY, _boxes, _cm, _moves

_CASCADE_SQL = """with c as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as k, conv_id || ':' || turn as key,
    ['pick_place_primitive', 'arrange_blocks_line_v2', 'stack_blocks_n_stack_n_v1_open', 'arrange_blocks_u_shape', 'other'][conv_id % 5 + 1] as dataset,
    case when conv_id % 6 > 0 then 'Task ' || conv_id end as task, 'cube ' || conv_id % 7 as descriptor, ['red', 'blue'][conv_id % 2 + 1] as color, 'at spot ' || conv_id % 3 as place,
    ['approach', 'grasp', 'transport', 'lift_down', 'rest'][turn % 5 + 1] as kind, coalesce(['left', 'right', null][turn % 3 + 1], 'left') as arm,
    case when turn % 4 > 0 then ' ' || role || ' part ' || turn % 2 || case when turn % 3 = 0 then '.' else '' end end as sub,
    case when turn % 3 = 1 then ['r1 ' || turn, 'r2 ' || turn] else [] end as reasons, case when turn % 2 = 0 then ['p ' || turn, 'q', 'z'] else [] end as prompts,
    case when turn % 2 = 1 then 'x [Subgoal] do ' || turn || '. . [Step] go' else 'plain' end as told from conversations where conv_id is not null and turn is not null and role is not null),
  named as (select conv_id, trim(sub) as s, min(k) as first from c where sub is not null group by 1, 2),
  plans as (select conv_id, string_agg(case when ends_with(s, '.') then s else s || '.' end, ' ' order by first) as plan from named group by 1),
  f as (select c.*, p.plan, case when dataset = 'pick_place_primitive' then 'pick_place' when dataset in ('arrange_blocks_line_v2', 'arrange_blocks_u_shape') then 'arrange' when dataset <> 'other' then 'stack' end as family,
    'Pick up ' || descriptor || ' and place it ' || place || '.' as picked from c left join plans p using (conv_id)),
  s as (select *, case when family is null then [] when len(reasons) > 0 then reasons when family = 'pick_place' then case
      when kind = 'grasp' then ['The gripper must close on the ' || color || ' cube without slipping the cube, so it lowers and grips firmly.',
        'Now that the ' || arm || ' gripper is positioned over the ' || color || ' cube, lowering and closing the fingers secures the grasp.',
        'Grasping the ' || color || ' cube requires controlled descent followed by finger closure to avoid kicking the cube.',
        'The ' || color || ' cube is centered under the ' || arm || ' gripper, so closing the fingers now picks it up cleanly.']
      when kind = 'transport' then ['The ' || color || ' cube is now in hand and needs to reach ' || place || ', so the ' || arm || ' arm carries it through the air.',
        'Because the ' || color || ' cube is grasped, the ' || arm || ' arm transports it horizontally toward ' || place || '.',
        'The cube has to clear the table before placing, so the ' || arm || ' arm lifts and travels above the workspace toward ' || place || '.',
        'Transporting the ' || color || ' cube to ' || place || ' requires a smooth airborne trajectory to avoid disturbing other blocks.']
      when kind = 'lift_down' then ['The ' || arm || ' arm has arrived above ' || place || ', so lowering and releasing places the ' || color || ' cube in position.',
        'Now that the ' || color || ' cube is over ' || place || ', opening the ' || arm || ' gripper drops it precisely.',
        'Placing the ' || color || ' cube at ' || place || ' requires lowering carefully and then releasing it to set it down.',
        'The transport phase ended above ' || place || ', so lowering and releasing finishes the placement of the ' || color || ' cube.']
      else ['The ' || color || ' cube is the pick target named in the task, so the ' || arm || ' arm must position above it before grasping.',
        'Because the ' || color || ' cube is the only valid pick, the ' || arm || ' arm hovers over it to set up the grasp.',
        'The task specifies the ' || color || ' cube as the pick target, and a clean approach from above is needed before closing the gripper.',
        'Approaching the ' || color || ' cube from above gives the ' || arm || ' gripper room to descend without bumping the cube sideways.'] end
      when family = 'arrange' and turn % 2 = 1 then ['do ' || turn] else [coalesce(sub, '')] end as stages,
    case when len(prompts) > 0 then prompts when family = 'pick_place' then ['Move the ' || arm || ' gripper to manipulate the cube.'] else [coalesce(task, '')] end as actions from f)
  select conv_id, turn, family, case when family = 'pick_place' then picked when family is not null then coalesce(task, '') end as task_prompt,
    case when family = 'pick_place' then picked when family is not null then coalesce(plan, task, '') end as plan,
    stages[('0x' || md5('cascade-stage' || key)[1:8])::bigint % greatest(len(stages), 1) + 1] as stage,
    case when family is not null then actions[('0x' || md5('cascade-action' || key)[1:8])::bigint % len(actions) + 1] end as action from s"""


@query("op_x31_task_families", _CASCADE_SQL)
def x31_families(spark, sf):
    """Conversations as episodes, their turns as phases."""
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), (n % len(names)).cast("int"))
    turn, conv = F.col("turn"), F.col("conv_id")
    named = F.when(turn % 4 > 0, F.concat(F.lit(" "), F.col("role"), F.lit(" part "), (turn % 2).cast("string"), F.when(turn % 3 == 0, ".").otherwise("")))
    number = turn.cast("string")
    phase = F.struct(
        pick(["approach", "grasp", "transport", "lift_down", "rest"], turn).alias("kind"), pick(["left", "right", None], turn).alias("arm_tag"), named.alias("subgoal_prompt"),
        F.when(turn % 3 == 1, F.array(F.concat(F.lit("r1 "), number), F.concat(F.lit("r2 "), number))).alias("subgoal_reasoning"),
        F.when(turn % 2 == 0, F.array(F.concat(F.lit("p "), number), F.lit("q"), F.lit("z"))).otherwise(F.array().cast("array<string>")).alias("phase_prompts"),
    )
    told = F.when(turn % 2 == 1, F.concat(F.lit("x [Subgoal] do "), number, F.lit(". . [Step] go"))).otherwise("plain")
    rows = read(spark, sf, "conversations").where("conv_id is not null and turn is not null and role is not null")
    phases = F.array_sort(F.collect_list(F.struct("turn", phase.alias("p"), told.alias("told"))))
    episodes = rows.groupBy("conv_id").agg(phases.alias("s")).select("conv_id", "s", F.col("s.p").alias("phases"), F.col("s.told").alias("told"))
    each = episodes.select("*", F.posexplode("s").alias("k", "one"))
    meta = {
        "dataset": pick(["pick_place_primitive", "arrange_blocks_line_v2", "stack_blocks_n_stack_n_v1_open", "arrange_blocks_u_shape", "other"], conv),
        "task_prompt": F.when(conv % 6 > 0, F.concat(F.lit("Task "), conv.cast("string"))), "phases": F.col("phases"), "told": F.col("told"),
        "descriptor": F.concat(F.lit("cube "), (conv % 7).cast("string")), "color": pick(["red", "blue"], conv), "place": F.concat(F.lit("at spot "), (conv % 3).cast("string")),
    }
    key = F.concat(conv.cast("string"), F.lit(":"), F.col("one.turn").cast("string"))
    return each.select("conv_id", F.col("one.turn").alias("turn"), cascade.texts(meta, F.col("one.p"), F.col("k"), key).alias("t")).select("conv_id", "turn", "t.*")


def _draw(salt: str) -> str:
    return f"('0x' || md5('{salt}' || vec_id)[1:8])::bigint"


_FLAT = f"concat_ws(', ', {_cm('dx', 'forward', 'back')}, {_cm('dz', 'up', 'down')}, {_cm('dy', 'left', 'right')}, {_GRIP})"
_QA_SQL = f"""with {_MOVES}, m as (select *, coalesce(lag(grip) over (partition by episode_id order by t), 0.5) as before, {_draw('qa-kind')} / 4294967296.0::double as uk, {_draw('qa-style')} / 4294967296.0::double as us,
    {_draw('qa-prompt')} as np, {_draw('qa-swap')} / 4294967296.0::double < 0.5 as swapped, {_FLAT} as action, case when vec_id % 2 = 0 then ' (in robot base frame)' else '' end as ref from mv),
  k as (select *, case when uk < 0.4 then 'delta_motion' when uk < 0.5 then 'task_prediction' when uk < 0.6 then 'direction_classification' when uk < 0.7 then 'gripper_prediction'
    when uk < 0.8 then 'magnitude_estimation' when uk < 0.9 then 'temporal_ordering' else 'embodiment_identification' end as kind from m),
  l as (select *, case kind
    when 'delta_motion' then ['Describe the robot''s motion between these two frames' || ref, 'What movement did the robot make from the first image to the second' || ref || '?',
      'Predict the change in robot position shown in these images' || ref, 'Given these before and after images, what action was taken' || ref || '?',
      'Analyze the visual difference and describe the robot''s movement' || ref, 'What is the delta motion between these two images' || ref || '?',
      'Describe how the robot end-effector moved between frames' || ref, 'What movement occurred between these two observations' || ref || '?',
      'Characterize the robot motion from the image pair' || ref, 'From image 1 to image 2, describe the robot''s action' || ref]
    when 'task_prediction' then ['What task is the robot performing given this motion: ' || action || '?', 'Based on the action ''' || action || ''', what is the robot trying to accomplish?',
      'Given the robot moved as follows: ' || action || ', what is the task?', 'Identify the task from this robot motion: ' || action,
      'The robot performed: ' || action || '. What task does this correspond to?', 'What goal is the robot working towards with this action: ' || action || '?']
    when 'direction_classification' then ['What is the dominant motion direction shown in these images?', 'In which direction(s) did the robot primarily move?',
      'Classify the main movement direction between these frames', 'What are the primary motion axes in this image pair?', 'Describe the dominant direction of robot movement']
    when 'gripper_prediction' then ['Did the gripper open, close, or stay the same between these images?', 'What happened to the gripper state?',
      'Predict the gripper state change from image 1 to image 2', 'How did the gripper position change?', 'Was there a gripper action between these frames?']
    when 'magnitude_estimation' then ['How much did the robot move between these images?', 'Estimate the magnitude of the robot''s motion',
      'Is the movement between these frames small, moderate, or large?', 'Characterize the distance traveled by the robot', 'What is the scale of the robot''s displacement?']
    when 'temporal_ordering' then ['Given the robot action ''' || action || ''', which image shows the earlier state - the first or second image?',
      'The robot performed: ' || action || '. In what order do these images appear in the trajectory?', 'Between these frames the robot did: ' || action || '. Which frame came first chronologically?',
      'Given the motion ''' || action || ''', determine the temporal order of these two observations', 'The robot moved as follows: ' || action || '. Is image 1 before or after image 2 in the sequence?']
    else ['What robot or dataset is this image from?', 'Identify the robot embodiment shown in this image', 'What type of robot is performing this task?',
      'Which dataset does this observation come from?', 'Classify the robot platform shown here'] end as prompts from k)
  select vec_id, kind, prompts[np % len(prompts) + 1] as prompt, case kind
    when 'delta_motion' then case when us < 0.5 then action when us < 0.8 then {_VERBOSE} else {_CM} end
    when 'task_prediction' then 'task ' || episode_id
    when 'direction_classification' then coalesce(nullif(concat_ws(' and ', case when dx > 1 then 'forward' when dx < -1 then 'backward' end, case when dy > 1 then 'left' when dy < -1 then 'right' end, case when dz > 1 then 'up' when dz < -1 then 'down' end), ''), 'stationary')
    when 'gripper_prediction' then case when grip > 0.5 and before <= 0.5 then 'opened' when grip <= 0.5 and before > 0.5 then 'closed' else 'unchanged' end
    when 'magnitude_estimation' then case when sqrt(dx*dx + dy*dy + dz*dz) < 2 then 'small movement' when sqrt(dx*dx + dy*dy + dz*dz) < 6 then 'moderate movement' else 'large movement' end
    when 'temporal_ordering' then case when swapped then 'second' else 'first' end
    else ['DROID (Franka Panda)', 'Bridge (WidowX)', 'unknown set'][vec_id % 3 + 1] end as answer,
    case when kind = 'temporal_ordering' and swapped then 'after,before,wrist' else 'before,after,wrist' end as images from l"""


@query("op_x19_question_kinds", _QA_SQL)
def x19_kinds(spark, sf):
    before = F.lag("grip").over(Window.partitionBy("episode_id").orderBy("t"))
    rows = _moves(spark, sf).withColumn("before", before)
    move = Move(*[F.col(c) for c in ("dx", "dy", "dz", "grip", "roll", "pitch", "yaw")])
    dataset = F.get(F.array(F.lit("droid_x"), F.lit("my_Bridge_set"), F.lit("unknown set")), (F.col("vec_id") % 3).cast("int"))
    kinds = [("delta_motion", 0.4), *[(k, 0.1) for k in ("task_prediction", "direction_classification", "gripper_prediction", "magnitude_estimation", "temporal_ordering", "embodiment_identification")]]
    said = question_pairs.question(
        F.col("vec_id"), move, F.col("before"), F.concat(F.lit("task "), F.col("episode_id").cast("string")), dataset, F.array(F.lit("before"), F.lit("after"), F.lit("wrist")),
        F.when(F.col("vec_id") % 2 == 0, "robot base frame").otherwise(""), kinds, [("verbose", 0.5), ("verbose_with_rotation", 0.3), ("compact", 0.2)],
    )
    return rows.select("vec_id", said.alias("q")).select("vec_id", "q.kind", "q.prompt", "q.answer", F.array_join("q.images", ",").alias("images"))


@query("op_x27_cut_replies", """with b as (select doc_id, 3 + doc_id % 5 as m from documents where doc_id is not null),
  t as (select doc_id, '{"plan":"go, {then} stop","frames":[' || string_agg('{"t":' || k || ',"s":"x' || k || '"}', ',' order by k) || ']}' as body from b, range(8) r(k) where k < m group by 1),
  c as (select doc_id, body[1:40 + (doc_id * 7) % (length(body) - 39)] as cut from t),
  f as (select doc_id, cut, regexp_extract_all(cut, '\\{"t":[0-9]+,"s":"x[0-9]"') as said, regexp_extract_all(cut, '\\{"t":[0-9]+,') as timed, len(regexp_extract_all(cut[37:], '\\{'))::bigint as opened from c)
  select doc_id, opened as frames, len(timed)::bigint as timed, len(said)::bigint as told, coalesce(list_sum(list_transform(timed, lambda x: regexp_extract(x, '[0-9]+')::bigint)), 0)::bigint as total from f""".replace("\\\\", "\\"))
def x27_cut(spark, sf):
    """A reply for each document, cut somewhere inside its list of frames."""
    rows = read(spark, sf, "documents").where("doc_id is not null").select("doc_id")
    number = lambda k: k.cast("string")
    frame = lambda k: F.concat(F.lit('{"t":'), number(k), F.lit(',"s":"x'), number(k), F.lit('"}'))
    listed = F.transform(F.sequence(F.lit(0), (F.lit(2) + F.col("doc_id") % 5).cast("int")), frame)
    body = F.concat(F.lit('{"plan":"go, {then} stop","frames":['), F.array_join(listed, ","), F.lit("]}"))
    cut = rows.withColumn("body", body).withColumn("cut", F.substr("body", F.lit(1), (F.lit(40) + F.col("doc_id") * 7 % (F.length("body") - 39)).cast("int")))
    reply = F.concat(F.lit("Here is the plan: "), F.col("cut"))
    told = cut.select("doc_id", F.from_json(audit.repaired(reply), "plan string, frames array<struct<t bigint, s string>>").alias("j"))
    known = lambda f: F.filter("j.frames", lambda x: x[f].isNotNull())
    total = F.aggregate("j.frames", F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x["t"], F.lit(0)))
    return told.select("doc_id", F.size("j.frames").cast("bigint").alias("frames"), F.size(known("t")).cast("bigint").alias("timed"), F.size(known("s")).cast("bigint").alias("told"), total.alias("total"))


_PHASES_SQL = r"""p as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as k, turn, case when turn = 0 then 'begin' when (turn + conv_id) % 7 = 5 then ' end ' when turn % 5 = 4 then '' else 'move' end as type,
    case when (turn + conv_id) % 4 = 1 then 'it will lift it' when (turn + conv_id) % 11 = 3 then ' ' else 'now still' end as s, case when (turn + conv_id) % 3 = 0 then null when (turn + conv_id) % 3 = 1 then 'moved 5 cm up' else 'is about to go 3 cm' end as sp,
    case when turn = 0 and conv_id % 2 = 0 then '' when (turn + conv_id) % 5 = 2 then '<think>plan</think> go 5 cm' when (turn + conv_id) % 5 = 3 then null else 'go 3 cm' end as a,
    case when (turn + conv_id) % 3 = 2 then '<think>fix</think>' end as fix, case when (turn + conv_id) % 4 = 0 then null else (turn * 3 + conv_id) % 2 = 0 end as ok,
    turn * 20 as frame, case when (turn + conv_id) % 6 = 1 then null else turn * 20 + (turn * 17 + conv_id) % 75 end as chunk from conversations where conv_id is not null and turn is not null)"""


@query("op_x29_phase_rules", rf"""with {_PHASES_SQL}, x as (select *, trim(type) not in ('begin', 'end') as acts, coalesce(ok = false, false) as failed, coalesce(a, '') as an, coalesce(sp, '') as spn from p),
  y as (select *, acts and count_if(acts) over (partition by conv_id order by k) = 1 as first_act, last_value(case when acts then ok end ignore nulls) over (partition by conv_id order by k rows between unbounded preceding and 1 preceding) as before,
    lag(case when chunk > 0 then chunk end) over (partition by conv_id order by k) as last_end from x),
  z as (select *, list_filter([case when trim(type) = '' then 'phase_type=empty' end, case when trim(s) = '' then 's=empty' end, case when acts and trim(spn) = '' then 's_pred=empty' end, case when acts and trim(an) = '' then 'a=empty' end,
    case when s = 'it will lift it' then 'foreshadow-in-s' end, case when not acts and (trim(an) <> '' or trim(spn) <> '' or fix is not null) then 'bracket-acts' end,
    case when acts and (fix is not null) <> failed then 'correction-against-supervision' end, case when acts and failed and contains(an, '<think>') then 'think-on-failure' end,
    case when first_act and not contains(case when failed then coalesce(fix, '') else an end, '<think>') then 'first-move-without-plan' end,
    case when acts and (contains(spn, '5 cm') and contains(an, '5 cm') or contains(spn, '3 cm') and contains(an, '3 cm')) then 'prediction-echoes-action' end,
    case when acts and contains(spn, 'about to') then 'foreshadow-in-s_pred' end], lambda i: i is not null) as issues from y)
  select conv_id, count(*) as n, coalesce(string_agg(case when len(issues) > 0 then array_to_string(list_transform(issues, lambda i: k || ':' || i), ' ') end, ' ' order by k), '') as issues, sum(len(issues)) = 0 as passed,
    coalesce(min(k) filter (where acts and failed), -1)::int as first_diverge, coalesce(count_if(acts and ok and before = false), 0)::bigint as recoveries, coalesce(count_if(last_end > frame), 0)::bigint as overlaps, coalesce(count_if(last_end = frame), 0)::bigint as tiled,
    bool_and(not acts or chunk is null or chunk > frame and chunk <= frame + 60) as bounds_ok from z group by 1""")
def x29_phases(spark, sf):
    """Turns as phases, with texts that break each rule somewhere."""
    turn, both = F.col("turn"), F.col("turn") + F.col("conv_id")
    rows = read(spark, sf, "conversations").where("conv_id is not null and turn is not null").select(
        "conv_id", "turn",
        F.when(turn == 0, "begin").when(both % 7 == 5, " end ").when(turn % 5 == 4, "").otherwise("move").alias("phase_type"),
        F.when(both % 4 == 1, "it will lift it").when(both % 11 == 3, " ").otherwise("now still").alias("s"),
        F.when(both % 3 == 1, "moved 5 cm up").when(both % 3 == 2, "is about to go 3 cm").alias("s_pred"),
        F.when((turn == 0) & (F.col("conv_id") % 2 == 0), "").when(both % 5 == 2, "<think>plan</think> go 5 cm").when(both % 5 != 3, "go 3 cm").alias("a"),
        F.when(both % 3 == 2, "<think>fix</think>").alias("a_correct"),
        F.when(both % 4 != 0, (turn * 3 + F.col("conv_id")) % 2 == 0).alias("imitation_supervised"),
        (turn * 20).cast("bigint").alias("frame_idx"),
        F.when(both % 6 != 1, (turn * 20 + (turn * 17 + F.col("conv_id")) % 75).cast("bigint")).alias("chunk_end_frame"),
    )
    told = phase_audit.audit(rows, "conv_id", "turn")
    return told.withColumn("issues", F.array_join("issues", " "))


@query("op_a24_merged_sketches", "select d as dim, count(*) as n, min(embedding[d]::double) as lo, max(embedding[d]::double) as hi, true as within from embeddings, range(1, 65) r(d) where embedding[d] is not null and isfinite(embedding[d]::double) group by 1")
def a24_sketches(spark, sf):
    """Sketches by label, merged by dimension; ``within``: the true ranks of three quantiles lie within the sketch's bound."""
    rows = read(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("d", "x")).select("label", (F.col("d") + 1).cast("bigint").alias("dim"), F.col("x").cast("double").alias("x"))
    merged = stats.merged_sketches(stats.quantile_sketches(rows, ["dim", "label"], "x"), ["dim"])
    shares = [0.25, 0.5, 0.75]
    found = stats.sketch_quantiles(merged, shares)
    ranks = [F.count_if(F.col("x") <= F.col(f"q{round(100 * s)}")).alias(f"r{k}") for k, s in enumerate(shares)] + [F.count_if(F.col("x") < F.col(f"q{round(100 * s)}")).alias(f"l{k}") for k, s in enumerate(shares)]
    held = rows.join(F.broadcast(found), "dim").groupBy("dim", found["n"], "lo", "hi").agg(*ranks)
    ok = F.lit(True)
    for k, s in enumerate(shares):
        ok = ok & (F.col(f"l{k}") <= (s + 0.033) * F.col("n") + 1) & (F.col(f"r{k}") >= (s - 0.033) * F.col("n") - 1)
    return held.select("dim", "n", "lo", "hi", ok.alias("within"))


_GENERAL = "[" + ", ".join("'" + a.replace("'", "''") + "' || cat || '" + b.replace("'", "''") + "'" for a, b in box_questions.BOX_PROMPTS) + "]"
_TURNS = "[" + ", ".join("'" + a.replace("'", "''") + "' || cat || '" + b.replace("'", "''") + "'" for a, b in box_questions.DIRECTION_PROMPTS) + "]"


@query("op_vqa_boxes", f"""with {_BOX}, {_XY}, c as (select *, 'thing ' || vec_id % 4 as cat, ('0x' || md5('5box' || vec_id)[1:8])::bigint % 59 as k, ('0x' || md5('5turn' || vec_id)[1:8])::bigint % 25 as j, ('0x' || md5('7924direction' || vec_id)[1:8])::bigint / 4294967296.0::double < 0.3 as turned from xy)
  select vec_id, case when k < 32 then ['Pick up the ', 'Grasp the ', 'Move near to the ', 'Navigate to the '][k // 8 + 1] || cat || [', predict where it is in the image.', ', show where it is in the image.', ', locate it in the image.', ', find it in the image.',
    ', predict where it is in the robot base frame.', ', relative to the robot base.', ', with respect to the robot base.', ', looking from the external camera.'][k % 8 + 1] else ({_GENERAL})[k - 31] end as prompt,
  case when turned then 'move ' || {_DIR} else {_LOC} end as caption, ({_TURNS})[j + 1] as asked, 'move ' || {_DIR} as direction from c""")
def vqa_boxes(spark, sf):
    """Boxes with a category: where it is, or which way."""
    corners, category = list(map(F.col, _CORNERS)), F.concat(F.lit("thing "), (F.col("vec_id") % 4).cast("string"))
    prompt, caption = box_questions.box_sample(F.col("vec_id"), category, corners, 5, 0.3)
    asked, direction = box_questions.direction_sample(F.col("vec_id"), category, corners, 5)
    return _boxes(spark, sf).select("vec_id", prompt.alias("prompt"), caption.alias("caption"), asked.alias("asked"), direction.alias("direction"))


@query("op_w28_first_state", rf"""with {POSES}, f as (select episode_id, printf('%.3f', e1 + e2 + e3) as s from poses where t = 0),
  d as (select episode_id, ('0x' || md5('state' || s)[1:8])::bigint % 18 as k from f)
  select vec_id, case when episode_id % 2 = 0 then 'label ' || episode_id else ['Do something useful.', 'Complete the task.', 'Perform the task.', 'Carry out the objective.', 'Execute the current task.', 'Accomplish the goal.',
    'Proceed with the task.', 'Handle the task at hand.', 'Continue the operation.', 'Fulfill the task.', 'Take meaningful steps.', 'Demonstrate useful behavior.', 'Act in a useful manner.', 'Engage in productive actions.',
    'Make useful moves.', 'Undertake useful actions.', 'Behave purposefully.', 'Start the activity.'][k + 1] end as instruction from poses join d using (episode_id)""")
def w28_first_state(spark, sf):
    """A blank instruction is filled by the digest of the episode's first state."""
    rows = poses(spark, sf)
    key = standardize.first_state_text(F.array("e1", "e2", "e3"), EP, 3)
    said = F.when(F.col("episode_id") % 2 == 0, F.concat(F.lit("label "), F.col("episode_id").cast("string"))).otherwise("  ")
    fallback = hashing.choose("state", F.col("key"), F.array(*[F.lit(x) for x in standardize.FALLBACKS]))
    return rows.withColumn("key", key).withColumn("said", said).select("vec_id", F.when(F.length(F.trim("said")) > 0, F.col("said")).otherwise(fallback).alias("instruction"))
