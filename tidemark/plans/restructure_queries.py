"""Trajectories as the common frame record, sharded scans, resumed writes and loops over batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.operators import mixture, questions, restructure, windows
from tidemark.plans.geometry_queries import RPY, R, X, angles, fixed_axes, flipped, named, product, shown, stage
from tidemark.plans.registry import EP, FRAMES, POSES, frames, poses, query, rounded
from tidemark.plans.registry import table as read
from tidemark.sources import readers, sinks
from tidemark.sources.shared import shared_dir

_H = "('0x' || substr(md5('{0}' || {1}::varchar), 1, 8))::ubigint"
TURNS = windows.Episode(("conv_id",), ("turn",))


@query("op_s4_vqa_shard", f"select item_id, text, {_H.format('5', 'item_id')} % 1000 < 100 as validation from benchmark where {_H.format('5shard', 'item_id')} % 4 = 1")
def s4(spark, sf):
    rows = readers.sharded(read(spark, sf, "benchmark"), "item_id", 5, 4, 1)
    return rows.select("item_id", "text", hashing.in_validation(5, F.col("item_id"), 0.1).alias("validation"))


@query("op_p4_vqa_observation", "select item_id, text as base, '' as left_wrist, '' as right_wrist, 7::int as width, 0.0::double as total from benchmark")
def p4(spark, sf):
    rows = read(spark, sf, "benchmark").withColumn("o", restructure.vqa_observation(F.col("text"), 7))
    slots = [F.col("o")[s].alias(n) for s, n in zip(restructure.SLOTS, ("base", "left_wrist", "right_wrist"), strict=True)]
    return rows.select("item_id", *slots, F.size("o.state").alias("width"), F.aggregate("o.state", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("op_p5_two_cameras_three_instructions", f"""with {FRAMES}, x as (select *, 'user' || episode_id || '--' || event_type || '--' || t as step_id, {_H.format('3camera', 'episode_id')} / 4294967296.0::double as u,
  ['pick ' || episode_id, 'take ' || episode_id, 'lift ' || episode_id][({_H.format('3prompt', 'episode_id')} % 3 + 1)::int] as prompt from frames)
  select event_id, prompt, case when u > 0.5 then event_type else props end as base, '' as right_wrist, round(value, 4) as state, step_id, event_type = 'purchase' as passes_filter, 'droid' as dataset_name, 'joint_pos' as state_type, false as is_bimanual from x""")
def p5(spark, sf):
    rows = frames(spark, sf).withColumn("folder", F.concat(F.lit("user"), "episode_id"))
    words = {f"i{k}": F.concat(F.lit(w), "episode_id") for k, w in enumerate(("pick ", "take ", "lift "))}
    chosen = restructure.chosen_by_episode(rows.withColumns(words), "episode_id", 3, list(words), ("event_type", "props"))
    kept = rows.where("event_type = 'purchase'").select(F.concat_ws("--", "folder", "event_type", F.col("t").cast("string")).alias("step_id"))
    out = restructure.with_constants(restructure.with_step_filter(chosen, kept, "folder", "event_type", "t"), "droid", "joint_pos")
    out = out.withColumn("o", restructure.observation({restructure.SLOTS[0]: F.col("exterior")}, F.array("value")))
    base, _, right = restructure.SLOTS
    return out.select("event_id", "prompt", F.col("o")[base].alias("base"), F.col("o")[right].alias("right_wrist"), F.round("value", 4).alias("state"), "step_id", "passes_filter", "dataset_name", "state_type", "is_bimanual")


@query("op_p6_hashed_trajectories", """with n as (select *, row_number() over w as i, count(*) over (partition by conv_id) as n from conversations window w as (partition by conv_id order by turn)),
  d as (select conv_id, 'oxe-' || md5('oxe::' || md5(string_agg(case when i <= 2 or i > n - 2 then length(text)::varchar end, ',' order by turn))) as trajectory_id from n group by 1)
  select conv_id, turn, text as prompt, trajectory_id, 'oxe' as dataset_name, false as has_wrist_image from conversations join d using (conv_id) where regexp_matches(text, '\\S')""")
def p6(spark, sf):
    rows = restructure.with_trajectory_id(read(spark, sf, "conversations").withColumn("action", F.length("text")), "oxe", "action", TURNS, 2)
    out = restructure.with_constants(restructure.instructed(rows, "text"), "oxe", "none", wrist=False)
    return out.select("conv_id", "turn", F.col("text").alias("prompt"), "trajectory_id", "dataset_name", "has_wrist_image")


@query("op_p6_bounded_actions", f"with {POSES}, x as (select *, max(greatest(abs(e1), abs(e2), abs(e3))) over (partition by episode_id) as far from poses) select vec_id, episode_id from x where far <= 0.4")
def p6_bounds(spark, sf):
    rows = poses(spark, sf).withColumn("action", F.array("e1", "e2", "e3"))
    return restructure.within_bounds(rows, "action", EP, -0.4, 0.4).select("vec_id", "episode_id")


@query("op_p7_own_observation", "select vec_id, 'image' || label as base, '' as left_wrist, '' as right_wrist, len(embedding[:8])::int as width, round(list_sum(embedding[:8]::double[]), 4) as total from embeddings")
def p7(spark, sf):
    base, left, _ = restructure.SLOTS
    images = {base: F.concat(F.lit("image"), "label"), left: F.lit(None).cast("string")}
    rows = read(spark, sf, "embeddings").withColumn("o", restructure.observation(images, F.slice("embedding", 1, 8)))
    slots = [F.col("o")[s].alias(n) for s, n in zip(restructure.SLOTS, ("base", "left_wrist", "right_wrist"), strict=True)]
    return rows.select("vec_id", *slots, F.size("o.state").alias("width"), F.round(F.aggregate("o.state", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("op_p23_prepared_inputs", """select vec_id, case when label % 2 = 0 then 'label' || label else 'at@label' || label end as prompt, label % 3 <> 0 as has_base, false as has_wrist, 10::int as action_width,
  round(list_sum(embedding[:7]::double[]), 4) as total, 4::int as state_width from embeddings""")
def p23(spark, sf):
    image = F.when(F.col("label") % 3 != 0, "picture")
    rows = read(spark, sf, "embeddings").select(
        "vec_id", restructure.observation({restructure.SLOTS[0]: image}, F.slice("embedding", 1, 4)).alias("observation"),
        F.concat(F.lit("at@label"), "label").alias("prompt"), F.when(F.col("label") % 2 == 0, "sample_r1_lite").otherwise("bridge_orig").alias("dataset_name"),
        F.transform(F.slice("embedding", 1, 7), lambda x: x.cast("double")).alias("actions"),
    )
    base, left, _ = restructure.SLOTS
    got = restructure.prepared_inputs(rows, 10).select("vec_id", "inputs.*")
    return got.select(
        "vec_id", "prompt", F.col("image_mask")[base].alias("has_base"), F.col("image_mask")[left].alias("has_wrist"), F.size("actions").alias("action_width"),
        F.round(F.aggregate("actions", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("state").alias("state_width"),
    )


@query("op_f17_prunable_copies", """with r as (select doc_id, case when quality = 1 and toxic = 0 then 'annotated' when quality = 1 then 'hinted' else 'available' end as status, case when doc_id % 5 = 0 then 'look' else '' end as hint from labels)
  select d.doc_id, case when d.doc_id % 7 = 0 then null when d.doc_id % 2 = 0 then case when status = 'annotated' then 'annotation on server' end
  when status in ('hinted', 'annotated') or length(hint) > 0 then 'hint on server' end as reason from documents d left join r on r.doc_id = d.doc_id""")
def f17(spark, sf):
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "annotated").when(F.col("quality") == 1, "hinted").otherwise("available")
    records = read(spark, sf, "labels").select("doc_id", status.alias("status"), F.when(F.col("doc_id") % 5 == 0, "look").otherwise("").alias("hint"))
    copies = read(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 2 == 0).alias("annotated"), (F.col("doc_id") % 7 == 0).alias("in_review"))
    return restructure.prunable(copies, records, "doc_id").select("doc_id", "reason")


@query("op_r1_restarted_batches", f"""with u as (select doc_id, {_H.format('b', 'doc_id')} / 4294967296.0::double as u, count(*) over () as n from documents),
  r as (select doc_id, n // 64 as m, (row_number() over (order by u, doc_id) - 1) // 64 as batch from u)
  select step, count(*) as n, min(doc_id) as least from r, range(50) s(step) where batch < m and m > 1 and batch = 1 + step % (m - 1) group by 1""")
def r1(spark, sf):
    batched = mixture.with_batches(read(spark, sf, "documents").select("doc_id"), hashing.uniform("b", F.col("doc_id")), "doc_id", 64)
    return mixture.stepped(batched, 50, 1).groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))


@query("op_k4_resumed_annotations", "select conv_id, turn, case when conv_id % 3 = 0 then 'first' else 'second' end as run, conv_id % 6 <> 3 as passed from conversations union all select conv_id, turn, 'second', true from conversations where conv_id % 6 = 3")
def k4(spark, sf):
    path = f"{shared_dir(spark)}/annotations-{uuid.uuid4().hex}"
    rows = read(spark, sf, "conversations").select("conv_id", "turn")
    first = rows.where("conv_id % 3 = 0").select("*", F.lit("first").alias("run"), (F.col("conv_id") % 6 == 0).alias("passed"))
    sinks.append_new(first, path, "conv_id", "passed")
    sinks.append_new(rows.select("*", F.lit("second").alias("run"), F.lit(True).alias("passed")), path, "conv_id", "passed")
    return spark.read.schema("conv_id bigint, turn bigint, run string, passed boolean").json(path)


@query("op_k7_exported_episodes", f"""with {FRAMES}, m as (select episode_id, count(*) as n_frames, max(value) as top from frames group by 1 having count(*) >= 5)
  select f.episode_id, m.n_frames, round(m.top, 6) as top, count(*) as n, round(sum(value), 4) as total from frames f join m using (episode_id) group by all""")
def k7(spark, sf):
    path = f"{shared_dir(spark)}/episodes-{uuid.uuid4().hex}"
    rows = frames(spark, sf)
    long = rows.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_frames"), F.max("value").alias("top")).where("n_frames >= 5")
    sinks.export_episodes(rows, long, "episode_id", path)
    meta = spark.read.schema("episode_id bigint, n_frames bigint, top double").json(f"{path}/meta")
    found = readers.episodes(spark, path, "frames").groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return meta.join(found, "episode_id").select("episode_id", "n_frames", F.round("top", 6).alias("top"), "n", "total")


@query("op_k10_call_log", "select conv_id, turn, role as tool, length(text) as n_chars from conversations")
def k10(spark, sf):
    path = f"{shared_dir(spark)}/calls-{uuid.uuid4().hex}"
    rows = read(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("tool"), F.length("text").cast("bigint").alias("n_chars"))
    for part in (rows.where("turn % 2 = 0"), rows.where("coalesce(turn % 2 <> 0, true)")):
        sinks.append_log(part, path)
    return spark.read.schema(rows.schema).json(path)


@query("op_s2_versioned_table", "select episode_id, count(*) as n from (select user_id as episode_id from events) group by 1")
def s2(spark, sf):
    path = f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}"
    rows = frames(spark, sf).select("episode_id", "t")
    rows.where("t = 0").write.parquet(f"{path}/1.0.0")
    rows.write.parquet(f"{path}/1.1.0/part")
    return readers.episodes(spark, path, "1.1.0").groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"))


_PROMPTS = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in questions.CAPTION_PROMPTS) + "]"


@query("op_vqa_captions", f"""with c as (select conv_id, list(coalesce(text, '') order by turn) as captions from conversations group by 1)
  select conv_id, 'captions_' || conv_id || '_' || len(captions) as sample_id, {_PROMPTS}[({_H.format('9prompt', 'conv_id')} % {len(questions.CAPTION_PROMPTS)} + 1)::int] as prompt,
  captions[({_H.format('9caption', 'conv_id')} % len(captions) + 1)::int] as caption from c""")
def vqa_captions(spark, sf):
    listed = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    rows = read(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(listed, lambda s: s["text"]).alias("captions"))
    prompt, caption = questions.caption_sample(F.col("conv_id"), F.col("captions"), 9)
    return rows.select("conv_id", questions.sample_id("captions", F.col("conv_id"), F.size("captions")).alias("sample_id"), prompt.alias("prompt"), caption.alias("caption"))


@query("op_vqa_points", f"""with p as (select vec_id, label, [{{'x': round_even(abs(embedding[2 * i - 1]::double) * 100.0::double * 10.0::double, 0) / 10.0::double, 'y': round_even(abs(embedding[2 * i]::double) * 100.0::double * 10.0::double, 0) / 10.0::double, 'i': i}} for i in range(1, 21)] as pts from embeddings),
  s as (select vec_id, label, list_sort([{{'k': q.x * 10000.0::double + q.y, 'i': q.i, 'x': q.x, 'y': q.y}} for q in pts]) as pts from p)
  select vec_id, case {_H.format('9point', 'vec_id')} % 2 when 0 then 'Find the ' || label || '.' else 'Show me where the ' || label || ' are.' end as prompt,
  array_to_string([printf('<loc%04d>', round_even(q.y / 100.0::double * 1023.0::double, 0)::int) || printf('<loc%04d>', round_even(q.x / 100.0::double * 1023.0::double, 0)::int) for q in pts], '') as caption from s""")
def vqa_points(spark, sf):
    e = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(F.get(e, 2 * k).alias("x"), F.get(e, 2 * k + 1).alias("y")))
    prompt = questions.point_prompt(F.col("vec_id"), F.col("label").cast("string"), [("Find the ", "."), ("Show me where the ", " are.")], 9)
    return read(spark, sf, "embeddings").select("vec_id", prompt.alias("prompt"), questions.points_text(pairs).alias("caption"))


_W = "window w as (partition by episode_id order by t), z as (partition by episode_id order by t rows between unbounded preceding and unbounded following)"
_AFTER = ", ".join(f"coalesce(lead(e{j}, {k}) over w, last_value(e{j}) over z) as a{k}_{j}" for k in (1, 2) for j in range(1, 8))
_TURNS = [X(f"e{j}") for j in (4, 5, 6)]
_D = {k: product(flipped(R), named(range(9), f"s{k}_")) for k in (1, 2)}


@query("op_w3_chunk_poses", f"""with {POSES}, n as (select *, {_AFTER} from poses {_W}), {stage('n', 'm', r=fixed_axes(*_TURNS), **{f's{k}_': fixed_axes(*[X(f'a{k}_{j}') for j in (4, 5, 6)]) for k in (1, 2)})},
  {stage('m', 'd', **{f'd{k}_': _D[k] for k in (1, 2)})} select vec_id, {', '.join(
    shown([*[X(f'(a{k}_{j} - e{j})') for j in (1, 2, 3)], *angles(named(range(9), f'd{k}_')), X('e7' if k == 1 else 'a1_7')], [f'{name}{k}' for name in ('x', 'y', 'z', *RPY, 'grip')]) for k in (1, 2))} from d""")
def w3_poses(spark, sf):
    chunk = windows.chunk_poses([F.col(f"e{j}") for j in range(1, 7)], F.col("e7"), 2, EP)
    rows = poses(spark, sf).withColumn("c", chunk)
    names = ("x", "y", "z", *RPY, "grip")
    return rows.select("vec_id", *[rounded(F.get(F.get("c", F.lit(k - 1)), F.lit(i))).alias(f"{name}{k}") for k in (1, 2) for i, name in enumerate(names)])


@query("op_w3_chunk_joints", f"with {POSES}, n as (select *, {_AFTER} from poses {_W}) select vec_id, {', '.join(shown([X(f'e{j}') if k == 0 else X(f'a{k}_{j}') for j in (1, 7)], [f'first{k}', f'grip{k}']) for k in (0, 1, 2))} from n")
def w3_joints(spark, sf):
    rows = poses(spark, sf).withColumn("c", windows.chunk_poses([F.col(f"e{j}") for j in range(1, 7)], F.col("e7"), 3, EP, joint=True))
    return rows.select("vec_id", *[rounded(F.get(F.get("c", F.lit(k)), F.lit(i))).alias(f"{name}{k}") for k in range(3) for i, name in ((0, "first"), (6, "grip"))])
