"""Sources of the reference's own kinds: large documents, chunked arrays, record files, and lookups and caches built once."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import standardize
from tidemark.plans.registry import FRAMES, POSES, poses, query
from tidemark.plans.registry import table as read
from tidemark.sources import episode_arrays, lookups, readers, record_files, versions
from tidemark.sources.shared import shared_dir
from tidemark.streaming import live_queue


@query("op_s5_large_document", """select 'doc' || conv_id // 500 as file, conv_id::varchar as episode, count(*) over (partition by conv_id)::int as n_steps, turn::int as step,
  nullif(role, '') as task, text as subtask from conversations where conv_id is not null and turn is not null""")
def s5_document(spark, sf):
    rows = read(spark, sf, "conversations").where("conv_id is not null and turn is not null")
    step = F.struct(F.expr("nullif(role, '')").alias("task"), F.col("text").alias("subtask"))
    told = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), step))).alias("reasoning"))
    episode = F.struct(F.struct(F.col("n").alias("n_steps")).alias("metadata"), "reasoning")
    # One document of at most 500 conversations each, on one line.
    group = F.floor(F.col("conv_id") / 500).cast("bigint")
    episodes = F.map_from_entries(F.collect_list(F.struct(F.col("conv_id").cast("string"), episode)))
    docs = told.groupBy(group.alias("part")).agg(episodes.alias("episodes"))
    path = f"{shared_dir(spark)}/tidemark/documents-{uuid.uuid4().hex}"
    text = F.to_json(F.create_map(F.concat(F.lit("doc"), F.col("part").cast("string")), F.col("episodes")))
    docs.select("part", text.alias("value")).write.partitionBy("part").text(path)
    return readers.reasoning_document(spark, path).select("file", "episode", "n_steps", "step", "task", "subtask")


def _stored(spark, sf) -> str:
    """The pose fixture as files of chunked arrays; returns their folder."""
    path = f"{shared_dir(spark)}/tidemark/arrays-{uuid.uuid4().hex}"
    rows = poses(spark, sf)
    part = lambda a, b: F.array(*[F.col(f"e{k}") for k in range(a, b)])
    arrays = rows.select("episode_id", "t", part(1, 15).alias("qpos"), part(1, 8).alias("left_endpose"), part(8, 15).alias("right_endpose"), "vec_id")
    episode_arrays.write(arrays, path, "episode_id", "t", ["qpos", "left_endpose", "right_endpose", "vec_id"], chunk_frames=16, file_frames=1024)
    return path


@query("op_s9_chunk_range", f"""with {POSES} select vec_id, episode_id::bigint as episode, t as frame, 14::int as width, round(case when episode_id % 2 = 0 then e1 else e8 end, 5) as first
  from poses where t >= 10 and t < 30""")
def s9_range(spark, sf):
    frames = episode_arrays.frames_of(spark, _stored(spark, sf), "qpos array<double>, left_endpose array<double>, right_endpose array<double>, vec_id bigint")
    state = F.when(F.col("episode") % 2 == 0, F.col("qpos")).otherwise(F.concat("right_endpose", "left_endpose"))
    return frames.where("frame >= 10 and frame < 30").select("vec_id", "episode", "frame", F.size(state).alias("width"), F.round(state[0], 5).alias("first"))


@query("op_s20_frame_access", f"""with {POSES}, n as (select episode_id, max(t) as top from poses group by 1)
  select a.vec_id, string_agg(b.vec_id::varchar, ',' order by k) as ids from poses a join n using (episode_id), range(4) r(k)
  join poses b on b.episode_id = a.episode_id and b.t = least(a.t + k, n.top) where a.vec_id % 3 = 0 group by 1""")
def s20_access(spark, sf):
    asked = poses(spark, sf).where("vec_id % 3 = 0").select(F.col("episode_id").cast("bigint").alias("episode"), F.col("t").alias("frame"), F.col("vec_id").alias("asked"))
    found = episode_arrays.at_frames(asked, _stored(spark, sf), "vec_id", horizon=4)
    return found.select(F.col("asked").alias("vec_id"), F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("ids"))


def _recorded(spark, sf) -> str:
    """Every conversation as an example in record files; returns their folder."""
    path = f"{shared_dir(spark)}/tidemark/records-{uuid.uuid4().hex}"
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.char_length(F.coalesce("text", F.lit(""))).alias("n"))))
    rows = read(spark, sf, "conversations").where("conv_id is not null and turn is not null").groupBy("conv_id").agg(turns.alias("s"))
    steps = rows.select("conv_id", *[F.col("s")[f].cast(f"array<{k}>").alias(f"steps/{f}") for f, k in (("turn", "bigint"), ("role", "string"), ("n", "double"))])
    record_files.write(record_files.as_examples(steps, steps.columns), path, "data")
    return path


_EXAMPLE = "conv_id bigint, `steps/turn` array<bigint>, `steps/role` array<string>, `steps/n` array<float>"


@query("op_s1_record_scan", "select conv_id, count(*) as n, max(turn)::bigint as top, string_agg(coalesce(role, ''), ',' order by turn) as roles, sum(length(coalesce(text, '')))::bigint as chars from conversations where turn is not null and conv_id is not null group by 1")
def s1_scan(spark, sf):
    found = record_files.index(record_files.files(spark, _recorded(spark, sf)))
    rows = record_files.examples(record_files.records(found), _EXAMPLE)
    chars = F.aggregate("steps/n", F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    return rows.select("conv_id", F.size("steps/turn").cast("bigint").alias("n"), F.array_max("steps/turn").alias("top"), F.array_join("steps/role", ",").alias("roles"), chars.alias("chars"))


@query("op_s3_host_shards", "select conv_id, 1::bigint as hosts from conversations where conv_id is not null and turn is not null group by 1")
def s3_hosts(spark, sf):
    path = _recorded(spark, sf)
    parts = [record_files.index(record_files.files(spark, path, "train", seed=7, shard=(k, 3))) for k in range(3)]
    read_by = [record_files.examples(record_files.records(p), "conv_id bigint").select("conv_id", F.lit(k).alias("host")) for k, p in enumerate(parts)]
    return read_by[0].union(read_by[1]).union(read_by[2]).groupBy("conv_id").agg(F.count("host").alias("hosts"))


_WORDS = {"click": "claim_hint", "view": "claim_annot", "error": "release", "purchase": "annotated", "signup": "hint"}
_LEASE = 200_000


@query("op_r5_live_queue", f"""with recursive {FRAMES}, c as (select episode_id::varchar as record, t, epoch_ms(ts) as ms,
    case event_type when 'click' then 'claim_hint' when 'view' then 'claim_annot' when 'error' then 'release' when 'purchase' then 'annotated' when 'signup' then 'hint' else 'none' end as w from frames),
  r as (select distinct record, -1::bigint as t, 'available' as s, null::bigint as since, 0::bigint as n, 0::bigint as won, 0::bigint as expired from c
    union all select record, t, case when won_now then case w when 'claim_hint' then 'hint_claimed' else 'annot_claimed' end when w = 'annotated' then 'annotated' when w = 'hint' and s in ('available', 'hint_claimed') then 'hinted'
        when w = 'release' and s = 'hint_claimed' then 'available' when w = 'release' and s = 'annot_claimed' then 'hinted' else s end,
      case when won_now then ms when w = 'annotated' and s <> 'annotated' or w = 'hint' and s in ('available', 'hint_claimed') or w = 'release' then null else since end,
      n + 1 + old::int, won + won_now::int, expired + old::int from (
        select *, w = 'claim_hint' and s = 'available' or w = 'claim_annot' and s = 'hinted' as won_now from (
          select c.record, c.t, c.ms, c.w, coalesce(c.ms >= r.since + {_LEASE}000, false) as old, n, won, expired, case when coalesce(c.ms >= r.since + {_LEASE}000, false) then null else r.since end as since,
            case when coalesce(c.ms >= r.since + {_LEASE}000, false) then case r.s when 'hint_claimed' then 'available' else 'hinted' end else r.s end as s
          from r join c on c.record = r.record and c.t = r.t + 1))),
  last as (select * from r qualify row_number() over (partition by record order by t desc) = 1),
  done as (select *, coalesce(since + {_LEASE}000 < (select max(ms) from c), false) as gone from last)
  select record, case when gone then case s when 'hint_claimed' then 'available' else 'hinted' end else s end as status, n + gone::int as n, won, expired + gone::int as expired from done""")
def r5_live(spark, sf):
    base = f"{shared_dir(spark)}/tidemark/queue-{uuid.uuid4().hex}"
    word = F.create_map(*[F.lit(x) for kv in _WORDS.items() for x in kv])[F.col("event_type")]
    rows = read(spark, sf, "events").select(F.col("user_id").cast("string").alias("record"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").cast("bigint").alias("seq"), F.coalesce(word, F.lit("none")).alias("command"), F.lit(None).cast("string").alias("worker"))
    rows.write.parquet(f"{base}/commands")
    commands = spark.readStream.schema(live_queue.COMMANDS).parquet(f"{base}/commands")
    live_queue.start(live_queue.live(commands, _LEASE), f"{base}/outcomes", f"{base}/state").awaitTermination()
    told = spark.read.schema(live_queue.OUTCOMES).parquet(f"{base}/outcomes")
    won = F.count_if(F.startswith("command", F.lit("claim")) & F.col("accepted")).cast("bigint").alias("won")
    return told.groupBy("record").agg(F.max_by("status", "n").alias("status"), F.max("n").alias("n"), won, F.count_if(F.col("command") == "expire").cast("bigint").alias("expired"))


@query("op_r6_versioned_table", "select c_mktsegment as segment, count(*) as n, count_if(c_acctbal < 0)::bigint as low, 2::int as version from customer group by 1")
def r6_versions(spark, sf):
    path = f"{shared_dir(spark)}/tidemark/versions-{uuid.uuid4().hex}"
    rows = read(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), "c_acctbal")
    versions.update(spark, path, lambda old: rows.where("c_acctbal >= 0"))
    version = versions.update(spark, path, lambda old: old.unionByName(rows.where("not coalesce(c_acctbal >= 0, false)")))
    return versions.read(spark, path).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") < 0).cast("bigint").alias("low"), F.lit(version).alias("version"))


@query("op_j4_shared_lookup", """with told as (select c_custkey as k, c_mktsegment as segment from customer)
  select 'orders' as source, segment, count(*) as n from orders left join told on o_custkey = k group by 2 union all
  select 'events', segment, count(*) from events left join told on user_id = k group by 2""")
def j4(spark, sf):
    told = read(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("custkey"), F.col("c_mktsegment").alias("segment"))
    lookup = lookups.SharedLookup.build(told, f"segments_{uuid.uuid4().hex}", "custkey", 8)
    orders = read(spark, sf, "orders").select(F.lit("orders").alias("source"), F.col("o_custkey").cast("bigint").alias("k"))
    events = read(spark, sf, "events").select(F.lit("events").alias("source"), F.col("user_id").cast("bigint").alias("k"))
    return lookup.join(orders, "k").unionByName(lookup.join(events, "k")).groupBy("source", "segment").agg(F.count(F.lit(1)).alias("n"))


@query("op_k9_mapping_cache", "select (conv_id % 8)::varchar as grp, count(*) as n, sum(length(coalesce(text, '')))::bigint + case when conv_id % 8 = 3 then count(*) else 0 end as chars, case when conv_id % 8 = 3 then 2 else 1 end::int as run from conversations where conv_id is not null group by conv_id % 8")
def k9_cache(spark, sf):
    base = f"{shared_dir(spark)}/tidemark/mapping-{uuid.uuid4().hex}"
    rows = read(spark, sf, "conversations").where("conv_id is not null").select((F.col("conv_id") % 8).cast("string").alias("grp"), F.coalesce("text", F.lit("")).alias("text"))
    name = F.regexp_extract("path", r"grp=(\w+)/", 1)
    runs = iter((1, 2))

    def build(paths):
        number = next(runs)
        found = spark.read.schema("text string").parquet(*paths).select(F.regexp_extract("_metadata.file_path", r"grp=(\w+)/", 1).alias("group"), F.char_length("text").cast("bigint").alias("chars"))
        return found.withColumn("built", F.lit(number))

    rows.write.partitionBy("grp").parquet(f"{base}/in")
    lookups.cached_mapping(readers.file_listing(spark, f"{base}/in", "*.parquet"), name, build, f"{base}/cache").write.format("noop").mode("overwrite").save()
    # One group's files are replaced; only these are read by the second run.
    rows.where("grp = '3'").select(F.concat("text", F.lit("x")).alias("text")).write.mode("overwrite").parquet(f"{base}/in/grp=3")
    now = lookups.cached_mapping(readers.file_listing(spark, f"{base}/in", "*.parquet"), name, build, f"{base}/cache")
    return now.groupBy(F.col("group").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.max("built").alias("run"))


def _put_images(rows, root: str) -> None:
    """An empty first image for each folder that is to have one."""

    def run(batches):
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                system, inner = episode_arrays.place(f"{root}/{folder}")
                system.create_dir(inner, recursive=True)
                system.open_output_stream(f"{inner}/wrist_0000.jpg").write(b"-")
            yield batch

    rows.mapInArrow(run, rows.schema).write.format("noop").mode("overwrite").save()


@query("op_s14_pilot_manifest", """with e as (select conv_id, list(length(coalesce(text, '')) / 100.0::double order by turn) as g from conversations where conv_id is not null group by 1)
  select conv_id || ':' || (k - 1) as frame, round(g[k], 6) as gripper, 'c' || conv_id % 20 || '/primary_' || lpad((k - 1)::varchar, 4, '0') || '.jpg' as primary_image,
  case when conv_id % 20 < 7 then 'c' || conv_id % 20 || '/wrist_' || lpad((k - 1)::varchar, 4, '0') || '.jpg' end as wrist_image from e, range(1, 1 + len(g)) r(k)""")
def s14_pilot(spark, sf):
    base = f"{shared_dir(spark)}/tidemark/pilot-{uuid.uuid4().hex}"
    widths = F.transform(F.array_sort(F.collect_list(F.struct("turn", (F.char_length(F.coalesce("text", F.lit(""))) / 100.0).alias("w")))), lambda s: s["w"])
    rows = read(spark, sf, "conversations").where("conv_id is not null").groupBy("conv_id").agg(widths.alias("gripper_width"))
    folder = F.concat(F.lit("c"), (F.col("conv_id") % 20).cast("string"))
    lines = rows.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("episode_id"), F.lit(" stack it ").alias("task_instruction"), "gripper_width", folder.alias("image_dir"))).alias("value"))
    broken = rows.where("conv_id % 9 = 0").select(F.concat(F.lit('{"episode_id": "'), F.col("conv_id").cast("string")).alias("value"))
    lines.union(broken).write.text(f"{base}/manifest")
    _put_images(rows.where("conv_id % 20 < 7").select(folder.alias("folder")).distinct(), f"{base}/images")
    found = readers.pilot_frames(readers.pilot_episodes(spark, f"{base}/manifest", f"{base}/images"))
    short = lambda c: F.replace(F.col(c), F.lit(f"{base}/images/"), F.lit(""))
    return found.select(F.concat_ws(":", "episode_id", F.col("frame").cast("string")).alias("frame"), F.round("gripper", 6).alias("gripper"), short("primary").alias("primary_image"), short("wrist").alias("wrist_image"))


@query("op_s7_metadata_files", "select c_custkey as episode, c_mktsegment as task, c_nationkey as part from customer")
def s7_metadata(spark, sf):
    base = f"{shared_dir(spark)}/tidemark/meta-{uuid.uuid4().hex}"
    rows = read(spark, sf, "customer").select(F.col("c_custkey").alias("episode"), F.col("c_mktsegment").alias("task"), F.col("c_nationkey").alias("part"))
    rows.withColumn("chunk", F.col("part") % 4).write.partitionBy("chunk").parquet(f"{base}/meta/episodes")
    return readers.episodes(spark, base, "meta").select("episode", "task", "part")


@query("op_p20_config_checks", """with c as (select s_suppkey, ['EEF_POS', 'EEF_R6', 'POLAR', 'JOINT_POS', null][s_suppkey % 5 + 1] as enc, ['english', 'None', ''][s_suppkey % 3 + 1] as lang, case when s_suppkey % 7 > 0 then 'image' end as cam, ['yes', 'no'][s_suppkey % 2 + 1] as sub from supplier)
  select s_suppkey, case when enc is null or enc = 'POLAR' then 'action encoding not supported' when lang <> 'english' then 'language annotations required' when cam is null then 'primary image required' end as problem,
  case when sub = 'yes' then 'suboptimal data' end as warning from c""")
def p20_configs(spark, sf):
    key = F.col("s_suppkey")
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))
    problem = standardize.config_problem(pick(["EEF_POS", "EEF_R6", "POLAR", "JOINT_POS", None]), pick(["english", "None", ""]), F.when(key % 7 > 0, "image"))
    return read(spark, sf, "supplier").select("s_suppkey", problem.alias("problem"), standardize.config_warning(pick(["yes", "no"])).alias("warning"))
