"""Windows, fills, chunks and keyframes along episodes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.operators import folds, keyframes, windows
from tidemark.operators.standardize import FALLBACKS
from tidemark.plans.registry import EP, FRAMES, POSES, frames, poses, query, rounded
from tidemark.plans.registry import table as read

_W = "window w as (partition by episode_id order by t)"
_WHOLE = "partition by episode_id order by t rows between unbounded preceding and unbounded following"


@query("op_min_slice", f"""
with {FRAMES}, d as (select *, lead(value) over (partition by episode_id order by t) - value as d from frames),
s as (select *, case when ('0x' || substr(md5('7' || episode_id::varchar), 1, 8))::ubigint % 1000 < 25 then 'val' else 'train' end as split from d)
select split, count(*) as n, count(distinct episode_id) as episodes, round(avg(coalesce(d, 0)), 6) as mean_delta,
  round(stddev_pop(coalesce(d, 0)), 6) as std_delta from s group by split""")
def min_slice(spark, sf):
    rows = frames(spark, sf).withColumn("d", windows.delta_to_next(F.col("value"), EP))
    split = F.when(hashing.in_validation(7, F.col("episode_id"), 0.025), "val").otherwise("train").alias("split")
    return rows.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("episode_id").alias("episodes"),
        F.round(F.avg("d"), 6).alias("mean_delta"), F.round(F.stddev_pop("d"), 6).alias("std_delta"),
    )


@query("op_w1_zero_window", f"""with {FRAMES} select event_id, value as c0, coalesce(lead(value, 1) over w, 0) as c1,
  coalesce(lead(value, 2) over w, 0) as c2, coalesce(lead(value, 3) over w, 0) as c3 from frames {_W}""")
def w1(spark, sf):
    rows = frames(spark, sf).withColumn("c", windows.window_zero_padded(F.col("value"), 4, EP))
    return rows.select("event_id", *[F.get("c", F.lit(k)).alias(f"c{k}") for k in range(4)])


@query("op_w1_masked_window", f"""with {FRAMES}, x as (select *, event_id % 4 + 1 as h from frames)
  select event_id, value as c0, case when h > 1 then coalesce(lead(value, 1) over w, 0) else 0 end as c1,
  case when h > 2 then coalesce(lead(value, 2) over w, 0) else 0 end as c2,
  case when h > 3 then coalesce(lead(value, 3) over w, 0) else 0 end as c3 from x {_W}""")
def w1_masked(spark, sf):
    rows = frames(spark, sf).withColumn("h", (F.col("event_id") % 4 + 1).cast("int"))
    rows = rows.withColumn("c", windows.window_zero_padded(F.col("value"), 4, EP, F.col("h")))
    return rows.select("event_id", *[F.get("c", F.lit(k)).alias(f"c{k}") for k in range(4)])


@query("op_w2_last_window", f"""with {FRAMES}, x as (select *, last_value(value) over ({_WHOLE}) as z from frames)
  select event_id, value as c0, coalesce(lead(value, 1) over w, z) as c1, coalesce(lead(value, 2) over w, z) as c2,
  coalesce(lead(value, 3) over w, z) as c3 from x {_W}""")
def w2(spark, sf):
    rows = frames(spark, sf).withColumn("c", windows.window_last_padded(F.col("value"), 4, EP))
    return rows.select("event_id", *[F.get("c", F.lit(k)).alias(f"c{k}") for k in range(4)])


@query("op_w3_chunk_relative", f"""with {FRAMES}, x as (select *, last_value(value) over ({_WHOLE}) as z from frames)
  select event_id, coalesce(lead(value, 1) over w, z) - value + 0.0 as c1, coalesce(lead(value, 2) over w, z) - value + 0.0 as c2,
  coalesce(lead(value, 3) over w, z) - value + 0.0 as c3 from x {_W}""")
def w3(spark, sf):
    rows = frames(spark, sf).withColumn("c", windows.chunk_relative(F.col("value"), 3, EP))
    return rows.select("event_id", *[(F.get("c", F.lit(k)) + F.lit(0.0)).alias(f"c{k + 1}") for k in range(3)])


@query("op_w6_delta", f"with {FRAMES} select event_id, coalesce(lead(value) over w - value, 0) as delta from frames {_W}")
def w6(spark, sf):
    return frames(spark, sf).select("event_id", windows.delta_to_next(F.col("value"), EP).alias("delta"))


@query("op_w7_relabel", f"with {FRAMES}, x as (select event_id, lead(value) over w - value as delta from frames {_W}) select * from x where delta is not null")
def w7(spark, sf):
    return windows.relabelled(frames(spark, sf), "value", EP).select("event_id", "delta")


@query("op_w8_drop_first", f"with {FRAMES} select episode_id, count(*) as n, min(t) as first_t from frames where t > 0 group by 1")
def w8(spark, sf):
    return windows.without_first(frames(spark, sf), EP).groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"))


@query("op_w9_variable_sum", f"""with {FRAMES}, x as (select *, ('0x' || substr(md5('h' || event_id::varchar), 1, 8))::ubigint % 4 + 1 as h,
  count(*) over (partition by episode_id) as n from frames), y as (select *, least(h, n - t) as len from x)
  select event_id, len::int as len, round(value + case when len > 1 then lead(value, 1) over w else 0 end
  + case when len > 2 then lead(value, 2) over w else 0 end + case when len > 3 then lead(value, 3) over w else 0 end, 6) as total from y {_W}""")
def w9(spark, sf):
    horizon = (hashing.bucket("h", F.col("event_id"), 4) + 1).cast("int")
    left = (F.count(F.lit(1)).over(Window.partitionBy("episode_id")) - F.col("t")).cast("int")
    rows = frames(spark, sf).withColumn("len", F.least(horizon, left))
    masked = windows.window_zero_padded(F.col("value"), 4, EP, F.col("len"))
    return rows.withColumn("w", masked).select("event_id", "len", F.round(F.aggregate("w", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("op_w10_future_frame", f"with {FRAMES} select event_id, value as now, coalesce(lead(value, 5) over w, last_value(value) over ({_WHOLE})) as later from frames {_W}")
def w10(spark, sf):
    return frames(spark, sf).select("event_id", F.col("value").alias("now"), windows.future_frame(F.col("value"), 5, EP).alias("later"))


@query("op_w11_gripper_fill", f"""with {FRAMES}, x as (select *, case when g > 0.8 then 1.0::double when g < 1 - 0.8::double then 0.0::double end as d from frames)
  select event_id, coalesce(first_value(d ignore nulls) over (partition by episode_id order by t rows between current row and unbounded following),
  last_value(g) over ({_WHOLE})) as grip from x""")
def w11(spark, sf):
    return frames(spark, sf).select("event_id", windows.filled_gripper(F.col("g"), EP, 0.8).alias("grip"))


@query("op_w12_gripper_absolute", f"""with {FRAMES}, x as (select *, case when g - 0.5 < -0.3 then 1 when g - 0.5 > 0.3 then -1 end as c from frames)
  select event_id, coalesce(last_value(c ignore nulls) over (partition by episode_id order by t rows between unbounded preceding and current row),
  -first_value(c ignore nulls) over (partition by episode_id order by t rows between current row and unbounded following), 1) / 2.0::double + 0.5::double as grip from x""")
def w12(spark, sf):
    return frames(spark, sf).select("event_id", windows.absolute_gripper(F.col("g") - 0.5, EP, 0.3).alias("grip"))


_RUNS = """with recursive {frames}, p as (select episode_id, t, (1.0 - g) * 100.0 as pct from frames),
r as (select episode_id, t, pct, 0 as dir, 0::bigint as start, pct as frm, null::bigint as c_start, null::double as c_from, null::double as c_last from p where t = 0
  union all
  select p.episode_id, p.t, p.pct,
    case when turns then sign(p.pct - r.pct)::int else r.dir end, case when turns then r.t else r.start end, case when turns then r.pct else r.frm end,
    case when turns and r.dir <> 0 then r.start end, case when turns and r.dir <> 0 then r.frm end, case when turns and r.dir <> 0 then r.pct end
  from r join p on p.episode_id = r.episode_id and p.t = r.t + 1,
    lateral (select (r.dir = 0 and abs(p.pct - r.pct) >= 1) or (r.dir <> 0 and (p.pct - r.pct) * r.dir < -2) as turns) as q),
ends as (select episode_id, c_start as t, c_from as f, c_last as l from r where c_start is not null
  union all select episode_id, start, frm, pct from r where dir <> 0 and (episode_id, t) in (select episode_id, max(t) from p group by 1)),
ev as (select episode_id, t, case when l > f then 'release' else 'grasp' end as kind from ends where abs(l - f) >= 20)""".replace("{frames}", FRAMES)


@query("op_w13_gripper_events", _RUNS + " select episode_id, t::int as t, kind from ev")
def w13(spark, sf):
    return keyframes.gripper_events(frames(spark, sf), EP)


@query("op_w14_retries", _RUNS + """, z as (select *, lag(kind, 2) over w as k2, lag(kind, 1) over w as k1, lag(t, 2) over w as t2 from ev window w as (partition by episode_id order by t))
  select episode_id, t::int as t, case when k2 = 'grasp' and k1 = 'release' and kind = 'grasp' and t - t2 <= 22 then 'retry' else kind end as kind from z""")
def w14(spark, sf):
    return keyframes.with_retries(keyframes.gripper_events(frames(spark, sf), EP), EP)


def _mean(axis: str, a: str, b: str) -> str:
    return f"avg(v{axis}) over (partition by episode_id order by t rows between {a} and {b})"


_MOTION = f"""with {POSES}, s as (select *, (e1 - lag(e1) over w) * 15.0::double as v1, (e2 - lag(e2) over w) * 15.0::double as v2, (e3 - lag(e3) over w) * 15.0::double as v3 from poses {_W}),
m as (select *, count(*) over (partition by episode_id) as n, {", ".join(f"{_mean(k, '4 preceding', '1 preceding')} as b{k}, {_mean(k, 'current row', '3 following')} as a{k}" for k in "123")} from s),
q as (select *, sqrt(b1*b1 + b2*b2 + b3*b3) as sb, sqrt(a1*a1 + a2*a2 + a3*a3) as sa, (b1*a1 + b2*a2 + b3*a3) / (sqrt(b1*b1 + b2*b2 + b3*b3) * sqrt(a1*a1 + a2*a2 + a3*a3) + 1e-6) as c from m),
ch as (select episode_id, t, c as cosine from q where t >= 5 and t <= n - 5 and n >= 10 and (sb >= 1e-4 or sa >= 1e-4) and ((c < 0.3 and sb > 0.02 and sa > 0.02) or abs(sa - sb) > 0.05))"""


@query("op_w15_motion_changes", _MOTION + " select episode_id, t, round(cosine, 6) + 0.0 as cosine from ch")
def w15(spark, sf):
    found = keyframes.motion_changes(poses(spark, sf), EP, ("e1", "e2", "e3"), window=4)
    return found.select("episode_id", "t", rounded(F.col("cosine")).alias("cosine"))


@query("op_w16_sharpest_changes", _MOTION.replace("with poses", "with recursive poses", 1) + """, o as (select episode_id, t, row_number() over (partition by episode_id order by cosine, t) as i from ch),
  k as (select episode_id, 0::bigint as i, []::bigint[] as kept from (select distinct episode_id from ch) union all
    select o.episode_id, o.i, case when len(list_filter(kept, lambda x: abs(x - o.t) < 8)) > 0 then kept else list_append(kept, o.t) end from k join o on o.episode_id = k.episode_id and o.i = k.i + 1),
  l as (select episode_id, kept, row_number() over (partition by episode_id order by i desc) as r from k)
  select episode_id, unnest(kept)::int as t from l where r = 1""")
def w16(spark, sf):
    return keyframes.sharpest(keyframes.motion_changes(poses(spark, sf), EP, ("e1", "e2", "e3"), window=4), EP)


_TYPED = f"""{FRAMES}, k as (select episode_id, t, case when t = 0 then 'begin' when t = max(t) over (partition by episode_id) then 'end'
  when event_type in ('purchase', 'signup') then 'grasp' when event_type = 'click' then 'motion' else 'filler' end as kind from frames where t % 2 = 0 or event_type = 'click')"""


def _typed(spark, sf):
    rows = frames(spark, sf).where((F.col("t") % 2 == 0) | (F.col("event_type") == "click"))
    last = F.max("t").over(Window.partitionBy("episode_id"))
    kind = F.when(F.col("t") == 0, "begin").when(F.col("t") == last, "end").when(F.col("event_type").isin("purchase", "signup"), "grasp")
    return rows.select("episode_id", "t", kind.when(F.col("event_type") == "click", "motion").otherwise("filler").alias("kind"))


@query("op_w17_merge_close", f"""with recursive {_TYPED},
o as (select episode_id, t, kind, case kind when 'begin' then 5 when 'end' then 5 when 'grasp' then 4 when 'motion' then 2 else 1 end as prio,
  row_number() over (partition by episode_id order by t) as i, count(*) over (partition by episode_id) as n from k),
s as (select episode_id, i, n, [{{'t': t, 'prio': prio, 'kind': kind}}] as kept from o where i = 1
  union all select o.episode_id, o.i, o.n, case
    when not (o.t - kept[-1].t < 3 and kept[-1].kind <> 'begin' and o.kind <> 'end') then list_append(kept, {{'t': o.t, 'prio': o.prio, 'kind': o.kind}})
    when o.prio > kept[-1].prio then list_append(kept[:-2], {{'t': o.t, 'prio': o.prio, 'kind': o.kind}}) else kept end
  from s join o on o.episode_id = s.episode_id and o.i = s.i + 1),
f as (select episode_id, unnest(kept) as x from s where i = n and n > 2 union all select episode_id, {{'t': t, 'prio': prio, 'kind': kind}} from o where n <= 2)
select episode_id, x.t::int as t, x.kind as kind from f""")
def w17(spark, sf):
    return keyframes.merged(_typed(spark, sf), EP)


@query("op_w18_gap_fillers", f"""with {FRAMES}, m as (select episode_id, t * 40 as t from frames where event_type = 'error'),
  g as (select *, lead(t) over (partition by episode_id order by t) - t as gap from m)
  select episode_id, (t + (j * gap) // (gap // 60 + 1))::int as t from (select *, unnest(range(1, gap // 60 + 1)) as j from g where gap > 60)""")
def w18(spark, sf):
    marks = frames(spark, sf).where("event_type = 'error'").select("episode_id", (F.col("t") * 40).alias("t"))
    return keyframes.fillers(marks, EP)


@query("op_w19_keyframes")
def w19(spark, sf):
    return keyframes.keyframes(poses(spark, sf).withColumn("g", F.col("e7") - F.floor("e7")), EP, "g", ("e1", "e2", "e3"))


@query("op_w20_motion_start", f"""with {FRAMES}, x as (select episode_id, t, event_id, g, list({{'t': t, 'g': g}}) over (partition by episode_id order by t rows between 12 preceding and current row) as seen from frames)
  select event_id, coalesce(greatest(seen[1].t, list_min(list_transform(list_filter(seen, lambda s: abs(s.g - seen[1].g) > 0.05), lambda s: s.t)) - 1), t) as start_t from x""")
def w20(spark, sf):
    return frames(spark, sf).select("event_id", keyframes.motion_start(F.col("g"), F.col("t"), 12, EP).alias("start_t"))


@query("op_w21_near_interaction", f"""with {FRAMES} select event_id, coalesce(max((event_type = 'purchase')::int) over (partition by episode_id order by t rows between 2 preceding and 2 following), 0) = 1 as near from frames""")
def w21(spark, sf):
    return frames(spark, sf).select("event_id", windows.near_flag(F.col("event_type") == "purchase", 2, EP).alias("near"))


@query("op_w22_segments", f"""with recursive {FRAMES}, n as (select episode_id, count(*) as n from frames group by 1),
  c as (select f.episode_id, f.t, row_number() over (partition by f.episode_id order by f.t) as i, n.n from frames f join n using (episode_id) where f.event_type = 'signup' and f.t > 0 and f.t < n.n),
  s as (select episode_id, 0::bigint as i, n, [0::bigint] as p from n union all
    select c.episode_id, c.i, c.n, case when c.t - p[-1] >= 6 then list_append(p, c.t) else p end from s join c on c.episode_id = s.episode_id and c.i = s.i + 1),
  l as (select episode_id, n, p from s where (episode_id, i) in (select episode_id, max(i) from s group by 1)),
  f as (select episode_id, n, case when len(p) > 1 and n - p[-1] < 6 then p[:-2] else p end as p from l)
  select episode_id, p[k]::int as start, coalesce(p[k + 1], n)::int as "end" from (select *, unnest(range(1, len(p) + 1)) as k from f)""")
def w22(spark, sf):
    cuts = F.collect_list(F.when(F.col("event_type") == "signup", F.col("t")))
    found = frames(spark, sf).groupBy("episode_id").agg(folds.segments(cuts, F.count(F.lit(1))).alias("s"))
    return found.select("episode_id", F.explode("s").alias("s")).select("episode_id", "s.start", "s.end")


@query("op_w23_tiling", f"""with {FRAMES}, r as (select episode_id, t, t + (event_id % 3) as e, lead(t) over (partition by episode_id order by t) as nt from frames)
  select episode_id, sum((e > nt)::int)::bigint as overlaps, sum((e = nt)::int)::bigint as tiled, count(nt) as boundaries from r group by 1""")
def w23(spark, sf):
    rows = frames(spark, sf).withColumn("e", F.col("t") + F.col("event_id") % 3).withColumn("nt", F.lead("t").over(EP.ordered))
    return rows.groupBy("episode_id").agg(F.count_if(F.col("e") > F.col("nt")).alias("overlaps"), F.count_if(F.col("e") == F.col("nt")).alias("tiled"), F.count("nt").alias("boundaries"))


@query("op_w24_recoveries", f"""with {FRAMES}, x as (select episode_id, t, event_type <> 'error' as good, lag(event_type <> 'error') over (partition by episode_id order by t) as before from frames)
  select episode_id, count_if(good and not before)::bigint as recoveries, coalesce(min(t) filter (where not good), -1) as first_bad from x group by 1""")
def w24(spark, sf):
    good = F.col("event_type") != "error"
    rows = frames(spark, sf).withColumn("good", good).withColumn("before", F.lag("good").over(EP.ordered))
    return rows.groupBy("episode_id").agg(F.count_if(F.col("good") & ~F.col("before")).alias("recoveries"), F.coalesce(F.min(F.when(~F.col("good"), F.col("t"))), F.lit(-1)).alias("first_bad"))


@query("op_w25_lanes", f"""with recursive {FRAMES}, o as (select episode_id, event_id, t as s, t + 1 + event_id % 5 as e, row_number() over (partition by episode_id order by t, t + 1 + event_id % 5, event_id) as i from frames),
  l as (select episode_id, 0::bigint as i, []::bigint[] as ends, -1::bigint as event_id, -1::bigint as lane from (select distinct episode_id from frames) union all
    select o.episode_id, o.i, case when p > 0 then list_concat(list_append(ends[1:p - 1], o.e), ends[p + 1:]) else list_append(ends, o.e) end, o.event_id, case when p > 0 then p - 1 else len(ends) end
    from l join o on o.episode_id = l.episode_id and o.i = l.i + 1, lateral (select coalesce(list_position(list_transform(l.ends, lambda x: x <= o.s), true), 0) as p) as q)
  select event_id, lane::int as lane from l where i > 0""")
def w25(spark, sf):
    rows = frames(spark, sf).select("episode_id", "event_id", F.col("t").alias("start"), (F.col("t") + 1 + F.col("event_id") % 5).cast("int").alias("end"))
    packed = rows.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "event_id"))).alias("i")).withColumn("lane", folds.lanes(F.col("i")))
    return packed.select(F.explode(F.arrays_zip("i", "lane")).alias("z")).select("z.i.event_id", "z.lane")


@query("op_w26_even_frames", f"""with {FRAMES}, n as (select *, count(*) over (partition by episode_id) as n from frames)
  select episode_id, event_id from n where t in (select floor(i * (n - 1) / 7.0::double)::bigint from range(0, 8) q(i))""")
def w26(spark, sf):
    return windows.evenly_spaced(frames(spark, sf), 8, EP).select("episode_id", "event_id")


@query("op_w27_episode_digest", f"""with {FRAMES}, n as (select *, count(*) over (partition by episode_id) as n from frames)
  select episode_id, md5(string_agg(event_id::varchar, ',' order by t)) as digest from n where t < 8 or t >= n - 8 group by 1""")
def w27(spark, sf):
    return windows.trajectory_digest(frames(spark, sf), "event_id", EP, 8)


@query("op_w28_fallback_text", f"""with {FRAMES}, f as (select *, first_value(case when event_type = 'view' then '' else event_type end) over (partition by episode_id order by t) as said from frames)
  select event_id, case when length(trim(said)) > 0 then said else ([{', '.join(f"'{x}'" for x in FALLBACKS)}])[1 + (('0x' || substr(md5('fill' || episode_id::varchar), 1, 8))::ubigint % 18)::int] end as instruction from f""")
def w28(spark, sf):
    said = F.first(F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))).over(EP.ordered)
    fallback = hashing.choose("fill", F.col("episode_id"), F.array(*[F.lit(x) for x in FALLBACKS]))
    rows = frames(spark, sf).withColumn("said", said)
    return rows.select("event_id", F.when(F.length(F.trim("said")) > 0, F.col("said")).otherwise(fallback).alias("instruction"))


def _a8_sql() -> str:
    from tidemark.plans.geometry_queries import RPY, E, X, angles, fixed_axes, named, product, shown, stage

    unit = [1.0 if k in (0, 4, 8) else 0.0 for k in range(9)]
    later = ", ".join(f"coalesce(lead(r{k}, {j}) over (partition by episode_id order by t), {unit[k]}::double) as p{j}_{k}" for j in (1, 2, 3) for k in range(9))
    step = lambda left, j: product(named(range(9), left), [X(f"p{j}_{k}") for k in range(9)])
    stages = f"{stage('poses', 'm', r=fixed_axes(E[4], E[5], E[6]))}, n as (select *, {later} from m), {stage('n', 'x', a=step('r', 1))}, {stage('x', 'y', b=step('a', 2))}, {stage('y', 'z', c=step('b', 3))}"
    return f"with {POSES}, {stages} select vec_id, {shown(angles(named(range(9), 'c')), RPY)} from z"


@query("op_a8_ordered_product", _a8_sql())
def a8(spark, sf):
    from tidemark.functions import rot

    turn = rot.as_array(rot.euler_to_matrix([F.col(c) for c in ("e4", "e5", "e6")]))
    rows = poses(spark, sf).withColumn("m", turn).withColumn("w", F.collect_list("m").over(EP.around(0, 3)))
    euler = rot.matrix_to_euler(rot.unpack(F.col("p"), 0, 9))
    return rows.withColumn("p", folds.ordered_product(F.col("w"))).select("vec_id", *[rounded(e).alias(n) for n, e in zip(("roll", "pitch", "yaw"), euler, strict=True)])


@query("op_p12_flatten", "select conv_id, turn, role, length(text) as n_chars from conversations where text is not null")
def p12(spark, sf):
    rows = read(spark, sf, "conversations").where("text is not null")
    nested = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").cast("bigint").alias("n_chars")))).alias("steps"))
    return nested.select("conv_id", F.explode("steps").alias("s")).select("conv_id", "s.turn", "s.role", "s.n_chars")
