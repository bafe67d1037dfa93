"""Lookups, ranges, bands, as-of, nearest and entity matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import joins, windows
from tidemark.plans.registry import EP, FRAMES, frames, query
from tidemark.plans.registry import table as read

_INT = "ints as (select episode_id, t from frames where event_type = 'purchase')"


def _phases(spark, sf):
    found = windows.runs(frames(spark, sf), "event_type", EP)
    return found.select("episode_id", "run", F.col("event_type").alias("phase"), F.col("start") * 2, F.col("end") * 2 - 1).toDF("episode_id", "run", "phase", "start", "end")


_PHASES = """o as (select *, coalesce((lag(event_type) over (partition by episode_id order by t) <> event_type)::int, 1) as opens from frames),
  rr as (select *, sum(opens) over (partition by episode_id order by t rows between unbounded preceding and current row)::bigint as run from o),
  phases as (select episode_id, run, min(event_type) as phase, min(t) * 2 as start, (max(t) + 1) * 2 - 1 as "end" from rr group by 1, 2)"""


@query("op_j1_lookup", "select d.doc_id, coalesce(l.quality, -1) as quality from documents d left join labels l using (doc_id)")
def j1(spark, sf):
    return joins.lookup(read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels"), "doc_id", "quality", -1)


@query("op_j2_keep_ranges", f"""with {FRAMES}, k as (select episode_id, t as start, t + 3 as "end" from frames where event_type = 'signup')
  select f.event_id from frames f where exists (select 1 from k where k.episode_id = f.episode_id and f.t >= k.start and f.t < k."end")""")
def j2(spark, sf):
    rows = frames(spark, sf)
    ranges = rows.where("event_type = 'signup'").select("episode_id", F.col("t").alias("start"), (F.col("t") + 3).alias("end"))
    return joins.keep_ranges(rows, ranges, "episode_id", "t").select("event_id")


@query("op_j3_instructions", """with i as (select conv_id, list(text order by turn) filter (where role = 'user' and length(trim(text)) > 0) as texts from conversations group by 1)
  select conv_id, len(texts) as n, texts[1] as first_text from i where len(texts) > 0""")
def j3(spark, sf):
    rows = read(spark, sf, "conversations")
    said = F.when((F.col("role") == "user") & (F.length(F.trim("text")) > 0), F.struct("turn", "text"))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("said")).where(F.size("said") > 0)
    return lists.select("conv_id", F.size("said").cast("bigint").alias("n"), F.get("said", F.lit(0))["text"].alias("first_text"))


@query("op_j5_match_entities", """with r as (select n_nationkey, n_regionkey as k, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as i, count(*) over (partition by n_regionkey) as n from nation)
  select c.c_custkey, r.n_nationkey as matched from customer c join r on r.k = c.c_nationkey % 5 and r.i = c.c_custkey % r.n""")
def j5(spark, sf):
    left = read(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("k"))
    right = read(spark, sf, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("matched"))
    return joins.match_entities(left, right, ["k"], "c_custkey", "matched").select("c_custkey", "matched")


@query("op_j6_composite_key", r"""select page_id, concat_ws('::', regexp_extract(url, '^https?://([^/]+)', 1), regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '[?#].*$', '')) as key from pages""")
def j6(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]+/", ""), r"[?#].*$", "")
    return read(spark, sf, "pages").select("page_id", joins.composite_key(F.regexp_extract("url", r"^https?://([^/]+)", 1), path).alias("key"))


@query("op_j7_semi_keys", "select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 45)")
def j7(spark, sf):
    marked = read(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf, "orders").select("o_orderkey").join(marked, "o_orderkey", "left_semi")


@query("op_j8_appended_objects", """with o as (select l_orderkey, string_agg(l_linenumber::varchar || ':' || l_returnflag, ';' order by l_linenumber, l_linenumber::varchar || ':' || l_returnflag) as objects from lineitem group by 1)
  select o_orderkey, coalesce(objects, '') as objects from orders left join o on l_orderkey = o_orderkey""")
def j8(spark, sf):
    one = F.struct("l_linenumber", F.concat(F.col("l_linenumber").cast("string"), F.lit(":"), F.col("l_returnflag")).alias("s"))
    held = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]), ";")
    objects = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(held.alias("objects"))
    return joins.lookup(read(spark, sf, "orders").select("o_orderkey"), objects, "o_orderkey", "objects", "")


@query("op_j9_first_interval", f"""with {FRAMES}, {_PHASES}, m as (select f.event_id, p.run, p.phase, row_number() over (partition by f.event_id order by p.run nulls last) as i
  from frames f left join phases p on p.episode_id = f.episode_id and f.t >= p.start and f.t < p."end") select event_id, run, phase from m where i = 1""")
def j9(spark, sf):
    return joins.first_interval(frames(spark, sf), _phases(spark, sf), "episode_id", "t", "run").select("event_id", "run", "phase")


@query("op_j10_near_edges", f"""with {FRAMES}, {_PHASES} select f.event_id from frames f where exists (select 1 from phases p where p.episode_id = f.episode_id and p.run % 4 = 0
  and (abs(f.t - p.start) <= 1 or abs(f.t - p."end") <= 1))""")
def j10(spark, sf):
    return joins.near_edges(frames(spark, sf), _phases(spark, sf).where("run % 4 = 0"), "episode_id", "t", 1).select("event_id")


@query("op_j11_asof_backward", f"""with {FRAMES}, k as (select episode_id, t, event_id as k from frames where event_type = 'purchase')
  select f.event_id, k.k as mark from frames f asof left join k on f.episode_id = k.episode_id and f.t >= k.t""")
def j11(spark, sf):
    rows = frames(spark, sf)
    marks = rows.where("event_type = 'purchase'").select("episode_id", "t", F.col("event_id").alias("mark"))
    return joins.asof(rows.select("episode_id", "t", "event_id"), marks, "episode_id", "t", "mark").select("event_id", "mark")


@query("op_j12_asof_forward", f"""with {FRAMES}, k as (select episode_id, t, event_id as k from frames where event_type = 'purchase')
  select f.event_id, k.k as mark from frames f asof left join k on f.episode_id = k.episode_id and f.t < k.t""")
def j12(spark, sf):
    rows = frames(spark, sf)
    marks = rows.where("event_type = 'purchase'").select("episode_id", "t", F.col("event_id").alias("mark"))
    return joins.asof(rows.select("episode_id", "t", "event_id"), marks, "episode_id", "t", "mark", forward=True).select("event_id", "mark")


@query("op_j13_contained_events", f"""with {FRAMES}, e as (select episode_id, t, lead(t) over (partition by episode_id order by t) as n from frames where event_type = 'purchase')
  select e.episode_id, e.t, count(f.t) as n, coalesce(string_agg(f.t::varchar, ',' order by f.t), '') as inside from e left join frames f on f.episode_id = e.episode_id and f.event_type = 'error' and f.t > e.t and f.t < e.n
  where e.n is not null group by 1, 2""")
def j13(spark, sf):
    rows = frames(spark, sf)
    spans = rows.where("event_type = 'purchase'").select("episode_id", "t", F.lead("t").over(EP.ordered).alias("until")).where("until is not null")
    errors = rows.where("event_type = 'error'").select("episode_id", F.col("t").alias("at"))
    met = spans.join(errors, (spans.episode_id == errors.episode_id) & (F.col("at") > F.col("t")) & (F.col("at") < F.col("until")), "left")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda x: x.cast("string")), ",")
    return met.groupBy(spans.episode_id, "t").agg(F.count("at").alias("n"), listed.alias("inside"))


@query("op_j14_nearest", f"""with {FRAMES}, {_INT}, c as (select f.event_id, i.t as k, row_number() over (partition by f.event_id order by abs(i.t - f.t), i.t) as r from frames f join ints i on i.episode_id = f.episode_id)
  select f.event_id, c.k as nearest_at from frames f left join c on c.event_id = f.event_id and c.r = 1""")
def j14(spark, sf):
    rows = frames(spark, sf)
    return joins.nearest(rows.select("episode_id", "t", "event_id"), rows.where("event_type = 'purchase'"), "episode_id", "t").select("event_id", "nearest_at")


@query("op_j15_gap_target", f"""with {FRAMES}, x as (select f.event_id, f.t, (select max(i.t) from frames i where i.episode_id = f.episode_id and i.event_type = 'purchase' and i.t <= f.t) as b,
  (select min(i.t) from frames i where i.episode_id = f.episode_id and i.event_type = 'purchase' and i.t > f.t) as n from frames f)
  select event_id, case when b is not null and t - b <= 2 then b else n end as target from x""")
def j15(spark, sf):
    rows = frames(spark, sf)
    marks = rows.where("event_type = 'purchase'").select("episode_id", "t", F.col("t").alias("b"))
    both = joins.asof(joins.asof(rows.select("episode_id", "t", "event_id"), marks, "episode_id", "t", "b"), marks.withColumnRenamed("b", "n"), "episode_id", "t", "n", forward=True)
    return both.select("event_id", F.when(F.col("t") - F.col("b") <= 2, F.col("b")).otherwise(F.col("n")).alias("target"))


@query("op_j16_not_done", "select doc_id from documents where doc_id not in (select doc_id from labels where quality = 1)")
def j16(spark, sf):
    return joins.not_done(read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels").where("quality = 1"), "doc_id")


@query("op_j17_local_state", """with s as (select l_orderkey, string_agg(distinct l_linestatus, ',' order by l_linestatus) as states from lineitem group by 1)
  select o_orderkey, case when states is null then 'missing' when states = 'F' then 'prunable' when states like '%O%' and states like '%F%' then 'mixed' else 'open' end as local_state from orders left join s on l_orderkey = o_orderkey""")
def j17(spark, sf):
    states = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set("l_linestatus")).alias("s"))
    s = F.col("s")
    name = F.when(s.isNull(), "missing").when(s == F.array(F.lit("F")), "prunable").when(F.size(s) == 2, "mixed").otherwise("open")
    return read(spark, sf, "orders").select("o_orderkey").join(states, "o_orderkey", "left").select("o_orderkey", name.alias("local_state"))


@query("op_j18_first_containing", """with p(s, p) as (values ('BRASS', 2), ('STEEL', 1), ('COPPER', 3), ('A', 9), ('E', 8)),
  m as (select p_partkey, s, row_number() over (partition by p_partkey order by (s = upper(p_name)) desc, p) as r from part join p on contains(upper(p_name), s))
  select p.p_partkey, m.s as matched from part p left join m on m.p_partkey = p.p_partkey and m.r = 1""")
def j18(spark, sf):
    patterns = spark.createDataFrame([("BRASS", 2), ("STEEL", 1), ("COPPER", 3), ("A", 9), ("E", 8)], "s string, p int")
    parts = read(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("name"))
    return joins.first_containing(parts, patterns, "name", "s", "p").select("p_partkey", "matched")


@query("op_j19_positions", """with a as (select conv_id, row_number() over (partition by conv_id order by turn) as i from conversations where role = 'user'),
  b as (select conv_id, row_number() over (partition by conv_id order by turn) as i from conversations where role = 'assistant')
  select conv_id, i, case when a.i is not null and b.i is not null then 'both' when b.i is null then 'left' else 'right' end as side from a full join b using (conv_id, i)""")
def j19(spark, sf):
    rows = read(spark, sf, "conversations")
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("bigint").alias("i")
    side = lambda role: rows.where(F.col("role") == role).select("conv_id", at)
    return joins.positions(side("user"), side("assistant"), "conv_id", "i")


@query("op_j20_metadata", "select n.n_name, r.r_name, count(c.c_custkey) as customers from nation n left join region r on r.r_regionkey = n.n_regionkey left join customer c on c.c_nationkey = n.n_nationkey group by 1, 2")
def j20(spark, sf):
    named = joins.lookup(read(spark, sf, "nation").withColumnRenamed("n_regionkey", "r_regionkey"), read(spark, sf, "region"), "r_regionkey", "r_name")
    counts = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    return joins.lookup(named, counts, "n_nationkey", "customers", 0).select("n_name", "r_name", "customers")


@query("op_u2_merge_insert", "select o_orderkey, 'old' as source from orders where o_orderkey % 3 = 0 union all select o_orderkey, 'new' from orders where o_orderkey % 2 = 0 and o_orderkey % 3 <> 0")
def u2(spark, sf):
    keys = read(spark, sf, "orders").select("o_orderkey")
    return joins.merge_insert(keys.where("o_orderkey % 3 = 0").withColumn("source", F.lit("old")), keys.where("o_orderkey % 2 = 0").withColumn("source", F.lit("new")), "o_orderkey")


@query("op_a22_match_counts", """select count(*) as n_total, count(l.doc_id) as n_matched, count(*) - count(l.doc_id) as n_unmatched from documents d left join labels l using (doc_id)""")
def a22(spark, sf):
    found = joins.lookup(read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels").select("doc_id", F.lit(1).alias("m")), "doc_id", "m")
    return found.agg(F.count(F.lit(1)).alias("n_total"), F.count("m").alias("n_matched"), (F.count(F.lit(1)) - F.count("m")).alias("n_unmatched"))
