"""Statistics, mixtures, selection and filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import hashing, scaling, vec
from tidemark.operators import mixture, stats, work_queue
from tidemark.plans.registry import EP, FRAMES, POSES, frames, poses, query, rounded
from tidemark.plans.registry import table as read

_WIDE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG = "long as (" + " union all ".join(f"select '{c}' as dim, l_returnflag as ds, {c}::double as x from lineitem" for c in _WIDE) + ")"


def _long(spark, sf):
    return stats.by_dimension(read(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "ds"), _WIDE, ["ds"])


def _h(salt: str, key: str) -> str:
    return f"('0x' || substr(md5('{salt}' || {key}::varchar), 1, 8))::ubigint"


@query("op_a1_moments", f"with {_LONG} select dim, count(*) as n, min(x) as lo, max(x) as hi, round(avg(x), 4) as mean, round(stddev_pop(x), 4) as std from long group by 1")
def a1(spark, sf):
    m = stats.moments(_long(spark, sf), ["dim"])
    return m.select("dim", "n", "lo", "hi", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


_QUANTILES = """e as (select {k}, min(x) as lo, max(x) as hi, count(*) as total from long group by {k}),
  b as (select l.{k}, lo, hi, total, case when hi > lo then least(floor((x - lo) / (hi - lo) * 4096), 4095) else 0 end as bin from long l join e using ({k})),
  c as (select {k}, lo, hi, total, bin, count(*) as n from b group by all),
  r as (select *, sum(n) over (partition by {k} order by bin rows between unbounded preceding and current row) as cum from c),
  quant as (select {k}, q, min(lo + bin * (hi - lo) / 4096) as value from r, (values (0.01::double), (0.5::double), (0.99::double)) v(q) where cum >= q * total group by 1, 2)"""


@query("op_a2_histogram_quantiles", f"with {_LONG}, {_QUANTILES.format(k='dim')} select dim, q, round(value, 6) as value from quant")
def a2(spark, sf):
    found = stats.histogram_quantiles(_long(spark, sf), ["dim"], [0.01, 0.5, 0.99])
    return found.select("dim", "q", F.round("value", 6).alias("value"))


@query("op_a4_counts", "select count(*) as transitions, count(distinct user_id) as trajectories from events")
def a4(spark, sf):
    return read(spark, sf, "events").agg(F.count(F.lit(1)).alias("transitions"), F.countDistinct("user_id").alias("trajectories"))


@query("op_a5_merged_stats", f"""with {_LONG}, s as (select ds, dim, count(*) as n, avg(x) as mean, stddev_pop(x) as std, min(x) as lo, max(x) as hi, min(x) + 1 as q01, max(x) - 1 as q99 from long group by 1, 2)
  select dim, sum(n)::bigint as n, round(sum(n * mean) / sum(n), 4) as mean, round(sqrt(greatest(sum(n * (std * std + mean * mean)) / sum(n) - pow(sum(n * mean) / sum(n), 2), 0)), 4) as std,
  min(q01) as q01, max(q99) as q99, min(lo) as lo, max(hi) as hi from s group by 1""")
def a5(spark, sf):
    parts = stats.moments(_long(spark, sf), ["ds", "dim"]).withColumn("q01", F.col("lo") + 1).withColumn("q99", F.col("hi") - 1)
    m = stats.merged(parts, ["dim"])
    return m.select("dim", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "q01", "q99", "lo", "hi")


@query("op_a6_by_type", "select label as state_type, count(*) as n, round(avg(embedding[1]::double), 6) as mean from embeddings where label <> 0 group by 1")
def a6(spark, sf):
    first = F.get("embedding", F.lit(0)).cast("double").alias("x")
    m = stats.moments(read(spark, sf, "embeddings").where("label <> 0").select(F.col("label").alias("state_type"), first), ["state_type"])
    return m.select("state_type", "n", F.round("mean", 6).alias("mean"))


@query("op_a7_dummy_stats", "select i::int as dim, 0.0::double as mean, 1.0::double as std, -1.0::double as q01, 1.0::double as q99 from range(0, 7) r(i)")
def a7(spark, sf):
    values = [F.lit(v).alias(n) for n, v in (("mean", 0.0), ("std", 1.0), ("q01", -1.0), ("q99", 1.0))]
    return spark.range(7).select(F.col("id").cast("int").alias("dim"), *values)


@query("op_a9_cardinality", "select count(*) as n from documents")
def a9(spark, sf):
    return read(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"))


@query("op_a10_reject_counts", "select event_type, count_if(value < 10)::bigint as too_small, count_if(value > 100)::bigint as too_large, count_if(value between 10 and 100)::bigint as kept from events group by 1")
def a10(spark, sf):
    v = F.col("value")
    return read(spark, sf, "events").groupBy("event_type").agg(F.count_if(v < 10).alias("too_small"), F.count_if(v > 100).alias("too_large"), F.count_if(v.between(10, 100)).alias("kept"))


@query("op_a11_cross_counts", "select coalesce(o_orderstatus, '*') as status, coalesce(o_orderpriority, '*') as priority, count(*) as n from orders group by grouping sets ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())")
def a11(spark, sf):
    sets = read(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return sets.select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n")


@query("op_a12_token_histogram", "with w as (select unnest(string_split('p:' || lower(p_type) || ',' || p_brand, ',')) as w from part) select list_last(string_split(trim(w), ':')) as token, count(*) as n from w where trim(w) <> '' group by 1")
def a12(spark, sf):
    rows = read(spark, sf, "part").select(F.concat(F.lit("p:"), F.lower("p_type"), F.lit(","), F.col("p_brand")).alias("w"))
    return stats.token_histogram(rows.withColumnRenamed("w", "issues"), "issues")


@query("op_a13_audit_summary", "select count(*) as rows_n, count_if(text <> '')::bigint as non_empty, round(avg(length(text)), 4) as mean_chars, round(avg((role = 'user')::int), 6) as user_share from conversations")
def a13(spark, sf):
    return read(spark, sf, "conversations").agg(
        F.count(F.lit(1)).alias("rows_n"), F.count_if(F.col("text") != "").alias("non_empty"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"),
        F.round(F.avg((F.col("role") == "user").cast("int")), 6).alias("user_share"),
    )


@query("op_a14_first_seen_counts", f"with {FRAMES}, c as (select episode_id, event_type, min(t) as pos, count(*) as n from frames group by 1, 2) select episode_id, string_agg(event_type || '×' || n::varchar, ',' order by pos) as counted from c group by 1")
def a14(spark, sf):
    return stats.first_seen_counts(frames(spark, sf), ["episode_id"], "event_type", "t")


@query("op_a15_shares", "select lang, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 6) as percent from documents group by 1")
def a15(spark, sf):
    return stats.shares(read(spark, sf, "documents"), "lang").select("lang", "n", F.round("percent", 6).alias("percent"))


@query("op_a16_distance_means", f"with {POSES} select episode_id, round(avg(sqrt(e1*e1 + e2*e2)), 6) as mean_distance, round(avg((abs(e1) <= 0.1 and abs(e2) <= 0.1)::int), 6) as inside, round(avg(e3) filter (where e3 > 0), 6) as mean_depth from poses group by 1")
def a16(spark, sf):
    e1, e2, e3 = (F.col(f"e{k}") for k in (1, 2, 3))
    inside = ((F.abs(e1) <= 0.1) & (F.abs(e2) <= 0.1)).cast("int")
    return poses(spark, sf).groupBy("episode_id").agg(F.round(F.avg(F.sqrt(e1 * e1 + e2 * e2)), 6).alias("mean_distance"), F.round(F.avg(inside), 6).alias("inside"), F.round(F.avg(F.when(e3 > 0, e3)), 6).alias("mean_depth"))


@query("op_a17_masked_means", "select user_id, round(coalesce(sum(value) filter (where event_type = 'purchase'), 0) / greatest(count_if(event_type = 'purchase'), 1), 6) as loss from events group by 1")
def a17(spark, sf):
    return read(spark, sf, "events").groupBy("user_id").agg(F.round(stats.masked_mean(F.col("value"), F.col("event_type") == "purchase"), 6).alias("loss"))


@query("op_a18_metric_reduce", "select event_type as metric, round(case when event_type = 'error' then max(value) else avg(value) end, 6) as value from events where event_type <> 'signup' group by 1")
def a18(spark, sf):
    kept = read(spark, sf, "events").where("event_type <> 'signup'").groupBy(F.col("event_type").alias("metric")).agg(F.max("value").alias("hi"), F.avg("value").alias("mean"))
    return kept.select("metric", F.round(F.when(F.col("metric") == "error", F.col("hi")).otherwise(F.col("mean")), 6).alias("value"))


@query("op_a19_active_arm", f"with {POSES} select episode_id, case when max(e8) - min(e8) >= max(e7) - min(e7) then 'right' else 'left' end as arm from poses group by 1")
def a19(spark, sf):
    span = lambda c: F.max(c) - F.min(c)
    return poses(spark, sf).groupBy("episode_id").agg(F.when(span("e8") >= span("e7"), "right").otherwise("left").alias("arm"))


@query("op_a20_success_rates", "select coalesce(l_returnflag, 'total') as task, count(*) as n, round(avg((l_linestatus = 'F')::int), 6) as rate from lineitem group by rollup (l_returnflag)")
def a20(spark, sf):
    rates = read(spark, sf, "lineitem").rollup("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("l_linestatus") == "F").cast("int")), 6).alias("rate"))
    return rates.select(F.coalesce("l_returnflag", F.lit("total")).alias("task"), "n", "rate")


@query("op_a21_vocabulary_rate", r"select conv_id, round(count_if(regexp_matches(lower(text), '\b(the|of|and)\b')) / count(*), 6) as rate from conversations where role = 'assistant' group by 1")
def a21(spark, sf):
    hit = F.count_if(F.lower("text").rlike(r"\b(the|of|and)\b"))
    return read(spark, sf, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.round(hit / F.count(F.lit(1)), 6).alias("rate"))


@query("op_a23_distinct_ordered", f"with {FRAMES}, c as (select episode_id, event_type, min(t) as pos from frames group by 1, 2) select episode_id, string_agg(event_type, ' > ' order by pos) as kinds from c group by 1")
def a23(spark, sf):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("t", "event_type"))), lambda s: s["event_type"])
    return frames(spark, sf).groupBy("episode_id").agg(F.array_join(F.array_distinct(listed), " > ").alias("kinds"))


@query("op_a24_summary", f"with {_LONG} select dim, count(*) as n, min(x) as lo, quantile_cont(x, 0.25::double) as q25, quantile_cont(x, 0.5::double) as q50, quantile_cont(x, 0.75::double) as q75, max(x) as hi from long group by 1")
def a24(spark, sf):
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = _long(spark, sf).groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), q.alias("q"), F.max("x").alias("hi"))
    return found.select("dim", "n", "lo", *[F.get("q", F.lit(k)).alias(f"q{(k + 1) * 25}") for k in range(3)], "hi")


@query("op_t1_take", "select event_id from events order by ts, event_id limit 100")
def t1(spark, sf):
    return read(spark, sf, "events").orderBy("ts", "event_id").select("event_id").limit(100)


@query("op_t2_shuffle_place", f"select doc_id, round(({_h('shuffle', 'doc_id')} / 4294967296.0)::double, 9) as place from documents")
def t2(spark, sf):
    return mixture.shuffled(read(spark, sf, "documents"), "doc_id").select("doc_id", F.round(hashing.uniform("shuffle", F.col("doc_id")), 9).alias("place"))


@query("op_t3_epochs", "select epoch, count(*) as n, sum(doc_id)::bigint as total from labels, range(0, 3) r(epoch) group by 1")
def t3(spark, sf):
    rows = mixture.epochs(read(spark, sf, "labels"), 3)
    return rows.groupBy(F.col("epoch").cast("bigint").alias("epoch")).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("total"))


_WEIGHTS = [("en", 0.4), ("fr", 0.3), ("de", 0.2), ("es", 0.1)]
_W = "w(lang, weight) as (values ('en', 0.4::double), ('fr', 0.3::double), ('de', 0.2::double), ('es', 0.1::double))"


@query("op_t4_weighted_mixture", f"""with {_W}, q as (select lang, round_even(weight / sum(weight) over () * 200, 0)::bigint as quota from w),
  r as (select d.doc_id, d.lang, q.quota, row_number() over (partition by d.lang order by {_h('mix', 'd.doc_id')}, d.doc_id) as i from documents d join q using (lang)) select doc_id, lang from r where i <= quota""")
def t4(spark, sf):
    weights = spark.createDataFrame(_WEIGHTS, "lang string, weight double")
    rows = read(spark, sf, "documents").select("doc_id", "lang")
    return mixture.quota_sample(rows, weights, "lang", "doc_id", 200)


@query("op_t5_renormalised_weights", f"with {_W}, p as (select lang, count(*) as n from documents where lang <> 'es' group by 1) select lang, round(weight / sum(weight) over (), 6) as share from w join p using (lang)")
def t5(spark, sf):
    present = read(spark, sf, "documents").where("lang <> 'es'").select("lang").distinct()
    weights = spark.createDataFrame(_WEIGHTS, "lang string, weight double").join(present, "lang")
    return weights.select("lang", F.round(F.col("weight") / F.sum("weight").over(Window.partitionBy()), 6).alias("share"))


@query("op_t6_slot_allocation", """with s as (select source, count(*)::double as weight from documents group by 1), e as (select *, weight / sum(weight) over () * 64 as e from s),
  f as (select *, greatest(floor(e), 1)::bigint as f from e), r as (select *, 64 - sum(f) over () as spare, row_number() over (order by e - floor(e) desc, source) as i from f)
  select source, (f + (i <= spare)::int)::bigint as slots from r""")
def t6(spark, sf):
    weights = read(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return mixture.allocation(weights, "source", 64)


@query("op_t7_fair_selection", f"with r as (select doc_id, source, row_number() over (partition by source order by {_h('fair', 'doc_id')}, doc_id) as turn from documents) select doc_id, source, turn::int as turn from r where turn <= 3")
def t7(spark, sf):
    return mixture.fair_order(read(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id").where("turn <= 3")


@query("op_t8_sample_elements", """with w as (select doc_id, unnest(list_distinct(string_split(lower(text), ' '))) as x from documents),
  r as (select *, row_number() over (partition by doc_id order by md5(doc_id::varchar || x)) as i from w) select doc_id, string_agg(x, '|' order by i) as words from r where i <= 3 group by 1""")
def t8(spark, sf):
    words = F.array_distinct(F.split(F.lower("text"), " "))
    return read(spark, sf, "documents").select("doc_id", F.array_join(mixture.sample_elements(words, 3, F.col("doc_id").cast("string")), "|").alias("words"))


@query("op_t9_sorted_points", f"with {POSES}, p as (select vec_id, list_sort([round(e1 * 100)::int * 10000 + round(e2 * 100)::int, round(e3 * 100)::int * 10000 + round(e4 * 100)::int, round(e5 * 100)::int * 10000 + round(e6 * 100)::int]) as s from poses) select vec_id, s[1] as a, s[2] as b, s[3] as c from p")
def t9(spark, sf):
    key = lambda a, b: F.round(F.col(a) * 100).cast("int") * 10000 + F.round(F.col(b) * 100).cast("int")
    rows = poses(spark, sf).withColumn("s", F.array_sort(F.array(key("e1", "e2"), key("e3", "e4"), key("e5", "e6"))))
    return rows.select("vec_id", *[F.get("s", F.lit(k)).alias(n) for k, n in enumerate("abc")])


@query("op_t10_nulls_last_order", "select l.doc_id, row_number() over (order by case when quality = 1 then l.doc_id end nulls last, l.doc_id) as place from labels l")
def t10(spark, sf):
    rows = read(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, F.col("doc_id")).alias("at"))
    return mixture.nulls_last_places(rows, "at", "doc_id").select("doc_id", "place")


@query("op_t11_claim_first", "select o_orderkey from orders where o_orderstatus = 'O' order by o_orderkey limit 25")
def t11(spark, sf):
    return work_queue.claim(read(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), "O", 25, "o_orderkey").select("o_orderkey")


@query("op_t14_weighted_choice", f"with u as (select doc_id, {_h('q', 'doc_id')} / 4294967296.0::double as u from documents) select doc_id, case when u < 0.5 then 'what' when u < 0.8 then 'where' else 'how' end as question from u")
def t14(spark, sf):
    return read(spark, sf, "documents").select("doc_id", hashing.weighted_choice("q", F.col("doc_id"), [("what", 0.5), ("where", 0.3), ("how", 0.2)]).alias("question"))


@query("op_t15_epoch_batches", "select lang, count(*) // 32 as train_batches, floor(count(*) // 32 * 0.8::double)::bigint as val_batches from documents group by 1")
def t15(spark, sf):
    n = F.floor(F.col("n") / 32)
    counted = read(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("lang", n.alias("train_batches"), F.floor(n * F.lit(0.8)).alias("val_batches"))


@query("op_k1_batches", f"""with u as (select doc_id, {_h('b', 'doc_id')} / 4294967296.0::double as u, count(*) over () as n from documents), r as (select doc_id, n, (row_number() over (order by u, doc_id) - 1) // 64 as batch from u)
  select doc_id, batch from r where batch < n // 64""")
def k1(spark, sf):
    return mixture.with_batches(read(spark, sf, "documents").select("doc_id"), hashing.uniform("b", F.col("doc_id")), "doc_id", 64)


@query("op_k8_resume_batches", f"""with u as (select doc_id, {_h('b', 'doc_id')} / 4294967296.0::double as u, count(*) over () as n from documents), r as (select doc_id, n, (row_number() over (order by u, doc_id) - 1) // 64 as batch from u)
  select doc_id, batch from r where batch < n // 64 and batch >= 5""")
def k8(spark, sf):
    return k1(spark, sf).where("batch >= 5")


@query("op_f1_split", f"select doc_id, {_h('7', 'doc_id')} % 1000 < 25 as validation from documents")
def f1(spark, sf):
    return read(spark, sf, "documents").select("doc_id", hashing.in_validation(7, F.col("doc_id"), 0.025).alias("validation"))


@query("op_f2_trajectory_filter", "select page_id from pages where html is not null and regexp_matches(url, 'example') and length(trim(url)) > 10")
def f2(spark, sf):
    return read(spark, sf, "pages").where(F.col("html").isNotNull() & F.col("url").rlike("example") & (F.length(F.trim("url")) > 10)).select("page_id")


@query("op_f3_any_instruction", "select conv_id from conversations group by 1 having count_if(role = 'system' and length(trim(text)) > 0) > 0")
def f3(spark, sf):
    said = F.collect_list(F.when(F.col("role") == "system", F.col("text")))
    return read(spark, sf, "conversations").groupBy("conv_id").agg(said.alias("s")).where(F.exists("s", lambda x: F.length(F.trim(x)) > 0)).select("conv_id")


@query("op_f4_bounded_episodes", f"with {FRAMES} select episode_id from frames group by 1 having max(value) <= 200 and min(value) >= 0")
def f4(spark, sf):
    return frames(spark, sf).groupBy("episode_id").agg(F.max("value").alias("hi"), F.min("value").alias("lo")).where("hi <= 200 and lo >= 0").select("episode_id")


@query("op_f5_non_empty_prompt", "select conv_id, turn from conversations where length(trim(text)) > 0")
def f5(spark, sf):
    return read(spark, sf, "conversations").where(F.length(F.trim("text")) > 0).select("conv_id", "turn")


@query("op_f7_question_and_answer", "select q.conv_id, q.turn from conversations q join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1 where q.role = 'user' and a.role = 'assistant' and length(q.text) > 0 and length(a.text) > 0")
def f7(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf, "conversations").withColumn("a", F.lead(F.struct("turn", "role", "text")).over(w))
    good = (F.col("role") == "user") & (F.col("a.role") == "assistant") & (F.col("a.turn") == F.col("turn") + 1) & (F.length("text") > 0) & (F.length("a.text") > 0)
    return rows.where(good).select("conv_id", "turn")


@query("op_f8_finite_rows", "select vec_id from embeddings where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0")
def f8(spark, sf):
    return read(spark, sf, "embeddings").where(vec.finite(F.col("embedding"))).select("vec_id")


@query("op_f9_safe_prefix", f"with {FRAMES}, b as (select *, min(t) filter (where event_type = 'error') over (partition by episode_id) as safe_end from frames) select event_id from b where t + 2 <= coalesce(safe_end, 1000000)")
def f9(spark, sf):
    end = F.min(F.when(F.col("event_type") == "error", F.col("t"))).over(EP.whole)
    return frames(spark, sf).withColumn("safe_end", end).where(F.col("safe_end").isNull() | (F.col("t") + 2 <= F.col("safe_end"))).select("event_id")


@query("op_f11_drop_repeats", f"with {FRAMES}, x as (select event_id, event_type, value > 50 as high, lag(event_type) over w as k, lag(value > 50) over w as h, t from frames window w as (partition by episode_id order by t)) select event_id from x where t = 0 or k is distinct from event_type or h is distinct from high")
def f11(spark, sf):
    pair = F.struct("event_type", (F.col("value") > 50).alias("high"))
    return frames(spark, sf).withColumn("pair", pair).withColumn("last", F.lag("pair").over(EP.ordered)).where("last is null or last <> pair").select("event_id")


@query("op_f12_required_fields", "select conv_id, turn from conversations where nullif(trim(role), '') is not null and nullif(trim(text), '') is not null")
def f12(spark, sf):
    return read(spark, sf, "conversations").where("nullif(trim(role), '') is not null and nullif(trim(text), '') is not null").select("conv_id", "turn")


@query("op_f14_combined_filter", "select o_orderkey from orders where o_orderstatus in ('O', 'F') and o_orderdate between timestamp '1995-01-01' and timestamp '1996-12-31' and contains(o_orderpriority, 'URGENT')")
def f14(spark, sf):
    rows = read(spark, sf, "orders").where(F.col("o_orderstatus").isin("O", "F") & F.contains(F.col("o_orderpriority"), F.lit("URGENT")))
    return rows.where("o_orderdate between timestamp '1995-01-01' and timestamp '1996-12-31'").select("o_orderkey")


@query("op_f15_classes", "select c_custkey, case when c_acctbal < 0 then 'bad' when c_acctbal < 300 then 'marginal' else 'good' end as class from customer")
def f15(spark, sf):
    b = F.col("c_acctbal")
    return read(spark, sf, "customer").select("c_custkey", F.when(b < 0, "bad").when(b < 300, "marginal").otherwise("good").alias("class"))


@query("op_u1_union", "select 'customer' as kind, c_name as name, c_acctbal as balance, null::double as price from customer union all select 'supplier', s_name, s_acctbal, null from supplier union all select 'part', p_name, null, p_retailprice from part")
def u1(spark, sf):
    a = read(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = read(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = read(spark, sf, "part").select(F.lit("part").alias("kind"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    return a.unionByName(b).unionByName(c, allowMissingColumns=True)


@query("op_u3_difference", "select c_nationkey from customer except all select s_nationkey from supplier")
def u3(spark, sf):
    return read(spark, sf, "customer").select("c_nationkey").exceptAll(read(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey")))


@query("op_u4_shared_numbers", r"select o_orderkey, len(list_intersect(regexp_extract_all(o_orderdate::varchar, '\d+'), regexp_extract_all(o_orderpriority || ' ' || o_orderkey::varchar, '\d+'))) as shared from orders")
def u4(spark, sf):
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"(\d+)"), 1)
    a, b = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.concat(F.col("o_orderpriority"), F.lit(" "), F.col("o_orderkey").cast("string"))
    return read(spark, sf, "orders").select("o_orderkey", F.size(F.array_intersect(numbers(a), numbers(b))).cast("bigint").alias("shared"))


@query("op_e1_uniform", f"select event_id, round(({_h('u', 'event_id')} / 4294967296.0)::double, 9) as u from events")
def e1(spark, sf):
    return read(spark, sf, "events").select("event_id", F.round(hashing.uniform("u", F.col("event_id")), 9).alias("u"))


@query("op_e2_choice", f"select event_id, (['left', 'right', 'top'])[1 + ({_h('cam', 'user_id')} % 3)::int] as camera from events")
def e2(spark, sf):
    return read(spark, sf, "events").select("event_id", hashing.choose("cam", F.col("user_id"), F.array(F.lit("left"), F.lit("right"), F.lit("top"))).alias("camera"))


@query("op_m25_normalise", "with s as (select avg(l_quantity) as m, stddev_pop(l_quantity) as d, min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem) select l_orderkey, l_linenumber, round((l_quantity - m) / (d + 1e-6), 6) + 0.0 as z, round(least(greatest((l_extendedprice - lo) / (hi - lo + 1e-8) * 2 - 1, -1), 1), 6) + 0.0 as b from lineitem, s")
def m25(spark, sf):
    rows = read(spark, sf, "lineitem")
    s = rows.agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("d"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi")).first()
    z = scaling.standardized(F.col("l_quantity"), F.lit(s["m"]), F.lit(s["d"]))
    b = scaling.bounded(F.col("l_extendedprice"), F.lit(s["lo"]), F.lit(s["hi"]))
    return rows.select("l_orderkey", "l_linenumber", rounded(z).alias("z"), rounded(b).alias("b"))


@query("op_m26_unnormalise", "select l_orderkey, l_linenumber, l_quantity::double as z, l_extendedprice::double as b from lineitem")
def m26(spark, sf):
    rows = read(spark, sf, "lineitem")
    m, d, lo, hi = F.lit(25.0), F.lit(14.0), F.lit(0.0), F.lit(200000.0)
    z = scaling.unstandardized(scaling.standardized(F.col("l_quantity"), m, d), m, d)
    b = scaling.unbounded(scaling.bounded(F.col("l_extendedprice"), lo, hi, clip=False), lo, hi)
    return rows.select("l_orderkey", "l_linenumber", F.round(z, 6).alias("z"), F.round(b, 4).alias("b"))


@query("op_m27_rescale", "select event_id, round(least(greatest((value - 10) / (100.0::double - 10) * 3.5::double - 1.75::double, -1.75::double + 0.01), 1.75::double - 0.01), 6) + 0.0 as scaled from events")
def m27(spark, sf):
    return read(spark, sf, "events").select("event_id", rounded(scaling.rescaled(F.col("value"), 10.0, 100.0, -1.75, 1.75, 0.01)).alias("scaled"))


@query("op_m28_invert", f"with {FRAMES} select event_id, 1 - g as g from frames")
def m28(spark, sf):
    return frames(spark, sf).select("event_id", (1 - F.col("g")).alias("g"))


@query("op_m31_noise", f"with u as (select vec_id, embedding[1]::double as x, {_h('na', 'vec_id')} / 4294967296.0::double as a, {_h('nb', 'vec_id')} / 4294967296.0::double as b from embeddings) select vec_id, round(x + 0.01::double * sqrt(-2 * ln(1 - a)) * cos(2 * pi() * b), 6) as x from u")
def m31(spark, sf):
    noisy = F.transform("embedding", lambda x: x.cast("double"))
    return read(spark, sf, "embeddings").select("vec_id", F.round(F.get(noisy, F.lit(0)) + 0.01 * hashing.normal("n", F.col("vec_id")), 6).alias("x"))


@query("op_m33_state_bins", f"with {POSES} select vec_id, (case when e1 * 4 < -1 then -1 else least(floor((e1 * 4 + 1) / 2 * 256), 255) end)::int as bin from poses")
def m33(spark, sf):
    return poses(spark, sf).select("vec_id", scaling.state_bins(F.col("e1") * 4).alias("bin"))


@query("op_p13_pad_or_cut", "select vec_id, round(list_sum(embedding[:32]::double[]), 5) as s, 32::int as n from embeddings")
def p13(spark, sf):
    a = vec.pad_or_cut(F.transform("embedding", lambda x: x.cast("double")), 32)
    return read(spark, sf, "embeddings").select("vec_id", F.round(vec.total(a), 5).alias("s"), F.size(a).alias("n"))


@query("op_p14_pad", "select vec_id, 80::int as n, round(list_sum(embedding::double[]), 5) as s from embeddings")
def p14(spark, sf):
    a = vec.pad(F.transform("embedding", lambda x: x.cast("double")), 80)
    return read(spark, sf, "embeddings").select("vec_id", F.size(a).alias("n"), F.round(vec.total(a), 5).alias("s"))


_STATE = """case when s = 'excluded' and c.c = 'undo' then 'available' when c.c = 'exclude' then 'excluded' when s = 'available' and c.c = 'claim' then 'hint_claimed' when s = 'hint_claimed' and c.c = 'submit' then 'hinted'
  when s = 'hinted' and c.c = 'claim' then 'annot_claimed' when s = 'annot_claimed' and c.c = 'submit' then 'annotated' when s = 'hint_claimed' and c.c = 'release' then 'available' when s = 'annot_claimed' and c.c = 'release' then 'hinted' else s end"""
_COMMANDS = {"click": "claim", "view": "submit", "error": "release", "purchase": "exclude", "signup": "undo"}


@query("op_r5_queue_states", f"""with recursive {FRAMES}, c as (select episode_id, t, case event_type when 'click' then 'claim' when 'view' then 'submit' when 'error' then 'release' when 'purchase' then 'exclude' else 'undo' end as c from frames),
  r as (select episode_id, -1::bigint as t, 'available' as s from (select distinct episode_id from frames) union all select c.episode_id, c.t, {_STATE} from r join c on c.episode_id = r.episode_id and c.t = r.t + 1)
  select r.episode_id, r.s as state, m.n from r join (select episode_id, max(t) as t, count(*) as n from frames group by 1) m using (episode_id, t)""")
def r5(spark, sf):
    command = F.create_map(*[F.lit(x) for kv in _COMMANDS.items() for x in kv])[F.col("event_type")]
    return work_queue.states(frames(spark, sf).withColumn("command", command), "episode_id", ["t"], "command")


@query("op_r7_stale_claims", "select event_id from events where event_type = 'click' and epoch(timestamp '2024-01-30 00:00:00') - floor(epoch(ts)) >= 1000000")
def r7(spark, sf):
    claims = read(spark, sf, "events").where("event_type = 'click'").withColumnRenamed("ts", "claimed_at")
    return work_queue.stale(claims, F.to_timestamp(F.lit("2024-01-30 00:00:00")), 1_000_000).select("event_id")


@query("op_k12_eval_result", "select coalesce(o_orderpriority, 'total') as task, count(*) as episodes, count_if(o_orderstatus = 'F')::bigint as successes from orders group by rollup (o_orderpriority)")
def k12(spark, sf):
    out = read(spark, sf, "orders").rollup("o_orderpriority").agg(F.count(F.lit(1)).alias("episodes"), F.count_if(F.col("o_orderstatus") == "F").alias("successes"))
    return out.select(F.coalesce("o_orderpriority", F.lit("total")).alias("task"), "episodes", "successes")
