"""The rest of the inventory: repacking, media, visual questions, annotation merging, sinks and resumption."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import hashing, media
from tidemark.operators import folds, keyframes, masks, standardize, stats, windows
from tidemark.plans.registry import EP, FRAMES, POSES, frames, poses, query, rounded
from tidemark.plans.registry import table as read
from tidemark.sources import readers, sinks
from tidemark.sources.shared import shared_dir

_H = "('0x' || substr(md5('{0}' || {1}::varchar), 1, 8))::ubigint"


@query("op_s1_scan_pruned", "select user_id as episode_id, count(*) as n from events where event_type = 'click' group by 1")
def s1(spark, sf):
    return readers.episodes(spark, f"{sf}/events.parquet").where("event_type = 'click'").groupBy(F.col("user_id").alias("episode_id")).agg(F.count(F.lit(1)).alias("n"))


@query("op_s16_merge_policies", """with r as (select conv_id, turn, text, case when conv_id % 4 = 0 then 'merged.jsonl' else 'part.jsonl' end as file from conversations)
  select conv_id, count_if(not contains(file, 'merged'))::bigint as skip_merged, count_if(contains(file, 'merged'))::bigint as only_merged from r group by 1""")
def s16(spark, sf):
    file = F.when(F.col("conv_id") % 4 == 0, "merged.jsonl").otherwise("part.jsonl")
    merged = F.contains(file, F.lit("merged"))
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.count_if(~merged).alias("skip_merged"), F.count_if(merged).alias("only_merged"))


@query("op_s21_missing_image", "select doc_id, '' as image from documents")
def s21(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.coalesce(F.lit(None).cast("string"), F.lit("")).alias("image"))


@query("op_k2_stats_round_trip", "select label as dataset, 'state' as field, count(*) as n, round(avg(embedding[1]::double), 6) as mean from embeddings group by 1")
def k2(spark, sf):
    long = read(spark, sf, "embeddings").select(F.col("label").alias("dataset"), F.lit("state_eef_pose").alias("field"), F.get("embedding", F.lit(0)).cast("double").alias("x"))
    path = f"{shared_dir(spark)}/stats-{spark.sparkContext.applicationId}"
    sinks.write_stats(stats.moments(long, ["dataset", "field"]), path)
    return sinks.read_stats(spark, f"{path}-none", path).select("dataset", "field", "n", F.round("mean", 6).alias("mean"))


@query("op_k6_audit_rows", "select doc_id || ',' || lang || ',' || n_chars as line from documents")
def k6(spark, sf):
    return read(spark, sf, "documents").select(F.to_csv(F.struct("doc_id", "lang", "n_chars")).alias("line"))


@query("op_k9_mapping_table", "select o_orderkey, count(l_orderkey) as steps from orders left join lineitem on l_orderkey = o_orderkey group by 1 having count(l_orderkey) > 0")
def k9(spark, sf):
    lengths = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("steps"))
    return read(spark, sf, "orders").select("o_orderkey").join(lengths, "o_orderkey")


@query("op_p8_repack_constants", "select doc_id, lang as language, 0::int as vqa_id, 'base' as slot from documents")
def p8(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "lang").withColumnRenamed("lang", "language").withColumn("vqa_id", F.lit(0)).withColumn("slot", F.lit("base"))


@query("op_p10_tree_merge", "select doc_id, lang, source || '!' as source, n_chars from documents")
def p10(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", F.struct("lang", "source").alias("meta"), "n_chars")
    return rows.withColumn("meta", F.col("meta").withField("source", F.concat(F.col("meta.source"), F.lit("!")))).select("doc_id", "meta.lang", "meta.source", "n_chars")


@query("op_p11_padding_by_type", "select d.doc_id, coalesce(l.quality, 0) as quality, coalesce(case when l.toxic = 1 then d.lang end, '') as lang from documents d left join labels l using (doc_id)")
def p11(spark, sf):
    rows = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce(F.when(F.col("toxic") == 1, F.col("lang")), F.lit("")).alias("lang"))


@query("op_p15_drop_bookkeeping", "select doc_id, n_chars from documents")
def p15(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", "n_chars", F.lit(1).alias("_row"), F.lit("x").alias("_file"))
    return rows.select([c for c in rows.columns if not c.startswith("_")])


@query("op_p17_dispatch", "select s_name, case when s_name = 'Supplier#000000001' then 'exact' when contains(s_name, '99') then 'high' when contains(s_name, '9') then 'low' else 'default' end as target from supplier")
def p17(spark, sf):
    target = standardize.dispatch(F.col("s_name"), {"Supplier#000000001": "exact"}, [(1, "9", "low"), (5, "99", "high")], "default")
    return read(spark, sf, "supplier").select("s_name", target.alias("target"))


@query("op_p24_camera_masks", "select item_id, coalesce(item_id % 3 <> 0 and length(text) > 0, false) as present from benchmark")
def p24(spark, sf):
    black = F.encode(F.repeat(F.lit("\0"), F.length("text")), "utf-8")
    image = F.when(F.col("item_id") % 3 == 0, black).otherwise(F.encode("text", "utf-8"))
    return read(spark, sf, "benchmark").select("item_id", media.has_pixels(image).alias("present"))


@query("op_f16_success_paths", "select page_id from pages where regexp_matches(url, '/en/')")
def f16(spark, sf):
    return read(spark, sf, "pages").where(F.col("url").rlike("/en/")).select("page_id")


@query("op_t13_episode_and_frame_order", f"with {FRAMES} select event_id, row_number() over (partition by episode_id order by {_H.format('f', 'event_id')}, event_id)::int as place from frames")
def t13(spark, sf):
    w = Window.partitionBy("episode_id").orderBy(hashing.uniform("f", F.col("event_id")), "event_id")
    return frames(spark, sf).select("event_id", F.row_number().over(w).alias("place"))


@query("op_u5_detector_union", f"with {FRAMES}, u as (select episode_id, t, 1 as p, 'grasp' as kind from frames where event_type = 'purchase' union all select episode_id, t, 2, 'motion' from frames where value > 80), r as (select *, row_number() over (partition by episode_id, t order by p) as i from u) select episode_id, t, kind from r where i = 1")
def u5(spark, sf):
    rows = frames(spark, sf)
    a = rows.where("event_type = 'purchase'").select("episode_id", "t", F.lit("grasp").alias("kind"))
    return keyframes.strongest(a.unionByName(rows.where("value > 80").select("episode_id", "t", F.lit("motion").alias("kind"))), EP)


@query("op_w4_zero_chunk_sum", f"with {FRAMES} select event_id, round(value + coalesce(lead(value, 1) over w, 0) + coalesce(lead(value, 2) over w, 0), 6) as total from frames window w as (partition by episode_id order by t)")
def w4(spark, sf):
    rows = frames(spark, sf).withColumn("c", windows.window_zero_padded(F.col("value"), 3, EP))
    return rows.select("event_id", F.round(F.aggregate("c", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("op_w5_last_chunk_width", f"with {FRAMES} select event_id, 8::int as width, last_value(value) over (partition by episode_id order by t rows between current row and 7 following) as last from frames")
def w5(spark, sf):
    rows = frames(spark, sf).withColumn("c", windows.window_last_padded(F.col("value"), 8, EP))
    return rows.select("event_id", F.size("c").alias("width"), F.element_at("c", -1).alias("last"))


@query("op_x24_reasoning_dropout", f"select conv_id, turn, case when {_H.format('drop', 'conv_id')} % 1000 < 300 then 0 else len(regexp_split_to_array(trim(text), '\\s+')) end::int as kept from conversations where length(trim(text)) > 0")
def x24(spark, sf):
    drop = hashing.bucket("drop", F.col("conv_id"), 1000) < 300
    mask = masks.with_dropout(F.transform(masks.words(F.col("text")), lambda w: F.lit(True)), drop)
    return read(spark, sf, "conversations").where("length(trim(text)) > 0").select("conv_id", "turn", F.aggregate(mask, F.lit(0), lambda s, x: s + x.cast("int")).alias("kept"))


@query("op_m30_turned_image", "select item_id, repeat('00', 16) || hex(case when item_id % 2 = 0 then md5(text) else reverse(md5(text)) end) || repeat('00', 16) as pixels from benchmark")
def m30(spark, sf):
    raw = F.encode(F.md5("text"), "utf-8")
    out = media.turned_and_resized(raw, F.array(F.lit(4), F.lit(8), F.lit(1)), F.col("item_id") % 2 == 1, F.array(F.lit(8), F.lit(8)))
    return read(spark, sf, "benchmark").select("item_id", F.hex(out).alias("pixels"))


@query("op_m32_packed_floats", "select vec_id, len(embedding)::int as n, round(embedding[1]::double, 6) as first, round(list_sum(embedding::double[]), 4) as total from embeddings")
def m32(spark, sf):
    rows = read(spark, sf, "embeddings").select("vec_id", media.packed_floats("embedding").alias("packed"))
    rows = rows.select("vec_id", media.decoded_floats("packed").alias("v"))
    return rows.select("vec_id", F.size("v").alias("n"), F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("op_vqa_samples", f"""select page_id, 'vqa_' || regexp_extract(url, '^https?://([^/]+)', 1) || '_' || page_id as sample_id, ({_H.format('vqa', 'url')} % 2147483647)::bigint as bucket,
  (['Describe it.', 'What is shown?', 'Give a caption.'])[1 + ({_H.format('ask', 'page_id')} % 3)::int] as prompt from pages where length(url) > 0""")
def vqa(spark, sf):
    rows = read(spark, sf, "pages").where("length(url) > 0")
    prompts = F.array(*[F.lit(p) for p in ("Describe it.", "What is shown?", "Give a caption.")])
    sample = F.concat(F.lit("vqa_"), F.regexp_extract("url", r"^https?://([^/]+)", 1), F.lit("_"), F.col("page_id").cast("string"))
    return rows.select("page_id", sample.alias("sample_id"), hashing.bucket("vqa", F.col("url"), 2147483647).alias("bucket"), hashing.choose("ask", F.col("page_id"), prompts).alias("prompt"))


@query("op_a3_partial_sums", "select sum(n)::bigint as n, min(lo) as lo, max(hi) as hi from (select l_returnflag, count(*) as n, min(l_quantity) as lo, max(l_quantity) as hi from lineitem group by 1)")
def a3(spark, sf):
    parts = read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    return parts.agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


@query("op_r3_row_map", f"with {POSES} select vec_id, round(e1 * 2 + 1, 6) + 0.0 as y from poses")
def r3(spark, sf):
    return poses(spark, sf).select("vec_id", rounded(F.col("e1") * 2 + 1).alias("y"))


@query("op_w13_runs_of_kind", f"""with {FRAMES}, o as (select *, coalesce((lag(event_type) over (partition by episode_id order by t) <> event_type)::int, 1) as opens from frames),
  r as (select *, sum(opens) over (partition by episode_id order by t rows between unbounded preceding and current row)::bigint as run from o) select episode_id, run, min(event_type) as event_type, min(t) as start, max(t) + 1 as "end" from r group by 1, 2""")
def runs(spark, sf):
    return windows.runs(frames(spark, sf), "event_type", EP)


@query("op_w16_time_suppression", f"""with recursive {FRAMES}, o as (select episode_id, t, row_number() over (partition by episode_id order by value desc, t) as i from frames where event_type = 'view'),
  k as (select episode_id, 0::bigint as i, []::bigint[] as kept from (select distinct episode_id from o) union all
    select o.episode_id, o.i, case when len(list_filter(kept, lambda x: abs(x - o.t) < 6)) > 0 then kept else list_append(kept, o.t) end from k join o on o.episode_id = k.episode_id and o.i = k.i + 1),
  l as (select episode_id, kept, row_number() over (partition by episode_id order by i desc) as r from k) select episode_id, unnest(kept)::int as t from l where r = 1""")
def suppression(spark, sf):
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), F.col("t").cast("int").alias("t")))), lambda s: s["t"])
    kept = frames(spark, sf).where("event_type = 'view'").groupBy("episode_id").agg(folds.suppress_near(order, 6).alias("k"))
    return kept.select("episode_id", F.explode("k").alias("t"))


@query("op_mixture_shares", "select dataset, round(weight / sum(weight) over (), 6) as share from (values " + ", ".join(f"('{d}', {w}::double)" for d, w in standardize.MIXTURES["oxe_magic_soup"]) + ") v(dataset, weight)")
def mixture_shares(spark, sf):
    rows = spark.createDataFrame(standardize.mixture_of("oxe_magic_soup"), "dataset string, weight double")
    return rows.select("dataset", F.round(F.col("weight") / F.sum("weight").over(Window.partitionBy()), 6).alias("share"))
