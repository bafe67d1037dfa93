"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import bpe, chat, chunk_dedup, decontam, graph, html_extract, queries, sharding, simhash, token_counts, topk, toxicity
from tidemark.llm.storage import new_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SMALL = "/root/testdata/sf0.001"


def docs(spark, texts, ids=None):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def passage(n, seed=0):
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


LONG = passage(9000, 99)
ODD = [None, "", " ", LONG, "same text here now", "same text here now"]


def test_shards_are_even_gapless_and_whole(spark):
    rows = docs(spark, [*ODD, *[f"t{k}" for k in range(300)], *["copy"] * 200], [None, *range(5), *range(5, 505)]).withColumn("shard", F.lit("x"))
    out = sharding.shuffled(rows, 24, bucket_bytes=4000).collect()
    sizes = Counter(r["shard"] for r in out)
    assert len(out) == 506 and set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r["doc_id"], r["text"]) for r in rows.collect())
    assert sharding.shuffled(rows.where("false"), 24).count() == 0


def test_shard_files(spark, tmp_path):
    sharding.write_shards(docs(spark, [f"t{k}" for k in range(100)]), str(tmp_path / "s"), 4)
    assert {r["shard"]: r["count"] for r in spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().collect()} == {0: 25, 1: 25, 2: 25, 3: 25}


def test_layouts_become_turns(spark):
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("prompt", T.StringType()), T.StructField("response", T.StringType()), T.StructField("instruction", T.StringType()), T.StructField("input", T.StringType()), T.StructField("output", T.StringType()), T.StructField("layout", T.StringType()), T.StructField("conversations", T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())])))])
    rows = [(1, "p", "r", None, None, None, "x", None), (2, None, None, "i", None, "o", None, None), (3, None, None, "i", "in", "o", None, None), (4, None, None, None, None, None, None, [("human", "h"), ("gpt", None)]), (5, "p", None, None, None, None, None, None)]
    out = {r["id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in chat.canonical_turns(spark.createDataFrame(rows, kind), "id").collect()}
    assert out[1] == ("prompt_response", [("user", "p"), ("assistant", "r")])
    assert out[2] == ("instruction", [("user", "i"), ("assistant", "o")])
    assert out[3] == ("instruction", [("user", "i"), ("user", "in"), ("assistant", "o")])
    assert out[4] == ("from_value", [("user", "h"), ("assistant", "")])
    assert out[5] == (None, [])



def test_all_layouts_in_one_table(spark):
    parts = "array<struct<type:string,text:string>>"
    kind = f"id long, messages array<struct<role:string,text:string,content:{parts}>>, conversations array<struct<from:string,value:string>>, prompt string, response string, completion string, instruction string, input string, output string, question string, answer string, system string, data struct<prompt:string,response:string>"
    names = ["id", "messages", "conversations", "prompt", "response", "completion", "instruction", "input", "output", "question", "answer", "system", "data"]
    hi = [("text", "h"), ("text", "i"), ("image", None)]
    records = [
        {"messages": [("user", "a", None), ("assistant", None, None)]}, {"messages": [("user", None, hi), ("bot", None, [])]}, {"messages": [("user", "a", None), ("assistant", None, hi)]},
        {"conversations": [("human", "h"), ("gpt", "g")]}, {"prompt": "p", "response": "r"}, {"prompt": "p", "completion": "c", "system": "s"},
        {"instruction": "i", "input": "n", "output": "o"}, {"question": "q", "answer": "a"}, {"data": ("p", "r")}, {"prompt": "p", "answer": "a"}, {"messages": [("user", None, None)]},
    ]
    table = spark.createDataFrame([tuple(({"id": k} | r).get(n) for n in names) for k, r in enumerate(records)], kind)
    turns = chat.canonical_turns(table, "id")
    out = {r["id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in turns.collect()}
    assert out == {
        0: ("role_text", [("user", "a"), ("assistant", "")]), 1: ("role_content", [("user", "hi"), ("assistant", "")]), 2: ("role_text_or_content", [("user", "a"), ("assistant", "hi")]),
        3: ("from_value", [("user", "h"), ("assistant", "g")]), 4: ("prompt_response", [("user", "p"), ("assistant", "r")]), 5: ("prompt_completion", [("system", "s"), ("user", "p"), ("assistant", "c")]),
        6: ("instruction", [("user", "i"), ("user", "n"), ("assistant", "o")]), 7: ("question_answer", [("user", "q"), ("assistant", "a")]), 8: ("prompt_response", [("user", "p"), ("assistant", "r")]), 9: (None, []), 10: ("role_text", [("user", "")]),
    }
    assert [r["records"] for r in chat.layout_counts(turns).where("layout is null").collect()] == [1]
    assert chat.canonical_turns(table, "id", roles={}).where("id = 3").first()["turns"][0]["role"] == "human"


def test_chat_rows(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, "user", "q"), (1, 1, "assistant", "b"), (2, 0, None, LONG), (None, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted_chats(chat.canonical_turns(chat.conversations_to_records(rows), "conv_id"), "conv_id")).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == hashlib.sha256(b"user\nq\nassistant\n\nassistant\nb\n").hexdigest()
    assert got[1]["loss_chars"] == 1 and got[1]["loss_sha256"] == hashlib.sha256(b"b").hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(f"\n{LONG}\n".encode()).hexdigest() and got[None]["n_turns"] == 1
    assert chat.read_back(chat.formatted_chats(chat.canonical_turns(chat.conversations_to_records(rows.where("false")), "conv_id"), "conv_id")).count() == 0


def test_toxicity_learns_and_holds_out(spark):
    good, bad = [passage(30, k) for k in range(400)], [passage(30, 1000 + k) + " you moron " + passage(3, k) for k in range(150)]
    rows = docs(spark, [*good, *bad, None, "", "what a m0r0n"])
    labels = spark.createDataFrame([(k, 0, int(k >= 400)) for k in range(550)] + [(None, 0, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity(rows, labels).collect()}
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    assert all(out[k]["predicted"] == int(k >= 400) for k in range(550)) and out[552]["predicted"] == 1
    assert 0 <= out[550]["score"] < 0.3 and out[550]["score"] == out[551]["score"]
    kept = toxicity.without_toxic(rows, labels)
    assert {r["doc_id"] for r in kept.collect()} == {*range(400), 550, 551} and kept.columns == rows.columns
    nothing = toxicity.toxicity(rows.where("false"), labels.where("false"))
    assert nothing.count() == 0 and toxicity.toxicity(rows, labels.where("false")).where("score is null").count() == 0


def test_toxicity_of_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = queries.op3_toxicity(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] == r["toxic"] for r in rows)
    assert len(rows) > 60 and hit / len(rows) > 0.9


def test_top_k_with_bad_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [float(x) for x in rng.normal(0, 0.1, 8)]) for k in range(300)] + [(k, [0.1] * 8) for k in range(300, 360)]
    rows += [(900, None), (901, [None] * 8), (902, [float("nan")] * 8), (903, [float("inf")] + [0.0] * 7), (None, [0.0] * 8), (5, [0.2] * 8), (905, [])]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    got = {}
    for r in topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10, shard_rows=64, block_rows=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    plain = {}
    for r in vectors.collect():
        plain.setdefault(r["vec_id"], []).append(np.array([*r["v"], *[0] * (8 - len(r["v"]))]))
    for q in (0, 100, 200, 300):
        score = sorted((-int(v @ plain[q][0]), i) for i, vs in plain.items() if i != q for v in vs)[:10]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(score)]
    assert topk.top_k(vectors.where("false"), vectors.where("false")).count() == 0
    assert topk.top_k(vectors.where("vec_id < 3"), vectors.where("vec_id = 0")).count() == 2


def test_bpe_round_trip(spark):
    texts = [*ODD, "x<|endoftext|>y", "a" * 40_000]
    library = bpe.load(bpe.tokenizer_path("byte_bpe_50k.json")).library
    got = {r["doc_id"]: r for r in bpe.round_trip(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids) and got[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe.encode(docs(spark, texts), leaf_chars=100)
    assert {r["doc_id"]: r["text"] for r in bpe.decode(encoded).collect()} == {k: t or "" for k, t in enumerate(texts)}
    assert bpe.round_trip(docs(spark, texts).where("false")).count() == 0


@pytest.mark.parametrize("most_broadcast", [0, 1000])
def test_token_cache(spark, most_broadcast, monkeypatch):
    library = bpe.load(bpe.tokenizer_path("byte_bpe_50k.json")).library
    cache = new_path(spark, "test-cache")
    rows = docs(spark, ODD).withColumn("digest", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    for texts in (rows, rows, docs(spark, [*ODD, "something new"]), rows.where("false")):
        got = {(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(texts, cache, most_broadcast=most_broadcast).collect()}
        want = {(r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in texts.collect()}
        assert got == want
    stored = token_counts.read_cache(spark, cache)
    assert stored.count() == len({t or "" for t in ODD}) + 1 and stored.select("digest").distinct().count() == stored.count()


def test_leaks(spark):
    items = [passage(40, k) for k in range(5)]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (None, "x")], "item_id bigint, text string")
    rows = docs(spark, [f"{passage(50, 70)}. {items[2].upper()}; {passage(50, 71)}", items[0][: len(items[0]) // 2], *ODD, items[4], items[4]])
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(rows, bench).collect()}
    assert found == {(0, 2), (8, 4), (9, 4)}
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(rows, bench, most_bytes=300).collect()} == found
    names = bench.selectExpr("concat('item ', item_id) as item_id", "text")
    clash = rows.withColumn("item_id", F.lit(1)).withColumn("position", F.lit("x"))
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(clash, names).collect()} == {(a, f"item {b}") for a, b in found}
    yes = spark.createDataFrame([(1, "Yes")], "item_id bigint, text string")
    told = docs(spark, ["he said yes.", "eyes"])
    assert decontam.leaks(told, yes).count() == 0 and [r["doc_id"] for r in decontam.leaks(told, yes, short_items=True).collect()] == [0]
    same = docs(spark, [items[4], "clean", items[4], items[4]], [1, 1, None, 2])
    assert [(r["doc_id"], r["text"]) for r in decontam.decontaminated(same, bench, most_bytes=300).collect()] == [(1, "clean")]
    clean = decontam.decontaminated(rows, bench)
    assert {r["doc_id"] for r in clean.collect()} == set(range(1, 8)) and clean.columns == rows.columns
    assert decontam.leaks(rows, bench.where("false")).count() == 0 and decontam.leaks(rows.where("false"), bench).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 200), (200, 200), (300, 200), (None, 4)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in graph.connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 200: 100, 300: 100}
    assert graph.connected_components(links.where("false")).count() == 0


def slow_classes(rows):
    prints = [(i, simhash.fingerprint(t)) for i, t in rows]
    label = list(range(len(prints)))
    for _ in range(len(prints)):
        for a in range(len(prints)):
            for b in range(a):
                if bin(prints[a][1] ^ prints[b][1]).count("1") <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    ids = lambda k: [i for (i, _), x in zip(prints, label, strict=True) if x == k and i is not None]
    return Counter((i, min(ids(x), default=None)) for (i, _), x in zip(prints, label, strict=True))


def test_near_duplicates(spark):
    base = [passage(200, k).split() for k in range(6)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:50], f"new{k}", *b[51:]]) for b in base for k in range(3)] + ODD
    rows = list(enumerate(texts)) + [(2, texts[2]), (None, texts[3]), (None, "alone here")]
    table = docs(spark, [t for _, t in rows], [i for i, _ in rows]).withColumn("fp", F.lit("clash"))
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(table).collect())
    assert got == slow_classes(rows)
    assert simhash.near_duplicates(table.where("false")).count() == 0


def slow_similar(texts: list[str | None]) -> list[int]:
    """For each text, the index of the first of its class over five-word similarities of 0.8 or more."""
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return label


def edited(words: list[str], places: list[int], tag: str) -> str:
    return " ".join(f"{tag}{k}" if k in places else w for k, w in enumerate(words))


def test_keep_one_of_similar_texts(spark):
    base = [passage(200, k).split() for k in range(6)]
    texts = [" ".join(b) for b in base]
    texts += [edited(b, [17 + k * 11], f"new{k}") for b in base for k in range(3)]
    texts += [edited(b, [20, 60, 100], "far") for b in base] + [edited(b, range(0, 200, 12), "apart") for b in base] + ODD
    rows = list(enumerate(texts)) + [(2, texts[2]), (None, texts[3]), (None, "alone here"), (None, "alone  HERE")]
    table = docs(spark, [t for _, t in rows], [i for i, _ in rows]).withColumn("class", F.lit("clash")).withColumn("node", F.lit(1))
    kept = simhash.keep_one(table)
    label = slow_similar([t for _, t in rows])
    assert kept.columns == table.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted((rows[k][0] is None, rows[k][0] or 0) for k in set(label))
    assert simhash.keep_one(table.where("false")).count() == 0


def test_similar_groups_cut_into_cells_lose_no_link(spark):
    """Chains drift away from the centre, and tiny cells and caps leave most members to the comparisons across cells."""
    texts = []
    for seed in range(3):
        words = passage(120, seed).split()
        for k in range(24):
            words[(k * 5) % 120] = f"step{seed}x{k}"
            texts.append(" ".join(words))
    rows = docs(spark, texts).select("doc_id", "text")
    label = slow_similar(texts)
    assert len(set(label)) == 3
    for cell in (600, 1 << 17):
        got = {r["doc_id"]: r["class"] for r in simhash.similar_groups(rows, cell=cell).collect()}
        assert len({(label[i], c) for i, c in got.items()}) == len(set(label)) == len(set(got.values())) and len(got) == len(texts)


def test_hot_shards_lose_no_link(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 30)
    values = np.unique(np.concatenate([[b ^ (1 << int(k)) ^ (1 << int(j)) for k, j in rng.integers(0, 20, (12, 2))] for b in base] + [base]))
    prints = spark.createDataFrame([(int(v),) for v in values], "fp bigint")
    cut, whole = (graph.connected_components(simhash.links(prints, 2, cap)) for cap in (5, 100_000))
    assert {tuple(r) for r in cut.collect()} == {tuple(r) for r in whole.collect()}


def slow_passages(rows, n=50):
    """Word ranges of each document that lie in a stretch of n words that a smaller doc_id holds; texts with single blanks."""
    first, covered = {}, {}
    for i in sorted(rows):
        words = (rows[i] or "").split()
        for k in range(len(words) - n + 1):
            if first.setdefault(" ".join(words[k : k + n]), i) != i:
                covered.setdefault(i, set()).update(range(k, k + n))
    return covered


def cut_out(text, spans):
    at, left = 0, []
    for a, b in sorted(spans):
        left.append(text[at : max(a, at)])
        at = max(at, b)
    return "".join(left) + text[at:] if text else text


def test_repeated_passages(spark):
    shared = passage(80, 5)
    texts = [passage(60, 1) + ". " + shared + ". " + passage(60, 2), passage(70, 3), passage(20, 4) + " \n" + shared + ".\n" + passage(90, 6), *ODD, "é日 " * 10 + shared + ". ñ", shared[:60]]
    rows = docs(spark, texts).withColumn("owner", F.lit(1)).withColumn("start", F.lit(2))
    found = chunk_dedup.repeated_passages(rows).collect()
    assert {(r["doc_id"], texts[r["doc_id"]][r["start"] : r["end"]], r["words"]) for r in found} == {(k, shared + ".", 80) for k in (2, 9)}
    assert {(r["doc_id"], r["found_in"]) for r in found} >= {(2, 0), (9, 0)} and all(r["found_in"] < r["doc_id"] for r in found)
    cut = {r["doc_id"]: r["text"] for r in chunk_dedup.without_spans(rows.drop("start", "owner"), chunk_dedup.repeated_passages(rows)).collect()}
    assert cut == {k: cut_out(t, [(r["start"], r["end"]) for r in found if r["doc_id"] == k]) for k, t in enumerate(texts)}
    assert chunk_dedup.repeated_passages(rows.where("false")).count() == 0


@pytest.mark.parametrize("often", [64, 2])
def test_repeated_passages_against_every_window(spark, often, monkeypatch):
    import random

    rng = random.Random(8)
    pool = [passage(n, 300 + n) for n in (49, 50, 51, 52, 60, 90, 200)] + ["ha " * 70 + "ho", "one two " * 60 + "end"]
    texts = {}
    for k in range(120):
        parts = [passage(rng.randint(0, 60), 400 + k * 3 + j) for j in range(2)]
        texts[k] = " ".join([parts[0], *rng.sample(pool, rng.randint(0, 2)), parts[1]]).strip()
    for k in range(120, 140):
        texts[k] = " ".join(w for w in texts[k % 7].split() if rng.random() > 0.01)
    made = chunk_dedup.chunks
    monkeypatch.setattr(chunk_dedup, "chunks", lambda *a: made(*a, often=often))
    spans = {}
    for r in chunk_dedup.repeated_passages(docs(spark, list(texts.values())), min_chars=10**6).collect():
        stretch = texts[r["doc_id"]][r["start"] : r["end"]]
        assert r["words"] == len(stretch.split()) and stretch in texts[r["found_in"]] and r["found_in"] < r["doc_id"]
        begin = len(texts[r["doc_id"]][: r["start"]].split())
        spans.setdefault(r["doc_id"], set()).update(range(begin, begin + r["words"]))
    want = slow_passages(texts)
    assert set(spans) == set(want)
    for k, v in want.items():
        # In a stretch of one repeated word or two, words at its ends may stay.
        lost = v - spans[k]
        assert spans[k] <= v and all(texts[k].split()[i] in {"ha", "ho", "one", "two", "end"} for i in lost) and len(lost) <= 0.2 * len(v)


def test_pages(spark):
    page = "<html><body><nav>m</nav><div class='x'><p>{}</p></div><footer>f</footer></body></html>"
    rows = [(k, f"https://a.example/{k}", page.format(f"text {k} " * 9)) for k in range(6)] + [(7, None, None), (8, "https://b.example/", ""), (9, "bad", "<p>x &lt; y"), (9, "bad", "<p>x &lt; y")]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1)).withColumn("slot", F.lit(2))
    got = Counter((r["page_id"], r["text"]) for r in html_extract.extract(table).collect())
    assert got == Counter([(k, ("text %d " % k * 9).strip()) for k in range(6)] + [(7, ""), (8, ""), (9, "x < y"), (9, "x < y")])
    slots = {r["host"]: r["slot"] for r in html_extract.templates(table).collect()}
    assert slots["a.example"] == "/html/body/div.x"
    assert html_extract.extract(spark.createDataFrame([(1, "https://a.example", "<p>long text " * 200_000)], "page_id bigint, url string, html string")).first()["text"].count("long") == 200_000
    assert html_extract.extract(table.where("false")).count() == 0


@pytest.mark.parametrize("name", ["op1_sharding", "op2_chat_formatting", "op5_bpe_round_trip", "op6_token_counts", "op8_simhash_near_dedup", "op10_html_extraction"])
def test_queries_return_every_row(spark, name):
    out = queries.queries()[name](spark, SMALL)
    source = {"op2_chat_formatting": "conversations", "op10_html_extraction": "pages"}.get(name, "documents")
    n = spark.read.parquet(f"{SMALL}/{source}.parquet")
    assert out.count() == (n.select("conv_id").distinct().count() + 1 if source == "conversations" else n.count())


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline

    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    out = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, SMALL).collect()}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    toxic = {r["doc_id"] for r in toxicity.toxicity(table, labels).where("predicted = 1").collect()}
    left = {i: t for i, t in rows.items() if i not in toxic}
    order = sorted(left)
    left = {order[k]: left[order[k]] for k in set(slow_similar([left[i] for i in order]))}
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert set(out) <= set(left) and not [i for i in out if any(b in rows[i] for b in items)]
    lost = set(left) - set(out)
    assert all(any(decontam.normalize(b) in decontam.normalize(left[i]) for b in items) for i in lost)
    # Every text is what is left once the passages found among these documents are cut out by plain slices.
    spans = {}
    for r in chunk_dedup.repeated_passages(table.where(F.col("doc_id").isin(list(left)))).collect():
        spans.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    assert spans and any(i in out for i in spans)
    for i, digest in out.items():
        gone = {k for a, b in spans.get(i, []) for k in range(a, b)}
        assert hashlib.sha256("".join(c for k, c in enumerate(left[i]) if k not in gone).encode()).hexdigest() == digest, i
