"""Packing, fill-in-the-middle and centroid clustering against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import bpe, centroids, infill, packing, queries

DOCS = "doc_id bigint, text string, length string, ids string"
SMALL = "/root/testdata/sf0.001"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


# Packing


def cost_of(cuts, price, length):
    total, before = 0, 0
    for c in cuts:
        n = c - before
        total += (0 if n & (n - 1) == 0 else length - n) + 1 + (price[c] if c != cuts[-1] else 0)
        before = c
    return total


def cheapest(places, price, length):
    best = {0: 0}
    for c in places:
        best[c] = min(best[b] + (0 if (c - b) & (c - b - 1) == 0 else length - c + b) for b in best if c - b <= length) + 1 + (price[c] if c != places[-1] else 0)
    return best[places[-1]]


@given(st.integers(1, 120), st.sets(st.integers(1, 119), max_size=12), st.sets(st.integers(1, 119), max_size=25), st.sampled_from([8, 16, 32]), st.integers(0, 9), st.integers(0, 30))
@settings(max_examples=300, deadline=None)
def test_plan_is_the_cheapest(n, doc_ends, sentences, length, small, large):
    doc_ends = np.array(sorted({d for d in doc_ends if d < n} | {n}))
    sentences = np.array(sorted(s for s in sentences if s < n), dtype=np.int64)
    places, kind = packing.candidates(n, doc_ends, sentences, max(1, length // 4))
    assert places[-1] == n and set(doc_ends) <= set(places) and set(sentences) <= set(places) and np.diff(np.concatenate([[0], places])).max() <= max(1, length // 4)
    price = dict(zip(places.tolist(), np.array([0, small, large])[kind].tolist(), strict=True))
    cuts = packing.plan(places, np.array([0, small, large])[kind], length).tolist()
    assert cuts[-1] == n and max(b - a for a, b in zip([0, *cuts], cuts, strict=False)) <= length
    assert cost_of(cuts, price, length) == cheapest(places.tolist(), price, length)


PARTS = ["a", "B", "th", "ing", "'", "'S", "'re", " ", "  ", "\n", "\t", "\x0b", "\x1c", "1", "23", "!", "?!", ".", "é", "É", "ß", "日本", "。", "<|endoftext|>", "<|endo", "ftext|>", "🙂", "é", " ", "\u0085", " ", "İ", "Σ", "ς", "Ǆ", "²", "_", "—", "\x00", "ﬁ", "K", "</w>", "Hello", "ab" * 300]


@pytest.mark.parametrize("seed", range(3))
def test_stretches_encode_as_whole_texts(seed):
    codec = packing.ChunkEncoder(bpe.tokenizer_path("word_bpe_49k.json"), most_known=200)
    assert codec.by_chunks and codec.engine
    rng = random.Random(seed)
    texts = [None, "", " ", *["".join(rng.choice(part) for _ in range(rng.randint(0, 60))) for part in (rng.sample(PARTS, rng.randint(1, 9)) for _ in range(700))]]
    want = [e.ids for e in codec.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for lo, hi in ((0, 300), (300, len(texts))):
        ids, counts, ends = codec.texts(pa.array(texts[lo:hi], pa.string()))
        at = np.cumsum(counts) - counts
        assert [ids[a : a + n].tolist() for a, n in zip(at, counts, strict=True)] == want[lo:hi] and len(ends) == len(ids)


def test_sentences_end_after_marks():
    codec = packing.load(bpe.tokenizer_path("word_bpe_49k.json"))
    ids, counts, ends = codec.texts(pa.array(['One two. Three "four!" five 1.5 six', "日本。語"]))
    words = codec.library.decode_batch([[int(i)] for i in ids])
    assert [w.removesuffix('</w>') for w, e in zip(words, ends, strict=True) if e][:2] == [".", '!"'] and ends.sum() == 3


@pytest.mark.parametrize("block", [1 << 20, 600])
def test_every_id_lies_in_one_piece(spark, block):
    long = " ".join(f"word{k} and." if k % 9 == 0 else f"word{k}" for k in range(4000))
    texts = [None, "", " ", long, "same text.", "same text.", "x" * 3000, *[f"Text {k} has some words. And more." * (k % 7) for k in range(300)]]
    ids = [None, *range(4), 4, *range(5, 4 + len(texts) - 4)]
    rows = docs(spark, texts, ids[: len(texts)]).repartition(3).persist()
    out = packing.pack(rows, length=256, block_tokens=block).collect()
    library = packing.load(bpe.tokenizer_path("word_bpe_49k.json")).library
    want = Counter((r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids) + (2,)) for r in rows.collect())
    at = defaultdict(list)
    for r in out:
        at[r["sequence_id"]].append(r)
        assert r["length"] == len(r["ids"]) > 0 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
    padding = 0
    for pieces in at.values():
        pieces.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in pieces])
        assert [r["offset"] for r in pieces] == [0, *ends[:-1]] and ends[-1] <= 256
        padding += 0 if int(ends[-1]).bit_count() == 1 else 256 - ends[-1]
    assert padding < 0.1 * sum(r["length"] for r in out)
    # In the order of reading, a document's pieces follow one another.
    got, run = Counter(), ()
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["start"] == len(run)
        run += tuple(r["ids"])
        if len(run) == r["doc_tokens"]:
            got[r["doc_id"], run] += 1
            run = ()
    assert run == () and got == want
    whole = packing.padded(packing.pack(rows, length=256, block_tokens=block), 256, pad_id=7).collect()
    assert len(whole) == len(at) and all(len(r["ids"]) == 256 or r["n_tokens"] == len(r["ids"]) and int(r["n_tokens"]).bit_count() == 1 for r in whole)
    assert packing.pack(rows.where("false")).count() == 0


def test_other_tokenizer_and_query(spark):
    rows = docs(spark, ["Some text here. " * 50, None, "b"])
    out = packing.pack(rows, tokenizer="byte_bpe_50k.json", end_id=50256, length=64).collect()
    assert sum(r["length"] for r in out) == sum(len(x) + 1 for x in bpe.load(bpe.tokenizer_path("byte_bpe_50k.json")).encode_batch(["Some text here. " * 50, "", "b"]))
    got = queries.op11_packing(spark, SMALL)
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert got.where("start = 0").count() == n and got.groupBy("doc_id").agg((F.sum("length") == F.max("doc_tokens")).alias("ok")).where("not ok").count() == 0


# Fill in the middle

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PIECES = ["a", " ", "\n", "\x0b", "é", "日", "🙂", "<", "P", "S", ">", "<P>", "<M", " ", "\u0085", "<S>", "word", "\x00", "\x7f", "ÿ"]


def slow_infill(key, text, seed=42, rate=50, spm=80, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = UNITS.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    head, body, tail = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    out = marks[0] + head + marks[1] + tail + marks[2] + body if form == "psm" else marks[1] + tail + marks[0] + head + marks[2] + body
    return len(units), form, len(head), len(body), out


@given(st.lists(st.text(alphabet=st.sampled_from("a \n\té日🙂<PSM>ÿ \x00\x0b"), max_size=30), max_size=8))
@settings(max_examples=300, deadline=None)
def test_automaton_counts_as_defined(texts):
    events = infill.automaton().scan(np.frombuffer(b"\xff" + b"\xff".join(t.encode() for t in texts), dtype=np.uint8))
    at = 1
    for t in texts:
        own = events[at : at + len(t.encode())]
        starts = [len(t[: m.start()].encode()) for m in UNITS.finditer(t)]
        assert np.flatnonzero(own & infill.UNIT).tolist() == starts
        assert np.flatnonzero(own & infill.CHARACTER).tolist() == [len(t[:k].encode()) for k in range(len(t))]
        assert (own & infill.SENTINEL > 0).sum() == sum(t.count(s) for s in infill.SENTINELS)
        at += len(own) + 1


@pytest.mark.parametrize("marks", [infill.SENTINELS, ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")])
def test_infill_against_brute_force(spark, marks):
    rng = random.Random(5)
    texts = [None, "", " ", "same same", "same same", "long 🙂 text\n" * 60_000, marks[0], *["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(600)]]
    ids = [None, *range(3), 3, *range(4, len(texts) - 1)]
    rows = docs(spark, texts, ids)
    made = infill.transform(rows, rate=90, spm_rate=60, sentinels=marks).withColumn("back", infill.restored(F.col("output"), F.col("form"), marks))
    got = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in made.collect())
    assert got == Counter((i, *slow_infill(i, t, 42, 90, 60, marks), t or "") for i, t in zip(ids, texts, strict=True))
    assert {"psm", "spm", "plain"} == {k[2] for k in got}
    assert infill.transform(rows.where("false")).count() == 0


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("ab", "bc", "d"), ("", "b", "c"), ("<a", "<ab", "c"), ("< P>", "b", "c"), ("aa", "b", "c")])
def test_sentinels_that_could_be_misread_are_refused(spark, marks):
    with pytest.raises(ValueError):
        infill.transform(docs(spark, ["x"]), sentinels=marks)


# Centroids


def slow_clusters(rows, k, rounds, seed=1):
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)[:k]
    at = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in rows:
            own[near(v)[1]].append(v)
        at = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if own[j] else c for j, c in enumerate(at)]
    found = [(i, near(v)) for i, v in rows]
    inertia = Counter()
    for _, (d, j) in found:
        inertia[j] += d
    return Counter((i, j, d, inertia[j], sum(inertia.values()), tuple(at[j])) for i, (d, j) in found)


@pytest.mark.parametrize("dims,segment,spread", [(8, 4, 5), (7, 3, 1), (5, 8, 1 << 27)])
def test_clusters_against_brute_force(spark, dims, segment, spread):
    rng = random.Random(dims)
    rows = [(i, [rng.randint(-spread, spread) for _ in range(dims)]) for i in range(400)] + [(7, [1] * dims), (None, [0] * dims)] + [(1000 + k, [1] * dims) for k in range(50)]
    table = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id bigint, v array<int>, cluster string")
    got = centroids.clusters(table, dims, 6, 2, segment=segment).collect()
    assert Counter((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], tuple(r["centroid"])) for r in got) == slow_clusters(rows, 6, 2)
    assert len(centroids.clusters(table.limit(3), dims, 6, 1).collect()) == 3
    assert centroids.clusters(table.where("false"), dims, 6, 1).count() == 0


def test_screening_keeps_the_nearest_and_spares_work():
    rng = np.random.default_rng(4)
    middle = rng.integers(-40, 41, (12, 64))
    vectors = middle[rng.integers(0, 12, 3000)] + rng.integers(-3, 4, (3000, 64))
    screen = centroids.Screen(middle, 8)
    best, distance = screen.assign(vectors, centroids.compressed(vectors, 8))
    every = ((vectors[:, None, :] - middle) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert screen.measured < 0.2 * every.size
    norms = centroids.compressed(vectors, 8).astype(np.float64)
    assert (vectors @ middle.T <= norms @ screen.norms.T).all()


def test_only_whole_vectors_become_integers(spark):
    rows = [(1, [0.5, -0.51]), (2, None), (3, [0.5]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("-inf"), 1.0]), (7, [1e30, -1e30]), (None, [-0.0, 0.0])]
    got = centroids.integer_rows(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 2, 64).collect()
    assert [(r["vec_id"], r["v"]) for r in got] == [(1, [32, -33]), (7, [1 << 27, -(1 << 27)]), (None, [0, 0])]


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_centroid_clusters"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    table = {"op12_fill_in_middle": "documents", "op13_centroid_clusters": "embeddings"}[name]
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from read_parquet('{SMALL}/{table}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = queries.queries()[name](spark, SMALL).select(*names).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())
