"""Framed records: checksums, round trips, splits, damage, examples."""

from __future__ import annotations

import random
import struct
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.sources import record_files as rec


def slow_crc(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums_by_definition():
    rng = random.Random(1)
    texts = [b"", b"a", b"abc", b"123456789", bytes(32), b"\xff" * 33, *[rng.randbytes(rng.choice([4, 5, 8, 63, 64, 65, 1000, 5000])) for _ in range(60)]]
    assert rec.checksums(texts).tolist() == [slow_crc(t) for t in texts]
    assert int(rec.checksums([b"123456789"])[0]) == 0xE3069283


def walk(tmp_path, data):
    (tmp_path / "x.tfrecord").write_bytes(data)
    return list(rec._Heads(str(tmp_path / "x.tfrecord")).walk())


def test_headers_are_followed_and_found_again(tmp_path):
    inner = b"".join(rec.framed([b"looks like", b"records"]))
    texts = [b"", b"one", inner, b"x" * 70_000, b"last"]
    data = b"".join(rec.framed(texts))
    sound = walk(tmp_path, data)
    assert [(n, size, d) for n, _, size, d in sound] == [(k, len(t), None) for k, t in enumerate(texts)]
    assert walk(tmp_path, b"") == []
    # Every byte of a header or length may be wrong: the records before and after stay whole.
    for k in (0, 3, 8, 11):
        broken = bytearray(data)
        broken[sound[1][1] + k] ^= 0x40
        got = walk(tmp_path, bytes(broken))
        assert got[0] == sound[0] and got[1][1:] == (sound[1][1], sound[2][1] - sound[1][1], "header") and [g[1:] for g in got[2:]] == [s[1:] for s in sound[2:]]
    cut = walk(tmp_path, data[:-3])
    assert [g[1:] for g in cut[:-1]] == [s[1:] for s in sound[:-1]] and cut[-1][3] == "header"


@pytest.mark.parametrize("split", [1, 17, 40, 100, 1 << 20])
def test_records_of_any_split_and_damage(spark, tmp_path, split):
    rng = random.Random(3)
    texts = [rng.randbytes(rng.choice([0, 1, 9, 30, 200])) for _ in range(60)]
    framed = rec.framed(texts)
    at = np.cumsum([0, *map(len, framed)])
    data = bytearray(b"".join(framed))
    hit = next(k for k, t in enumerate(texts) if len(t) == 200)
    data[at[hit] + 50] ^= 1
    (tmp_path / "a-train.tfrecord-00000").write_bytes(bytes(data))
    (tmp_path / "a-val.tfrecord-00000").write_bytes(b"".join(rec.framed([b"v"])))
    found = rec.index(rec.files(spark, str(tmp_path), "train"))
    got = {r["number"]: (None if r["data"] is None else bytes(r["data"]), r["damaged"]) for r in rec.records(found, split).collect()}
    assert got == {k: (None, "checksum") if k == hit else (t, None) for k, t in enumerate(texts)}
    assert rec.index(rec.files(spark, str(tmp_path))).count() == 61


def test_written_files_hosts_and_seeds(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = spark.range(500).repartition(7).select(F.when(F.col("id") != 3, F.concat(F.lit("r"), F.col("id").cast("string"))).cast("binary").alias("data"))
    own = rec.write(rows, path, "data")
    listed = rec.files(spark, path, seed=5)
    assert sorted(map(tuple, own.collect()), key=str) == sorted(((r["file"].removeprefix("file:"), *tuple(r)[1:]) for r in rec.index(listed).collect()), key=str)
    assert Counter(bytes(r["data"]) for r in rec.records(own).collect()) == Counter(b"" if k == 3 else f"r{k}".encode() for k in range(500))
    order = [r["file"] for r in listed.orderBy("place").collect()]
    assert order == [r["file"] for r in rec.files(spark, path, seed=5).orderBy("place").collect()] and len(set(order)) == len(order) > 1
    shards = [{r["file"] for r in rec.files(spark, path, seed=5, shard=(k, 2)).collect()} for k in range(2)]
    assert not shards[0] & shards[1] and shards[0] | shards[1] == set(order)


@given(st.dictionaries(st.text(max_size=5), st.one_of(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=4), st.lists(st.binary(max_size=9), max_size=4), st.lists(st.floats(width=32, allow_nan=False), max_size=4)), max_size=5))
@settings(max_examples=200, deadline=None)
def test_examples_read_back(features):
    assert rec.parsed(rec.example(features)) == features


def test_unpacked_numbers_and_damaged_messages(spark, tmp_path):
    unpacked = b"\x0a\x0b\x0a\x09\x0a\x01n\x12\x04\x1a\x02\x08\x07"
    assert rec.parsed(unpacked) == {"n": [7]}
    assert rec.parsed(b"\x0a\x0e\x0a\x0c\x0a\x01f\x12\x07\x12\x05\x0d" + struct.pack("<f", 1.5)) == {"f": [1.5]}
    rows = [("f", 0, rec.example({"a": [1.5, 2.0], "b": ["é"], "c": [5]}), None), ("f", 1, b"\xff\xff", None), ("f", 2, None, "checksum"), ("f", 3, b"", None)]
    table = spark.createDataFrame(rows, "file string, number bigint, data binary, damaged string")
    got = [tuple(r)[1:] for r in rec.examples(table, "a array<float>, b string, c bigint, d array<bigint>").orderBy("number").collect()]
    assert got == [(0, [1.5, 2.0], "é", 5, None, None), (1, None, None, None, None, "message"), (2, None, None, None, None, "checksum"), (3, None, None, None, None, None)]
