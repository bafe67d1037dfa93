"""Large JSON documents in blocks of any size, against a plain parser."""

from __future__ import annotations

import json
import os
import random

import pyarrow as pa
import pytest

from tidemark.plans import ORACLES, QUERIES
from tidemark.sources import json_document, readers


def plain(text):
    """Members two levels deep by the standard parser, repeated names included."""
    pairs = json.loads(text, object_pairs_hook=lambda x: x) if text.strip() else []
    out = []
    for file, episodes in pairs if text.strip().startswith("{") else []:
        if isinstance(episodes, list) and all(isinstance(e, tuple) for e in episodes):
            out += [(file, name, as_plain(v)) for name, v in episodes]
    return out


def as_plain(v):
    if isinstance(v, list) and v and all(isinstance(x, tuple) for x in v):
        return {k: as_plain(x) for k, x in v}
    return [as_plain(x) for x in v] if isinstance(v, list) else v


def document(rng, n_files):
    strings = ["a", 'q"uote', "back\\slash", '\\"', "end\\\\", "{[", "]}", "é日🙂", ":", ", ", "\n"]
    word = lambda: rng.choice(strings) + str(rng.randint(0, 99))
    space = lambda: rng.choice(["", " ", "\n", "\t "])

    def value(depth):
        kind = rng.randint(0, 5 if depth < 3 else 2)
        if kind >= 4:
            return "{" + ",".join(f"{space()}{json.dumps(word())}{space()}:{space()}{value(depth + 1)}{space()}" for _ in range(rng.randint(1, 3))) + "}"
        if kind == 3:
            return "[" + ",".join(value(depth + 1) for _ in range(rng.randint(1, 3))) + space() + "]"
        return [json.dumps(word()), str(rng.randint(-5, 5)), "null"][kind]

    def episodes():
        if rng.random() < 0.2:
            return rng.choice(['"no object"', "7", "null", '[{"x": {"y": 1}}, "s", [1]]'])
        return "{" + ",".join(f"{space()}{json.dumps(word())}{space()}:{space()}{value(0)}{space()}" for _ in range(rng.randint(1, 5))) + "}"

    return space() + "{" + ",".join(f"{space()}{json.dumps(word())}:{episodes()}{space()}" for _ in range(n_files)) + "}" + space()


def in_blocks(text, size):
    """The pieces between quotes by blocks of so many bytes: a piece belongs to the block in which the quote before it lies."""
    data, found, at = text.encode(), {}, 0
    for piece in data.split(b'"'):
        found.setdefault(0 if at == 0 else (at - 1) // size, []).append(piece.decode())
        at += len(piece) + 1
    return [found[k] for k in sorted(found)]


def read(text, size):
    """What the reader's parts give when they are put together by plain loops."""
    inside, depth, out, joints, file = False, 0, [], [], None
    for k, pieces in enumerate(in_blocks(text, size)):
        cut = json_document.Cutter(inside, depth, k == 0)
        mine = []
        for a in range(0, len(pieces), 3):
            mine += cut.add(pa.array(pieces[a : a + 3]))
        quotes, if_out, if_in = json_document.summary(pa.array(pieces))
        depth += if_in if inside else if_out
        inside ^= quotes % 2 == 1
        assert (cut.inside, cut.depth) == (inside, depth)
        if cut.head is not None:
            joints[-1].append(cut.head)
        if cut.began:
            if joints:
                found, told = json_document.between('"'.join(joints[-1]), file)
                out, file = out + found, told
            out += [(f if f is not None else file, e, v) for f, e, v in mine]
            file = cut.file if cut.file is not None else file
            joints.append([])
        joints[-1].append('"'.join(cut.left))
    return out + json_document.between('"'.join(joints[-1]), file)[0]


@pytest.mark.parametrize("seed", range(12))
def test_any_block_size_gives_the_rows_of_a_plain_parser(seed):
    text = document(random.Random(seed), 1 + seed % 5)
    want = plain(text)
    for size in [*range(1, 65), 10_000]:
        got = [(f, e, as_plain(json.loads(v, object_pairs_hook=lambda x: x))) for f, e, v in read(text, size)]
        assert got == want, size


@pytest.mark.parametrize("size,most", [(150, 10**6), (97, 0), (10**6, 10**6)])
def test_splits_of_files(spark, tmp_path, size, most):
    texts = [document(random.Random(s), 3) for s in (60, 61)] + ["", "{}", "[1, 2]", '{"f": {}}']
    for k, t in enumerate(texts):
        (tmp_path / f"{k}.json").write_text(t)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = json_document.members(spark, str(tmp_path), most).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    key = lambda rows: sorted((os.path.basename(p), f, e, json.dumps(v)) for p, f, e, v in rows)
    assert key((r["path"], r["file"], r["episode"], as_plain(json.loads(r["value"], object_pairs_hook=lambda x: x))) for r in got) == key((f"{k}.json", *m) for k, t in enumerate(texts) for m in plain(t))


def test_steps_of_a_document(spark, tmp_path):
    doc = {"f": {"e1": {"metadata": {"n_steps": 2}, "reasoning": {"10": {"task": "b"}, "2": {"task": "a", "plan": None}}}, "e2": {"reasoning": {"x": {"task": "no"}}}, "e3": None}, "g": 5}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    got = [tuple(r) for r in readers.reasoning_document(spark, str(tmp_path)).orderBy("step").collect()]
    assert got == [("f", "e1", 2, 2, "a", None, None, None), ("f", "e1", 2, 10, "b", None, None, None)]
    assert "op_s5_large_document" in QUERIES and "op_s5_large_document" in ORACLES
