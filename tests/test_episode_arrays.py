"""Chunked arrays of episodes: round trip, pushed filters, chunks opened, windows over file borders."""

from __future__ import annotations

import os

import pytest

from tidemark.sources import episode_arrays as store


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("arrays"))
    rows = [(e, t, [e + t / 8, -t / 8], bytes([t % 256]) * (t % 5), None if t == 3 else f"{e}:{t}") for e, n in ((1, 100), (2, 1), (12, 37), (-4, 8)) for t in range(n)]
    rows += [(None, 0, [0.0], b"", ""), (9, None, [0.0], b"", "")]
    frames = spark.createDataFrame(rows, "e bigint, t bigint, qpos array<double>, rgb binary, note string")
    files = store.write(frames, path, "e", "t", ["qpos", "rgb", "note"], chunk_frames=8, file_frames=40)
    return path, rows[:-2], files


def test_round_trip_and_manifest(spark, stored):
    path, rows, files = stored
    got = store.frames_of(spark, path).collect()
    assert sorted((r["episode"], r["frame"], r["qpos"], bytes(r["rgb"]), r["note"] or "") for r in got) == sorted((e, t, q, b, n or "") for e, t, q, b, n in rows)
    assert sorted((r["episode"], r["first"], r["frames"]) for r in files.collect()) == [(-4, 0, 8), (1, 0, 40), (1, 40, 40), (1, 80, 20), (2, 0, 1), (12, 0, 37)]
    assert not [f for f in os.listdir(path) if f.startswith(".episode") and not f.endswith(".crc")]


@pytest.mark.parametrize("low,high", [(0, 1), (7, 9), (16, 24), (38, 42), (95, 300), (100, 101), (5, 5)])
def test_a_range_opens_only_its_chunks(spark, stored, low, high):
    path, rows, _ = stored
    found = store.frames_of(spark, path, "qpos array<double>, opened bigint").where(f"episode = 1 and frame >= {low} and frame < {high}")
    got = found.collect()
    assert sorted((r["frame"], r["qpos"]) for r in got) == [(t, q) for e, t, q, _, _ in rows if e == 1 and low <= t < high]
    opened = {}
    for r in got:
        opened[r["frame"] // 40] = max(opened.get(r["frame"] // 40, 0), r["opened"])
    assert sum(opened.values()) == len({(t // 40, t % 40 // 8) for t in range(low, min(high, 100))})


def test_planned_files_follow_the_filters(stored):
    path, _, _ = stored
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual
    from pyspark.sql.types import StructType

    def planned(*filters, size="1"):
        reader = store._Reader(StructType.fromDDL("episode bigint, frame bigint, qpos array<double>"), {"path": path, "partitionbytes": size})
        left = list(reader.pushFilters(list(filters)))
        return [[(e, first) for e, first, _ in p.files] for p in reader.partitions()], left

    assert planned(EqualTo(("episode",), 1), GreaterThan(("frame",), 39))[0] == [[(1, 40)], [(1, 80)]]
    assert planned(In(("episode",), (2, 12)), size=str(1 << 30))[0] == [[(2, 0), (12, 0)]]
    assert planned(EqualTo(("episode",), 1), EqualTo(("episode",), 2))[0] == [[]]
    kept = IsNotNull(("frame",))
    assert planned(kept, LessThanOrEqual(("frame",), -1)) == ([[]], [kept])


@pytest.mark.parametrize("horizon", [1, 5, 50])
def test_windows_repeat_the_last_value(spark, stored, horizon):
    path, rows, _ = stored
    asked = [(1, 0, "a"), (1, 38, "b"), (1, 38, "b"), (1, 99, "c"), (1, 100, "no"), (2, 0, "d"), (7, 0, "no"), (12, 30, "e"), (None, 1, "no"), (1, None, "no"), (1, -1, "no")]
    got = store.at_frames(spark.createDataFrame(asked, "episode bigint, frame bigint, tag string"), path, "note", horizon, handles=1).collect()
    own = {(e, t): n for e, t, _, _, n in rows}
    last = {1: 99, 2: 0, 12: 36}
    want = [(e, t, g, [own[e, min(t + k, last[e])] for k in range(horizon)]) for e, t, g in asked if g != "no"]
    assert sorted(map(str, ((r["episode"], r["frame"], r["tag"], list(r["values"])) for r in got))) == sorted(map(str, want))


def test_handles_are_bounded(stored):
    path, _, files = stored
    cache = store.Handles(2)
    names = [r["file"] for r in files.collect()]
    for n in names + names:
        cache.get(f"{path}/{n}")
    assert len(cache.files) == 2 and cache.get(f"{path}/{names[-1]}") is cache.files[f"{path}/{names[-1]}"]


def test_damaged_and_gapped_files_are_told(spark, tmp_path):
    (tmp_path / "x.epar").write_bytes(b"short")
    with pytest.raises(ValueError):
        store.EpisodeFile(str(tmp_path / "x.epar"))
    with pytest.raises(Exception, match="gaps"):
        store.write(spark.createDataFrame([(1, 0, 1.0), (1, 2, 1.0)], "e int, t int, v double"), str(tmp_path / "g"), "e", "t", ["v"])
    empty = store.write(spark.createDataFrame([], "e int, t int, v double"), str(tmp_path / "e"), "e", "t", ["v"])
    assert empty.count() == 0 and store.frames_of(spark, str(tmp_path / "e"), "v double").count() == 0
