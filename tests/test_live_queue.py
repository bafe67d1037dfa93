"""The live queue against plain steps, a fold, and itself after a restart; versioned tables."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.sources import versions
from tidemark.streaming import live_queue as q

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
WORDS = ["claim_hint", "claim_annot", "claim_nohint", "hint", "annotated", "release", "nonsense"]


def commands(rng, n, records):
    """Commands in order of time, a few at the same time."""
    at, out = START, []
    for k in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 7, 40]))
        out.append((f"r{rng.randrange(records)}", at, k, rng.choice(WORDS), rng.choice(["a", "b", None])))
    return out


def plain(rows, lease, now):
    """Outcomes by the definition, one record at a time."""
    out = []
    for record in sorted({r[0] for r in rows}):
        status, mode, worker, since, n = "available", None, None, None, 0

        def end_lease():
            nonlocal status, worker, since, n
            n += 1
            status = "hinted" if status == "annot_claimed" and mode == "hinted" else "available"
            out.append((record, n, since + timedelta(seconds=lease), "expire", worker, True, status))
            worker = since = None

        for _, at, _, word, by in [r for r in rows if r[0] == record]:
            if since is not None and at - since >= timedelta(seconds=lease):
                end_lease()
            n, was, ok = n + 1, status, True
            if (word, status) in (("claim_hint", "available"), ("claim_nohint", "available"), ("claim_annot", "hinted")):
                status, mode, worker, since = ("hint_claimed" if word == "claim_hint" else "annot_claimed"), {"claim_nohint": "nohint", "claim_annot": "hinted"}.get(word), by, at
            elif word == "hint":
                status = "hinted" if status in ("available", "hint_claimed") else status
            elif word == "annotated":
                status = "annotated"
            elif word == "release" and status.endswith("claimed") and by in (None, worker):
                status = "hinted" if status == "annot_claimed" and mode == "hinted" else "available"
            else:
                ok = False
            if status != was and not word.startswith("claim"):
                worker = since = None
            out.append((record, n, at, word, by, ok, status))
        if since is not None and since + timedelta(seconds=lease) < now:
            end_lease()
    return out


def stream(spark, tmp_path, batches, lease, name="s", more=None):
    """Outcomes of batches of commands, each written and then streamed with the same checkpoint."""
    source, out = f"{tmp_path}/{name}-in", f"{tmp_path}/{name}-out"
    for rows in batches:
        spark.createDataFrame(rows, q.COMMANDS).coalesce(1).write.mode("append").parquet(source)
        query = q.start(q.live(spark.readStream.schema(q.COMMANDS).parquet(source), lease), out, f"{tmp_path}/{name}-state")
        query.awaitTermination()
    return spark.read.schema(q.OUTCOMES).parquet(out)


def as_rows(found):
    return sorted(((r["record"], r["n"], r["at"].replace(tzinfo=timezone.utc), r["command"], r["worker"], r["accepted"], r["status"]) for r in found.withColumn("at", F.col("at").cast("timestamp")).collect()), key=str)


@pytest.fixture(scope="module", autouse=True)
def utc():
    import os
    import time

    os.environ["TZ"] = "UTC"
    time.tzset()


@pytest.mark.parametrize("seed,lease", [(1, 30), (2, 100), (3, 100_000)])
def test_fold_is_the_definition(spark, seed, lease):
    rows = commands(random.Random(seed), 400, 9)
    now = rows[-1][1]
    got = q.outcomes(spark.createDataFrame([*rows, (None, now, 0, "hint", None)], q.COMMANDS), lease, F.lit(now))
    assert as_rows(got) == sorted(plain(rows, lease, now), key=str)


def test_stream_is_the_fold_over_restarts(spark, tmp_path):
    rows = commands(random.Random(4), 240, 7)
    now = rows[-1][1]
    cuts = [0, 60, 61, 150, 240]
    got = stream(spark, tmp_path, [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], 55)
    assert as_rows(got) == sorted(plain(rows, 55, now), key=str)
    last = {r["record"]: (r["status"], r["n"]) for r in q.status(got).collect()}
    want = {}
    for r in sorted(plain(rows, 55, now), key=lambda r: (r[0], r[1])):
        want[r[0]] = r[6], r[1]
    assert last == want


def test_timer_alone_releases_and_one_claim_wins(spark, tmp_path):
    late = START + timedelta(hours=2)
    first = [("x", START, 0, "claim_hint", "a"), ("x", START, 1, "claim_hint", "b"), ("x", START + timedelta(seconds=1), 2, "claim_nohint", "c")]
    got = stream(spark, tmp_path, [first, [("other", late, 3, "hint", None)], [("x", late + timedelta(seconds=1), 4, "claim_hint", "b")]], 60)
    rows = as_rows(got.where("record = 'x'"))
    assert Counter((r[3], r[4], r[5]) for r in rows) == {("claim_hint", "a", True): 1, ("claim_hint", "b", False): 1, ("claim_nohint", "c", False): 1, ("expire", "a", True): 1, ("claim_hint", "b", True): 1}
    assert [r[2] for r in rows if r[3] == "expire"] == [START + timedelta(seconds=60)]
    states = q.status(got)
    asked = q.ask(states, "w", 5, "claim_annot", F.lit(late))
    assert [tuple(r)[0] for r in asked.collect()] == ["other"]


def test_versions_replace_a_table_whole(spark, tmp_path):
    path = str(tmp_path / "table")
    assert versions.current(spark, path) == 0
    assert versions.update(spark, path, lambda old: spark.range(3)) == 1
    assert versions.update(spark, path, lambda old: old.union(spark.range(10, 12))) == 2
    assert sorted(r["id"] for r in versions.read(spark, path).collect()) == [0, 1, 2, 10, 11] and versions.read(spark, path, 1).count() == 3
    with pytest.raises(versions.Conflict):
        versions.publish(spark.range(1), path, 1)
    assert len(list((tmp_path / "table").glob("data-*"))) == 2

    def slow(old):
        if versions.current(spark, path) == 2:
            versions.publish(spark.range(7), path, 2)  # another writer comes in between
        return old.union(spark.range(1))

    assert versions.update(spark, path, slow) == 4 and versions.read(spark, path).count() == 8
    versions.prune(spark, path, 1)
    assert len(list((tmp_path / "table").glob("data-*"))) == 1 and versions.read(spark, path).count() == 8
