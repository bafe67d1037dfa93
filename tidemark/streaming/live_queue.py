"""A live work queue: commands stream in, each record's state is kept by its key, and a timer ends claims that grow too old.

A record is one key, so its commands are taken one after another and a second claim finds it claimed.  A claim that nothing follows is released
by an event-time timer ``lease`` seconds later; one that a later command finds too old is released before that command.  Thus the outcome is that of a
fold over the record's commands in order (``outcomes``, on a finished table), however the stream is cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

COMMANDS = "record string, at timestamp, seq bigint, command string, worker string"
OUTCOMES = "record string, n bigint, at timestamp, command string, worker string, accepted boolean, status string"
_STATE = "n bigint, status string, mode string, worker string, since bigint"
#: What a command asks for and leads to. A hint or an annotation may also come for a record that nobody claimed.
CLAIMS = {"claim_hint": ("available", "hint_claimed", None), "claim_annot": ("hinted", "annot_claimed", "hinted"), "claim_nohint": ("available", "annot_claimed", "nohint")}
CLAIMED = ("hint_claimed", "annot_claimed")
HINTABLE = ("available", "hint_claimed")
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def released(status: str, mode: str | None) -> str:
    """Where a claimed record goes back to: the pool that it was claimed from."""
    return "hinted" if status == "annot_claimed" and mode != "nohint" else "available"


def after(command: str, by: str | None, status: str, mode: str | None, worker: str | None) -> tuple[bool, str, str | None]:
    """``(accepted, status, mode)`` after a command by a worker; a release by a worker needs that worker's own claim."""
    if command in CLAIMS:
        need, to, kind = CLAIMS[command]
        return (True, to, kind) if status == need else (False, status, mode)
    if command == "hint":
        return True, "hinted" if status in HINTABLE else status, mode
    if command == "annotated":
        return True, "annotated", mode
    if command == "release" and status in CLAIMED and (by is None or by == worker):
        return True, released(status, mode), mode
    return False, status, mode


class Leases(StatefulProcessor):
    """Keeps a record's state and its lease's timer."""

    def __init__(self, lease: int):
        self.lease = lease * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("record", _STATE)

    def _known(self):
        s = self.state.get() if self.state.exists() else None
        return [s[0], s[1], s[2], s[3], s[4]] if s else [0, "available", None, None, None]

    def _expire(self, key, s) -> Row:
        end = s[4] + self.lease
        s[0], s[1], worker, s[3], s[4] = s[0] + 1, released(s[1], s[2]), s[3], None, None
        return _row(key, s, end, "expire", worker, True)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s = self._known()
        began = s[4]
        for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            at = round(r["at"].timestamp() * 1000)
            if s[4] is not None and at >= s[4] + self.lease:
                yield self._expire(key, s)
            before = s[1]
            ok, s[1], s[2] = after(r["command"], r["worker"], s[1], s[2], s[3])
            s[0] += 1
            if r["command"] in CLAIMS and ok:
                s[3], s[4] = r["worker"], at
            elif s[1] != before:
                s[3], s[4] = None, None
            yield _row(key, s, at, r["command"], r["worker"], ok)
        if s[4] != began:
            if began is not None:
                self.handle.deleteTimer(began + self.lease)
            if s[4] is not None:
                self.handle.registerTimer(s[4] + self.lease)
        self.state.update(tuple(s))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s = self._known()
        if s[4] is not None and s[4] + self.lease <= expiredTimerInfo.getExpiryTimeInMs():
            yield self._expire(key, s)
            self.state.update(tuple(s))

    def close(self) -> None:
        pass


def _row(key, s, at: int, command: str, worker: str | None, ok: bool) -> Row:
    from datetime import datetime, timezone

    return Row(record=key[0], n=s[0], at=datetime.fromtimestamp(at / 1000, timezone.utc), command=command, worker=worker, accepted=ok, status=s[1])


def live(commands: DataFrame, lease: int, late: str = "0 seconds") -> DataFrame:
    """The outcome of each command of a stream of ``COMMANDS``, and an ``expire`` row for each claim that ended by its age.

    A record's commands must come in order of ``at`` and ``seq`` from batch to batch; inside a batch they are sorted, so a task holds one record's commands of a
    batch.  Commands older than the watermark (the latest ``at`` less ``late``) are dropped.  A null record, time or command is left out.
    """
    rows = commands.where("record is not null and at is not null and command is not null").withWatermark("at", late)
    return rows.groupBy("record").transformWithState(Leases(lease), OUTCOMES, "Append", "EventTime")


def start(outcomes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the outcomes of what there is to the table at ``path``, then stop; with the same checkpoint a later call goes on from here."""
    spark = outcomes.sparkSession
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    try:
        return outcomes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def status(outcomes: DataFrame) -> DataFrame:
    """``(record, status, n)``: each record's state after its last outcome."""
    return outcomes.groupBy("record").agg(F.max_by("status", "n").alias("status"), F.max("n").alias("n"))


def ask(states: DataFrame, worker: str, n: int, command: str, at: Column) -> DataFrame:
    """Commands by which a worker claims the first ``n`` records of the wanted status; another's claim that comes first wins."""
    picked = states.where(F.col("status") == CLAIMS[command][0]).orderBy("record").limit(n)
    return picked.select("record", at.alias("at"), F.lit(0).cast("bigint").alias("seq"), F.lit(command).alias("command"), F.lit(worker).alias("worker"))


def outcomes(commands: DataFrame, lease: int, now: Column) -> DataFrame:
    """The rows of ``live`` for a finished table of commands, as a fold in columns; claims whose lease ends before ``now`` have expired."""
    listed = F.array_sort(F.collect_list(F.struct("at", "seq", "command", "worker")))
    rows = commands.where("record is not null and at is not null and command is not null").groupBy("record").agg(listed.alias("c"))
    ms = lambda t: F.unix_millis(t)
    none = F.lit(None).cast("string")
    row_type = "array<struct<n:bigint,at:timestamp,command:string,worker:string,accepted:boolean,status:string>>"
    begin = F.struct(F.lit("available").alias("status"), none.alias("mode"), none.alias("worker"), F.lit(None).cast("bigint").alias("since"), F.array().cast(row_type).alias("out"))

    def back(s):
        return F.when((s["status"] == "annot_claimed") & ~s["mode"].eqNullSafe("nohint"), "hinted").otherwise("available")

    def expired(s, until):
        end = s["since"] + lease * 1000
        row = F.struct((F.size(s["out"]) + 1).cast("bigint").alias("n"), F.timestamp_millis(end).alias("at"), F.lit("expire").alias("command"), s["worker"].alias("worker"), F.lit(True).alias("accepted"), back(s).alias("status"))
        gone = F.struct(back(s).alias("status"), s["mode"].alias("mode"), none.alias("worker"), F.lit(None).cast("bigint").alias("since"), F.concat(s["out"], F.array(row)).alias("out"))
        return F.when(s["since"].isNotNull() & until(end), gone).otherwise(s)

    def step(s, c):
        claims = [((c["command"] == w) & (s["status"] == need), to, mode) for w, (need, to, mode) in CLAIMS.items()]
        won = claims[0][0] | claims[1][0] | claims[2][0]
        freed = (c["command"] == "release") & s["status"].isin(*CLAIMED) & (c["worker"].isNull() | c["worker"].eqNullSafe(s["worker"]))
        status, mode = s["status"], s["mode"]
        for wins, to, kind in claims:
            status, mode = F.when(wins, to).otherwise(status), F.when(wins, F.lit(kind)).otherwise(mode)
        status = F.when(freed, back(s)).when(c["command"] == "annotated", "annotated").when((c["command"] == "hint") & s["status"].isin(*HINTABLE), "hinted").otherwise(status)
        keeps = (status == s["status"]) & ~won
        worker = F.when(won, c["worker"]).when(keeps, s["worker"])
        since = F.when(won, ms(c["at"])).when(keeps, s["since"])
        row = F.struct((F.size(s["out"]) + 1).cast("bigint").alias("n"), c["at"].alias("at"), c["command"].alias("command"), c["worker"].alias("worker"), (won | freed | c["command"].isin("hint", "annotated")).alias("accepted"), status.alias("status"))
        return F.struct(status.alias("status"), mode.alias("mode"), worker.alias("worker"), since.alias("since"), F.concat(s["out"], F.array(row)).alias("out"))

    folded = F.aggregate("c", begin, lambda s, c: step(expired(s, lambda end: ms(c["at"]) >= end), c), lambda s: expired(s, lambda end: end < ms(now))["out"])
    return rows.select("record", F.inline(folded))
