"""A work queue as a table of commands: a record's state is what its commands have made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The states, and the command that leads from one to the next.
TRANSITIONS = {("available", "claim"): "hint_claimed", ("hint_claimed", "submit"): "hinted", ("hinted", "claim"): "annot_claimed", ("annot_claimed", "submit"): "annotated", ("hint_claimed", "release"): "available", ("annot_claimed", "release"): "hinted"}


def next_state(state: Column, command: Column) -> Column:
    """The state after a command; a command that doesn't fit changes nothing, exclude always does, and undo leads back from it."""
    out = F.when(command == "exclude", F.lit("excluded")).when((state == "excluded") & (command == "undo"), F.lit("available"))
    for (before, word), after in TRANSITIONS.items():
        out = out.when((state == before) & (command == word), F.lit(after))
    return out.otherwise(state)


def states(commands: DataFrame, key: str, order: list[str], command: str) -> DataFrame:
    """``(key, state, n)``: every record's state after all its commands in order, from available on."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(command).alias("__c"))))
    folded = F.aggregate(listed, F.lit("available"), lambda s, c: next_state(s, c["__c"]))
    return commands.groupBy(key).agg(folded.alias("state"), F.count(F.lit(1)).alias("n"))


def claim(records: DataFrame, status: str, n: int, order: str) -> DataFrame:
    """The first ``n`` records with a status, to be claimed."""
    return records.where(F.col("status") == status).orderBy(order).limit(n)


def stale(records: DataFrame, now: Column, seconds: int, claimed_at: str = "claimed_at") -> DataFrame:
    """Records whose claim is ``seconds`` old or older."""
    return records.where(F.unix_timestamp(now) - F.unix_timestamp(claimed_at) >= seconds)
