"""Large JSON documents ``{file: {episode: value}}`` of one object each, split over tasks wherever they are cut.

The text source reads a file with the quote as its line end, so that pieces between quotes come from any range of its
bytes, even if the document has one line.  Whether a piece is inside a string, and how deep, depends on all that stands before it.  So
each block (a file split) is summed up for both cases: how often the state flips, and how much deeper it ends if it begins outside and
if it begins inside a string.  A prefix scan over these small rows gives each block's beginning.  Then every block
gives the episodes that end in it, and what is left at its two borders is put together with the neighbours' parts and read likewise.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import written

#: An episode's value begins this deep; a point where the depth falls back to it lies between episodes.
LEVEL = 2
_SPACE = re.compile(r"[ \t\r\n]*")
_READER = json.JSONDecoder(strict=False)
BLOCKS = "path string, start bigint, flips boolean, deeper_out bigint, deeper_in bigint, pieces bigint"
PARTS = "path string, start bigint, part int, joint boolean, last_file string, file string, episode string, value string"


def _steps(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece: whether the quote after it is a real one, and how many brackets it opens and closes."""
    count = lambda c: pc.count_substring(pieces, c).to_numpy(zero_copy_only=False).astype(np.int64)
    real = np.ones(len(pieces), dtype=bool)
    for k in np.flatnonzero(pc.ends_with(pieces, "\\").to_numpy(zero_copy_only=False)).tolist():
        p = pieces[k].as_py()
        real[k] = (len(p) - len(p.rstrip("\\"))) % 2 == 0
    return real, count("{") + count("["), count("}") + count("]")


def summary(pieces: pa.Array) -> tuple[int, int, int]:
    """Real quotes of a run of pieces, and its change of depth if it begins outside and if it begins inside a string."""
    real, opened, closed = _steps(pieces)
    flipped = (np.cumsum(real) - real) % 2 == 1
    change = opened - closed
    return int(real.sum()), int(change[~flipped].sum()), int(change[flipped].sum())


def _ends(piece: str, depth: int) -> list[int]:
    """Places in a piece outside strings right after an episode's last bracket."""
    out = []
    for k, c in enumerate(piece):
        if c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == LEVEL:
                out.append(k + 1)
    return out


class Cutter:
    """Takes the pieces of one block in order, from a known state on; keeps no more than a batch and the episode that is being read."""

    def __init__(self, inside: bool, depth: int, fresh: bool):
        self.inside, self.depth = inside, depth
        self.left: list[str] = []  # pieces not given out yet; a quote stands between any two
        self.began = fresh  # whether a point between episodes has been met, as the document's begin is
        self.head: str | None = None
        self.file: str | None = None

    def add(self, pieces: pa.Array) -> list[tuple[str | None, str, str]]:
        real, opened, closed = _steps(pieces)
        inside = (np.cumsum(real) - real + self.inside) % 2 == 1
        change = np.where(inside, 0, opened - closed)
        before = self.depth + np.cumsum(change) - change
        near = np.flatnonzero(~inside & (before - closed <= LEVEL) & (closed > 0)).tolist()
        texts = pieces.to_pylist()
        out = []
        if not self.began:
            for k in near:
                if at := _ends(texts[k], int(before[k])):
                    self.head = '"'.join([*self.left, *texts[:k], texts[k][: at[0]]])
                    self.left, self.began = [], True
                    texts, near = [texts[k][at[0] :], *texts[k + 1 :]], [j - k for j in near if j >= k]
                    before = before[k:].copy()
                    before[0] = LEVEL
                    break
        if self.began:
            for k in reversed(near):
                if at := _ends(texts[k], int(before[k])):
                    out, self.file = between('"'.join([*self.left, *texts[:k], texts[k][: at[-1]]]), self.file)
                    texts, self.left = [texts[k][at[-1] :], *texts[k + 1 :]], []
                    break
        self.left += texts
        self.inside = bool((int(real.sum()) + self.inside) % 2)
        self.depth += int(change.sum())
        return out


def between(text: str, file: str | None) -> tuple[list[tuple[str | None, str, str]], str | None]:
    """``(file, episode, value)`` of a text from one point between episodes, or the document's begin, to another, and the last file's name.

    ``file`` is the name in force at its begin, null if that stands further ahead.  Members of other shapes are passed over.
    """
    out = []
    at = _SPACE.match(text).end()
    # Depth 0 is met at a document's begin and after its end, else the text begins right after a value two levels deep.
    depth = 0 if text[at : at + 1] in ("{", "[") else LEVEL
    while (at := _SPACE.match(text, at).end()) < len(text):
        c = text[at]
        if c in "{[" and depth < LEVEL:
            depth, at = depth + 1, at + 1
        elif c in "}]":
            depth, at = depth - 1, at + 1
        elif c == ",":
            at += 1
        else:
            value, end = _READER.raw_decode(text, at)
            colon = _SPACE.match(text, end).end()
            if c != '"' or text[colon : colon + 1] != ":":
                at = end  # an element of a list, or a plain value
            elif depth < LEVEL:
                file, at = value, colon + 1
            else:
                begin = _SPACE.match(text, colon + 1).end()
                _, at = _READER.raw_decode(text, begin)
                out.append((file, value, text[begin:at]))
    return out, file


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    found = spark.read.option("lineSep", '"').option("recursiveFileLookup", "true").text(path)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Stretches of rows of one block."""
    for batch in batches:
        start = batch.column("start").to_numpy()
        path = pc.run_end_encode(batch.column("path")).run_ends.to_numpy()
        cuts = np.union1d(np.flatnonzero(np.diff(start)) + 1, path)
        for a, b in zip([0, *cuts.tolist()], cuts.tolist(), strict=False):
            yield batch.column("path")[a].as_py(), int(start[a]), batch.slice(a, b - a)


def _sum_up(batches):
    rows: dict[tuple[str, int], list[int]] = {}
    for path, start, run in _runs(batches):
        total = rows.setdefault((path, start), [0, 0, 0, 0])
        quotes, out, into = summary(run.column("value"))
        if total[0] % 2:
            out, into = into, out
        for k, v in enumerate((quotes, out, into, run.num_rows)):
            total[k] += v
    cells = [(p, s, q % 2 == 1, o, i, n) for (p, s), (q, o, i, n) in rows.items()]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in cells], t) for k, t in enumerate(kinds)], names=[c.split(" ")[0] for c in BLOCKS.split(", ")])


def blocks(pieces: DataFrame) -> DataFrame:
    """``(path, start, inside, depth, first)`` of each block: the state in which it begins.

    The scan runs over one row of under 100 bytes for each block: the flips of all blocks before say which of the two
    depths a block adds, then these are added up.
    """
    told = pieces.mapInArrow(_sum_up, BLOCKS)
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("flips").cast("int")).over(before), F.lit(0)) % 2 == 1
    known = told.withColumn("inside", inside).withColumn("deeper", F.when(F.col("inside"), F.col("deeper_in")).otherwise(F.col("deeper_out")))
    depth = F.coalesce(F.sum("deeper").over(before), F.lit(0)).cast("int")
    first = F.row_number().over(Window.partitionBy("path").orderBy("start")) == 1
    return known.select("path", "start", "inside", depth.alias("depth"), first.alias("first"))


def _cut(batches):
    names = [c.split(" ")[0] for c in PARTS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string()]

    def rows(cells):
        return pa.RecordBatch.from_arrays([pa.array([c[k] for c in cells], t) for k, t in enumerate(kinds)], names=names)

    def border(path: str, start: int, cutter: Cutter) -> list[tuple]:
        """What is left of a block: part 0 before its first point between episodes, part 1 after its last, which begins a new joint."""
        head = [] if cutter.head is None else [(path, start, 0, False, None, None, None, cutter.head)]
        return [*head, (path, start, 1, cutter.began, cutter.file, None, None, '"'.join(cutter.left))]

    key, cutter = None, None
    for path, start, run in _runs(batches):
        if key != (path, start):
            if cutter:
                yield rows(border(*key, cutter))
            key = path, start
            inside, depth, first = (run.column(c)[0].as_py() for c in ("inside", "depth", "first"))
            cutter = Cutter(inside, depth, first)
        if cells := [(path, start, None, None, None, f, e, v) for f, e, v in cutter.add(run.column("value"))]:
            yield rows(cells)
    if cutter:
        yield rows(border(*key, cutter))


def _join_up(batches):
    for batch in batches:
        cells = []
        for path, start, text in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "value")), strict=True):
            found, last = between(text, None)
            cells += [(path, start, last, f, e, v) for f, e, v in found] or [(path, start, last, None, None, None)]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in cells], t) for k, t in enumerate(kinds)], names=["path", "start", "last_file", "file", "episode", "value"])


def members(spark: SparkSession, path: str | list[str], most_blocks: int = 1_000_000) -> DataFrame:
    """``(path, file, episode, value)``: the JSON text of every member two levels deep of the objects at ``path``, one object in each file.

    A file's blocks are Spark's file splits, so a large document is
    read by many tasks twice, and each holds a batch and one episode.  Members of other shapes (a file whose value is no object, an element of a list) are
    passed over; a repeated name gives a row each time; an empty file gives none.  Text that is no JSON ends the job.  Blocks' states (under 100
    bytes for each split) are sent to all tasks up to ``most_blocks`` of them; beyond, pieces meet them in a join and are sorted again.
    """
    pieces = _pieces(spark, path)
    states = written(blocks(pieces), "json-blocks")
    if states.count() <= most_blocks:
        placed = pieces.join(F.broadcast(states), ["path", "start"])
    else:
        numbered = pieces.withColumn("__n", F.monotonically_increasing_id())
        placed = numbered.join(states, ["path", "start"]).repartition("path", "start").sortWithinPartitions("path", "start", "__n")
    parts = written(placed.select("path", "start", "value", "inside", "depth", "first").mapInArrow(_cut, PARTS), "json-parts")
    # Borders: a joint begins with a block's last part and goes on to the first part of the next block that has one.
    rest = parts.where("part is not null")
    order = Window.partitionBy("path").orderBy("start", "part")
    slim = rest.select("path", "start", "part", "joint").withColumn("at", F.last(F.when(F.col("joint"), F.col("start")), True).over(order))
    texts = rest.select("path", "start", "part", "value").join(slim, ["path", "start", "part"])
    # Inside a joint, a block without a point between episodes gives its whole text; a quote follows each block but for its head's end.
    in_order = F.array_sort(F.collect_list(F.struct("start", "part", "value")))
    glued = texts.groupBy("path", F.col("at").alias("start")).agg(F.array_join(F.transform(in_order, lambda t: t["value"]), '"').alias("value"))
    joined = written(glued.mapInArrow(_join_up, "path string, start bigint, last_file string, file string, episode string, value string"), "json-joints")
    # Names of files in force: the last one told by a block, or by the joint that begins with it, up to where it is asked for.
    told = rest.where("part = 1").select("path", F.col("start").alias("s"), F.lit(0).alias("step"), F.col("last_file").alias("told"))
    told = told.unionByName(joined.select("path", F.col("start").alias("s"), F.lit(1).alias("step"), F.col("last_file").alias("told")).distinct())
    names = told.groupBy("path", "s", "step").agg(F.max("told").alias("told"))
    before = Window.partitionBy("path").orderBy("s", "step")
    names = names.select("path", "s", "step", F.last("told", True).over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("in_force"))
    asked = parts.where("part is null").select("path", F.col("start").alias("s"), F.lit(0).alias("step"), "file", "episode", "value")
    asked = asked.unionByName(joined.where("episode is not null").select("path", F.col("start").alias("s"), F.lit(1).alias("step"), "file", "episode", "value"))
    found = asked.join(names, ["path", "s", "step"])
    return found.select("path", F.coalesce("file", "in_force").alias("file"), "episode", "value").where("file is not null")
