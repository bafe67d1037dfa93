"""Chunked arrays of episodes in files of their own, as a Spark data source with planned partitions and pushed filters.

A file holds a run of one episode's frames: for every array its chunks of some frames each, then an index of all chunks, then the index's length.  A reader takes the
index first and opens only the chunks whose frames and arrays are asked for.  A manifest table next to the files says which frames each one holds, so whole files are
passed over before any is opened.  Frames of a long episode are dealt over several files, so none of them is a hot task.

    write(frames, path, "episode_id", "t", ["qpos"])
    frames_of(spark, path, "qpos array<double>").where("episode = 7 and frame >= 100 and frame < 200")
"""

from __future__ import annotations

import json
import struct
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

MAGIC = b"EPAR1\n"
_KEYS = [T.StructField("episode", T.LongType()), T.StructField("frame", T.LongType())]
MANIFEST = "episode bigint, first bigint, frames bigint, file string, bytes bigint, kinds string"


def place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class EpisodeFile:
    """One file: its index is read when it is opened, a chunk when one of its frames is asked for."""

    def __init__(self, path: str):
        system, inner = place(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        tail = self.file.read_at(8 + len(MAGIC), max(0, size - 8 - len(MAGIC)))
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is no whole file of episode arrays")
        (length,) = struct.unpack("<q", tail[:8])
        self.index = json.loads(self.file.read_at(length, size - 8 - len(MAGIC) - length))
        self.opened = 0

    def chunks(self, array: str, low: int, high: int) -> Iterator[tuple[int, pa.Array]]:
        """``(frame, values)`` of the chunks of an array that hold any frame from ``low`` up to ``high``, cut to these."""
        for first, n, offset, size in self.index["arrays"].get(array, []):
            if first < high and first + n > low:
                self.opened += 1
                with pa.ipc.open_stream(pa.BufferReader(self.file.read_at(size, offset))) as stream:
                    values = stream.read_all().column(0).combine_chunks()
                values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
                a, b = max(low - first, 0), min(high - first, n)
                yield first + a, values.slice(a, b - a)

    def close(self) -> None:
        self.file.close()


class Handles:
    """The files opened last, up to a number of them; the one unused for longest is closed."""

    def __init__(self, most: int = 32):
        self.most, self.files = most, OrderedDict()

    def get(self, path: str) -> EpisodeFile:
        if path in self.files:
            self.files.move_to_end(path)
        else:
            if len(self.files) >= self.most:
                self.files.popitem(last=False)[1].close()
            self.files[path] = EpisodeFile(path)
        return self.files[path]


class _Writer:
    """One file in the making: chunks go out as they fill, the name appears when the file is whole."""

    def __init__(self, folder: str, episode: int, part: int, arrays: list[str], chunk_frames: int):
        self.system, inner = place(folder)
        self.system.create_dir(inner, recursive=True)
        self.name = f"episode{episode}_{part:05d}.epar"
        self.final, self.draft = f"{inner}/{self.name}", f"{inner}/.{self.name}.{id(self)}"
        self.out = self.system.open_output_stream(self.draft)
        self.arrays, self.chunk_frames = arrays, chunk_frames
        self.episode, self.first, self.frames, self.at = episode, None, 0, 0
        self.waiting: list[pa.RecordBatch] = []
        self.index = {a: [] for a in arrays}

    def add(self, frame: int, rows: pa.RecordBatch) -> None:
        if self.first is None:
            self.first = frame
        self.waiting.append(rows)
        while sum(b.num_rows for b in self.waiting) >= self.chunk_frames:
            self._chunk(self.chunk_frames)

    def _chunk(self, n: int) -> None:
        table = pa.Table.from_batches(self.waiting).combine_chunks()
        now, rest = table.slice(0, n), table.slice(n)
        for a in self.arrays:
            sink = pa.BufferOutputStream()
            column = now.select([a]).combine_chunks()
            with pa.ipc.new_stream(sink, column.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(column)
            raw = sink.getvalue()
            self.out.write(raw)
            self.index[a].append((self.first + self.frames, n, self.at, raw.size))
            self.at += raw.size
        self.frames += n
        self.waiting = rest.to_batches() if rest.num_rows else []

    def close(self) -> tuple:
        if n := sum(b.num_rows for b in self.waiting):
            self._chunk(n)
        raw = json.dumps({"episode": self.episode, "arrays": self.index}).encode()
        self.out.write(raw + struct.pack("<q", len(raw)) + MAGIC)
        self.out.close()
        self.system.move(self.draft, self.final)
        return self.episode, self.first, self.frames, self.name, self.at + len(raw) + 8 + len(MAGIC)


def write(frames: DataFrame, path: str, episode: str, frame: str, arrays: list[str], chunk_frames: int = 64, file_frames: int = 4096) -> DataFrame:
    """Writes the arrays of all frames below ``path`` and gives the manifest.

    An episode's frames are numbered from any start without gaps (a gap ends the job); null episodes and frames are left out.  A
    task writes a file at a time from sorted rows and holds one chunk of it.  A file gets its name when it is whole, and a task that runs again writes the same ones.
    """
    spark = frames.sparkSession
    kinds = json.dumps({a: frames.schema[a].dataType.simpleString() for a in arrays})
    part = F.floor(F.col(frame) / file_frames).cast("bigint")
    rows = frames.where(F.col(episode).isNotNull() & F.col(frame).isNotNull()).select(F.col(episode).cast("bigint").alias("episode"), F.col(frame).cast("bigint").alias("frame"), part.alias("part"), *arrays)
    sorted_rows = rows.repartition("episode", "part").sortWithinPartitions("episode", "part", "frame")

    def run(batches):
        writer, key, cells = None, None, []
        for batch in batches:
            ids = list(zip(batch.column("episode").to_pylist(), batch.column("part").to_pylist(), strict=True))
            at = batch.column("frame").to_pylist()
            begin = 0
            for k in range(1, len(ids) + 1):
                if k == len(ids) or ids[k] != ids[begin]:
                    if ids[begin] != key:
                        if writer:
                            cells.append(writer.close())
                        key = ids[begin]
                        writer, expected = _Writer(path, *key, arrays, chunk_frames), at[begin]
                    if at[begin:k] != list(range(expected, expected + k - begin)):
                        raise ValueError(f"episode {key[0]}: frames from {expected} on have gaps or repeats")
                    expected += k - begin
                    writer.add(at[begin], batch.slice(begin, k - begin).select(arrays))
                    begin = k
        if writer:
            cells.append(writer.close())
        columns = [pa.array([c[k] for c in cells], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([kinds] * len(cells), pa.string())], names=[c.split(" ")[0] for c in MANIFEST.split(", ")])

    sorted_rows.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{path}/_manifest")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: its episode, first frame, number of frames, name and bytes."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")


class _Part(InputPartition):
    def __init__(self, files: list[tuple]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options):
        self.schema, self.path = schema, options["path"]
        self.bytes = int(options.get("partitionbytes", 64 << 20))
        self.low, self.high = 0, 1 << 62
        self.episodes: set[int] | None = None

    def pushFilters(self, filters):
        """Comparisons of ``episode`` and ``frame`` with numbers are taken over, all others go back to Spark."""
        for f in filters:
            column = getattr(f, "attribute", None)
            value = getattr(f, "value", None)
            if column == ("episode",) and isinstance(f, (EqualTo, In)) and value is not None:
                chosen = set(value) if isinstance(f, In) else {value}
                self.episodes = chosen if self.episodes is None else self.episodes & chosen
            elif column == ("frame",) and isinstance(f, (GreaterThanOrEqual, GreaterThan, EqualTo, LessThan, LessThanOrEqual)) and isinstance(value, int):
                if isinstance(f, (GreaterThanOrEqual, GreaterThan, EqualTo)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, value + (not isinstance(f, LessThan)))
            else:
                yield f

    def partitions(self):
        """Files that hold asked frames, in order of episode and frame, together up to some bytes; the manifest is read by columns and row groups."""
        import pyarrow.dataset as ds

        system, inner = place(self.path)
        rows = ds.dataset(f"{inner}/_manifest", filesystem=system, format="parquet")
        column = ds.field
        wanted = (column("first") < self.high) & (column("first") + column("frames") > self.low)
        if self.episodes is not None:
            wanted &= column("episode").isin(sorted(self.episodes))
        files = rows.to_table(columns=["episode", "first", "file", "bytes"], filter=wanted).sort_by([("episode", "ascending"), ("first", "ascending")])
        parts, held = [], 0
        for episode, first, name, size in zip(*(c.to_pylist() for c in files.columns), strict=True):
            if not parts or held + size > self.bytes:
                parts.append(_Part([]))
                held = 0
            parts[-1].files.append((episode, first, name))
            held += size
        return parts or [_Part([])]

    def read(self, partition):
        target = to_arrow_schema(self.schema)
        arrays = [n for n in self.schema.names if n not in ("episode", "frame", "opened")]
        for episode, _, name in partition.files:
            file = EpisodeFile(f"{self.path}/{name}")
            source = arrays or list(file.index["arrays"])[:1]
            missing = [a for a in source if a not in file.index["arrays"]]
            if missing:
                raise ValueError(f"{name} has no array {', '.join(missing)}")
            for parts in zip(*(file.chunks(a, self.low, self.high) for a in source), strict=True):
                frame, n = parts[0][0], len(parts[0][1])
                own = {"episode": pa.repeat(pa.scalar(episode, pa.int64()), n), "frame": pa.array(range(frame, frame + n), pa.int64()), "opened": pa.repeat(pa.scalar(file.opened, pa.int64()), n)}
                own |= {a: values for a, (_, values) in zip(source, parts, strict=True)}
                yield pa.RecordBatch.from_arrays([own[c].cast(target.field(c).type) for c in self.schema.names], schema=target)
            file.close()


class EpisodeArrays(DataSource):
    """``spark.read.format("episode_arrays")``; the schema names ``episode``, ``frame`` and the arrays to be read."""

    @classmethod
    def name(cls) -> str:
        return "episode_arrays"

    def schema(self) -> T.StructType:
        """All arrays of the manifest's first file."""
        import pyarrow.dataset as ds

        system, inner = place(self.options["path"])
        head = ds.dataset(f"{inner}/_manifest", filesystem=system, format="parquet").head(1, columns=["file", "kinds"]).to_pylist()
        if not head:
            return T.StructType(_KEYS)
        file = EpisodeFile(f"{self.options['path']}/{head[0]['file']}")
        kinds = [next(file.chunks(a, 0, 1 << 62))[1].type for a in file.index["arrays"]]
        found = from_arrow_schema(pa.schema(list(zip(file.index["arrays"], kinds, strict=True))))
        return T.StructType([*_KEYS, *found.fields])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def frames_of(spark: SparkSession, path: str, arrays: str | None = None, **options: str) -> DataFrame:
    """``(episode, frame, ...)`` of the stored frames, with the arrays of the DDL list ``arrays`` (all, if none); filters on episode and frame are pushed down.

    A column ``opened bigint`` among the arrays counts the chunks that have been opened in a row's file so far.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EpisodeArrays)
    reader = spark.read.format("episode_arrays").options(**options)
    return (reader.schema(f"episode bigint, frame bigint, {arrays}") if arrays else reader).load(path)


def at_frames(asked: DataFrame, path: str, array: str, horizon: int = 1, handles: int = 32) -> DataFrame:
    """``asked`` rows ``(episode, frame, ...)`` with ``values``: the array at that frame and the ``horizon`` - 1 that follow, the last one repeated at an episode's end.

    Rows meet the manifest by episode and file, not by a listing, and are sorted, so that a task opens a file once and a chunk for neighbouring rows once.
    Frames outside their episode give no row, nor do null ones.  A window goes on into the episode's next files.
    """
    spark = asked.sparkSession
    files = manifest(spark, path)
    file_frames = files.groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("first", "frames", "file"))).alias("files"))
    known = F.filter("files", lambda f: (f["first"] + f["frames"] > F.col("frame")) & (f["first"] < F.col("frame") + horizon))
    rows = asked.join(file_frames, "episode").withColumn("files", known).where("size(files) > 0 and frame >= files[0].first")
    placed = rows.repartition("episode", F.col("files")[0]["file"]).sortWithinPartitions("episode", "frame")
    kind = T._parse_datatype_string(json.loads(files.select("kinds").first()["kinds"])[array]) if files.take(1) else T.StringType()
    out = T.StructType([*asked.schema.fields, T.StructField("values", T.ArrayType(kind))])
    kept = asked.columns

    def run(batches):
        cache, held, target = Handles(handles), OrderedDict(), to_arrow_schema(out)

        def value(name: str, frame: int):
            file = cache.get(f"{path}/{name}")
            chunk = next(c for c in file.index["arrays"][array] if c[0] <= frame < c[0] + c[1])
            if (name, chunk[0]) not in held:
                if len(held) > 4:
                    held.popitem(last=False)
                held[name, chunk[0]] = next(file.chunks(array, chunk[0], chunk[0] + chunk[1]))[1].to_pylist()
            return held[name, chunk[0]][frame - chunk[0]]

        for batch in batches:
            got = []
            for frame, parts in zip(batch.column("frame").to_pylist(), batch.column("files").to_pylist(), strict=True):
                found = [value(p["file"], t) for p in parts for t in range(max(frame, p["first"]), min(frame + horizon, p["first"] + p["frames"]))]
                got.append(found + found[-1:] * (horizon - len(found)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(got, target.field("values").type)], schema=target)

    return placed.mapInArrow(run, out)
