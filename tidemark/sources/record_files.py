"""Files of framed records (TFRecord) and the examples in them, read by many tasks through an offset index.

A record stands as its length, the length's checksum, its bytes and their checksum.  Where a record begins is known for sure only from the file's begin on, as a record's bytes may
look like records themselves.  So an index is made first: one task for each file hops from header to header and reads nothing else.  With it a file of any size is
dealt over tasks at record borders.  A damaged record becomes a row that says so, and if a header is damaged the next sound one is looked for.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions import hashing
from tidemark.sources.episode_arrays import place

#: The reversed polynomial of CRC-32C, and the constant of the format's masked checksums.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
HEADER, FOOTER = 12, 4
INDEX = "file string, number bigint, offset bigint, length bigint, damaged string"
_WINDOW = 1 << 16


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


_TABLE = _byte_table()
_SHIFTS: dict[int, np.ndarray] = {}


def _shift(n_bytes: int) -> np.ndarray:
    """What so many zero bytes make of a state, by the state's four bytes: 4 tables of 256."""
    if n_bytes not in _SHIFTS:
        state = (np.arange(256, dtype=np.uint64)[None, :] << np.array([[0], [8], [16], [24]], dtype=np.uint64)).astype(np.uint32)
        for _ in range(n_bytes):
            state = _TABLE[state & 0xFF] ^ (state >> 8)
        _SHIFTS[n_bytes] = state
    return _SHIFTS[n_bytes]


def checksums(texts: list[bytes]) -> np.ndarray:
    """CRC-32C of all texts, those of about one length in step.

    A text is a square of lanes: all lanes take one byte at a time, then they are joined, as a state of zeros
    doesn't change by zeros before a text and states add up.
    """
    out = np.zeros(len(texts), dtype=np.uint32)
    classes: dict[int, list[int]] = {}
    for k, t in enumerate(texts):
        if len(t) < 4:
            state = 0xFFFFFFFF
            for b in t:
                state = int(_TABLE[(state ^ b) & 0xFF]) ^ (state >> 8)
            out[k] = state ^ 0xFFFFFFFF
        else:
            classes.setdefault(len(t).bit_length(), []).append(k)
    for bits, members in classes.items():
        width = 1 << (bits + 1) // 2
        lanes = -(-(1 << bits) // width)
        step = max(1, (32 << 20) >> bits)
        for at in range(0, len(members), step):
            own = members[at : at + step]
            data = np.zeros((len(own), lanes * width), dtype=np.uint8)
            for r, k in enumerate(own):
                begin = lanes * width - len(texts[k])
                data[r, begin:] = np.frombuffer(texts[k], dtype=np.uint8)
                data[r, begin : begin + 4] ^= 0xFF
            cells = data.reshape(len(own), lanes, width)
            state = np.zeros((len(own), lanes), dtype=np.uint32)
            for j in range(width):
                state = _TABLE[(state ^ cells[:, :, j]) & 0xFF] ^ (state >> 8)
            far, total = _shift(width), np.zeros(len(own), dtype=np.uint32)
            for j in range(lanes):
                total = far[0][total & 0xFF] ^ far[1][total >> 8 & 0xFF] ^ far[2][total >> 16 & 0xFF] ^ far[3][total >> 24] ^ state[:, j]
            out[own] = total ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def framed(texts: list[bytes]) -> list[bytes]:
    """Records of the texts."""
    heads = [struct.pack("<Q", len(t)) for t in texts]
    head_sums, sums = masked(checksums(heads)).tolist(), masked(checksums(texts)).tolist()
    return [h + struct.pack("<I", hc) + t + struct.pack("<I", c) for h, hc, t, c in zip(heads, head_sums, texts, sums, strict=True)]


class _Heads:
    """Finds records of one file by their headers."""

    def __init__(self, path: str):
        system, inner = place(path)
        self.file = system.open_input_file(inner)
        self.size = self.file.size()
        self.at, self.held = 0, b""

    def _bytes(self, offset: int, n: int) -> bytes:
        if not self.at <= offset <= offset + n <= self.at + len(self.held):
            self.at, self.held = offset, self.file.read_at(max(n, _WINDOW), offset)
        return self.held[offset - self.at : offset - self.at + n]

    def length(self, offset: int) -> int | None:
        """The length of the record at ``offset``, null if no sound header of a record that fits is there."""
        head = self._bytes(offset, HEADER)
        if len(head) < HEADER:
            return None
        (n,), (crc,) = struct.unpack("<Q", head[:8]), struct.unpack("<I", head[8:])
        return n if offset + HEADER + n + FOOTER <= self.size and int(masked(checksums([head[:8]]))[0]) == crc else None

    def resume(self, offset: int) -> int:
        """The next place with a sound header, or the file's end."""
        while offset < self.size:
            part = self._bytes(offset, min(_WINDOW, self.size - offset))
            fields = [part[k : k + 8] for k in range(max(0, len(part) - HEADER + 1))]
            told = masked(checksums(fields)) if fields else np.zeros(0, dtype=np.uint32)
            for k in range(len(fields)):
                if told[k] == struct.unpack_from("<I", part, k + 8)[0] and self.length(offset + k) is not None:
                    return offset + k
            if offset + len(part) >= self.size:
                break
            offset += max(1, len(part) - HEADER + 1)
        return self.size

    def walk(self) -> Iterator[tuple[int, int, int, str | None]]:
        """``(number, offset, length, damaged)`` of all records; a stretch without a sound header counts as one."""
        number, offset = 0, 0
        while offset < self.size:
            n = self.length(offset)
            if n is None:
                after = self.resume(offset + 1)
                yield number, offset, after - offset, "header"
                offset = after
            else:
                yield number, offset, n, None
                offset += HEADER + n + FOOTER
            number += 1


def files(spark: SparkSession, path: str, split: str = "all", seed: int | None = None, shard: tuple[int, int] = (0, 1)) -> DataFrame:
    """``(file, bytes, place)`` of the record files below ``path``: of one split, or of all; one host's part of them; in order of name or of a seed.

    Names are like ``set-train.tfrecord-00000-of-00010``.  The same seed gives the same order and hosts the same parts in any run.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tfrecord*").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
    name = F.element_at(F.split("file", "/"), -1)
    if split != "all":
        listed = listed.where(name.rlike(rf"(^|-){re.escape(split)}\.tfrecord"))
    if shard[1] > 1:
        listed = listed.where(hashing.bucket(f"{seed}host", name, shard[1]) == shard[0])
    return listed.withColumn("place", F.concat(F.lpad(hashing.bucket(f"{seed}file", name, 1_000_000).cast("string"), 7, "0"), name) if seed is not None else name)


def index(listed: DataFrame) -> DataFrame:
    """``(file, number, offset, length, damaged)`` of every record of listed files; each file is one task's, which reads headers only."""

    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = [c.split(" ")[0] for c in INDEX.split(", ")]
        for batch in batches:
            for file in batch.column(0).to_pylist():
                cells = []
                for row in _Heads(file).walk():
                    cells.append((file, *row))
                    if len(cells) >= 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in cells], t) for k, t in enumerate(kinds)], names=names)
                        cells = []
                yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in cells], t) for k, t in enumerate(kinds)], names=names)

    return listed.select("file").repartition("file").mapInArrow(run, INDEX)


def records(found: DataFrame, split_bytes: int = 64 << 20) -> DataFrame:
    """``(file, number, data, damaged)`` of indexed records: ``damaged`` names a wrong checksum or header, and ``data`` is null then.

    Records are dealt over tasks by file and stretches of ``split_bytes``, so a large file is many tasks'; a task holds one read of some records.
    """
    dealt = found.withColumn("__split", F.floor(F.col("offset") / split_bytes)).repartition("file", "__split").sortWithinPartitions("file", "offset")
    names = ["file", "number", "data", "damaged"]

    def run(batches):
        name, file = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "number", "offset", "length", "damaged")), strict=True))
            begin = 0
            while begin < len(rows):
                end, size = begin, 0
                while end < len(rows) and rows[end][0] == rows[begin][0] and (end == begin or size + rows[end][3] <= 8 << 20):
                    size += rows[end][3]
                    end += 1
                if rows[begin][0] != name:
                    name = rows[begin][0]
                    system, inner = place(name)
                    file = system.open_input_file(inner)
                part = rows[begin:end]
                low = part[0][2]
                last = part[-1]
                raw = file.read_at(last[2] + last[3] + (0 if last[4] else HEADER + FOOTER) - low, low)
                data, told = [], []
                for _, _, offset, n, damaged in part:
                    at = offset - low + HEADER
                    data.append(None if damaged else raw[at : at + n])
                    told.append(None if damaged else struct.unpack_from("<I", raw, at + n)[0])
                sums = iter(masked(checksums([d for d in data if d is not None])).tolist())
                faults = [r[4] or (None if next(sums) == t else "checksum") for r, t in zip(part, told, strict=True)]
                data = [None if f else d for d, f in zip(data, faults, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.int64()), pa.array(data, pa.binary()), pa.array(faults, pa.string())], names=names)
                begin = end

    return dealt.select("file", "number", "offset", "length", "damaged").mapInArrow(run, "file string, number bigint, data binary, damaged string")


def write(rows: DataFrame, path: str, data: str, name: str = "set", split: str = "train") -> DataFrame:
    """Writes the bytes of a column as record files, one for each partition, and gives their index; null bytes are written as an empty record.

    A file gets its name when it is whole; a task that runs again writes the same name.  The index is written to ``_index`` below the path and is all that a reader needs.
    """
    spark = rows.sparkSession

    def run(batches):
        number = TaskContext.get().partitionId()
        system, inner = place(path)
        system.create_dir(inner, recursive=True)
        file = f"{name}-{split}.tfrecord-{number:05d}"
        draft = f"{inner}/.draft-{uuid.uuid4().hex}"
        at, k, cells = 0, 0, []
        with system.open_output_stream(draft) as out:
            for batch in batches:
                texts = [t or b"" for t in batch.column(0).to_pylist()]
                for record, text in zip(framed(texts), texts, strict=True):
                    out.write(record)
                    cells.append((k, at, len(text)))
                    at, k = at + len(record), k + 1
        system.move(draft, f"{inner}/{file}")
        columns = [pa.array([f"{path}/{file}"] * len(cells), pa.string()), *(pa.array([c[j] for c in cells], pa.int64()) for j in range(3)), pa.nulls(len(cells), pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in INDEX.split(", ")])

    rows.select(F.col(data).alias("data")).mapInArrow(run, INDEX).write.mode("overwrite").parquet(f"{path}/_index")
    return spark.read.schema(INDEX).parquet(f"{path}/_index")


# Examples: protocol buffers with a map from names to lists of bytes, floats or whole numbers.


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value, shift = 0, 0
    while True:
        b = data[at]
        value |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``(number, value)`` of a message's fields."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            n, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            if at + n > len(data):
                raise ValueError("message ends too early")
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def _values(feature: bytes) -> list:
    """A feature's list; whole numbers are signed, packed or one by one."""
    for kind, body in _fields(feature):
        if kind == 1:
            return [v for _, v in _fields(body)]
        if kind == 2:
            return [x for _, v in _fields(body) for x in np.frombuffer(v, dtype="<f4").tolist()]
        if kind == 3:
            out = []
            for _, v in _fields(body):
                if isinstance(v, bytes):
                    at = 0
                    while at < len(v):
                        n, at = _varint(v, at)
                        out.append(n)
                else:
                    out.append(v)
            return [n - (1 << 64) if n >> 63 else n for n in out]
    return []


def parsed(data: bytes) -> dict[str, list]:
    """An example's features by name."""
    out = {}
    for number, features in _fields(data):
        if number == 1:
            for _, entry in _fields(features):
                parts = dict(_fields(entry))
                out[parts.get(1, b"").decode()] = _values(parts.get(2, b""))
    return out


def _number(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, body: bytes) -> bytes:
    return _number(number << 3 | 2) + _number(len(body)) + body


def example(features: dict[str, list]) -> bytes:
    """The message of features; texts are written as UTF-8, an empty or null list without a kind."""
    entries = []
    for name in sorted(features):
        values = features[name] or []
        if not values:
            feature = b""
        elif isinstance(values[0], (str, bytes)):
            feature = _field(1, b"".join(_field(1, v.encode() if isinstance(v, str) else v) for v in values))
        elif isinstance(values[0], float):
            feature = _field(2, _field(1, np.array(values, dtype="<f4").tobytes()))
        else:
            feature = _field(3, _field(1, b"".join(map(_number, values))))
        entries.append(_field(1, _field(1, name.encode()) + _field(2, feature)))
    return _field(1, b"".join(entries))


def examples(read: DataFrame, features: str) -> DataFrame:
    """Records with the features that the DDL list names, such as ```steps/action` array<float>``, in place of their bytes.

    A feature that a record lacks is null; one of a plain type takes a list's first value; ``string`` ones are read as UTF-8.  A record that is no
    example keeps its row, with ``damaged`` set to ``message`` and null features.
    """
    kind = T._parse_datatype_string(features)
    out = T.StructType([read.schema["file"], read.schema["number"], *kind.fields, read.schema["damaged"]])

    def run(batches):
        target = to_arrow_schema(out)
        for batch in batches:
            faults, cells = batch.column("damaged").to_pylist(), []
            for k, data in enumerate(batch.column("data").to_pylist()):
                try:
                    cells.append(parsed(data) if data is not None else {})
                except (ValueError, IndexError, KeyError, AttributeError, TypeError):
                    cells.append({})
                    faults[k] = "message"
            columns = []
            for f in kind.fields:
                values = [c.get(f.name) for c in cells]
                element = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
                if isinstance(element, T.StringType):
                    values = [v if v is None else [x.decode("utf-8", "replace") for x in v] for v in values]
                if not isinstance(f.dataType, T.ArrayType):
                    values = [v[0] if v else None for v in values]
                columns.append(pa.array(values, target.field(f.name).type))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("number"), *columns, pa.array(faults, pa.string())], schema=target)

    return read.select("file", "number", "data", "damaged").mapInArrow(run, out)


def as_examples(rows: DataFrame, features: list[str]) -> DataFrame:
    """``(data)``: each row's columns as an example; plain values become lists of one, floats and doubles single precision."""

    def listed(v):
        return v if isinstance(v, list) else [] if v is None else [v]

    def run(batches):
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in features}
            yield pa.RecordBatch.from_arrays([pa.array([example({c: listed(columns[c][k]) for c in features}) for k in range(batch.num_rows)], pa.binary())], names=["data"])

    return rows.select(*features).mapInArrow(run, "data binary")
