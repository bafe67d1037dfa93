"""Chat formatting by schema fingerprints.

A record's layout is the set of its nested field paths that hold a value.  The digest of that set selects a
declarative mapping, which turns prompt, instruction and message layouts alike into canonical turns
``array<struct<role, text>>``.  The turns are then written with a template that marks every turn, escapes the template's
own control strings inside texts, and gives the spans of the output that a loss covers.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


@dataclass(frozen=True)
class Mapping:
    """Paths that a layout must have, paths that it may have, and the turns they make.

    ``turns``: (role, path) for scalars; ``messages``: (list path, role field, text fields) for lists, of which the first that holds a value
    in an element counts.  A field of a list is written ``list[].field``; of a list's required fields one is enough, since
    any may be null throughout a record.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    messages: tuple[str, str, tuple[str, ...]] | None = None


#: The layouts in common use, by their field names.
MAPPINGS = (
    Mapping("role_text", ("messages[].role", "messages[].text"), messages=("messages", "role", ("text",))),
    Mapping("role_content", ("messages[].role", "messages[].content"), messages=("messages", "role", ("content",))),
    Mapping("role_text_or_content", ("messages[].role", "messages[].text", "messages[].content"), messages=("messages", "role", ("text", "content"))),
    Mapping("from_value", ("conversations[].from", "conversations[].value"), messages=("conversations", "from", ("value",))),
    Mapping("prompt_response", ("prompt", "response"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", ("prompt", "completion"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("question_answer", ("question", "answer"), ("system",), (("system", "system"), ("user", "question"), ("assistant", "answer"))),
)
#: Names that layouts use for the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths) -> str:
    """Digest of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def field_paths(schema: T.StructType) -> list[tuple[str, Column]]:
    """Every leaf path below the schema with a condition that is true where a record holds it.

    A list's field counts as held where one of its elements holds a value; what such a value is made of is no path of its own.
    """
    found = []
    holds = lambda name: lambda x: x[name].isNotNull()

    def walk(kind, path: str, value: Column) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name, value[f.name])
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            for f in kind.elementType.fields:
                found.append((f"{path}[].{f.name}", F.coalesce(F.exists(value, holds(f.name)), F.lit(False))))
        else:
            found.append((path, value.isNotNull()))

    for f in schema.fields:
        walk(f.dataType, f.name, F.col(f"`{f.name}`"))
    return found


def _prefixes(schema: T.StructType, above: str = "") -> list[str]:
    """The empty prefix, and one for each struct that records may be wrapped in."""
    inner = [p for f in schema.fields if isinstance(f.dataType, T.StructType) for p in _prefixes(f.dataType, f"{above}{f.name}.")]
    return [above, *inner]


def _under(m: Mapping, prefix: str) -> Mapping:
    messages = m.messages and (prefix + m.messages[0], *m.messages[1:])
    added = lambda paths: tuple(prefix + p for p in paths)
    return Mapping(m.name, added(m.required), added(m.optional), tuple((r, prefix + p) for r, p in m.turns), messages)


def _choices(m: Mapping, by_path: set[str]) -> list[tuple[str, ...]]:
    """The sets of held paths that select a mapping."""
    options = [p for p in m.optional if p in by_path]
    some = lambda paths, least: [c for n in range(least, len(paths) + 1) for c in itertools.combinations(paths, n)]
    needed = some(m.required, 1) if m.messages else [m.required]
    return [(*a, *b) for a in needed for b in some(options, 0)]


def canonical_turns(records: DataFrame, key: str, mappings: tuple[Mapping, ...] = MAPPINGS, roles: dict[str, str] | None = None) -> DataFrame:
    """``(key, layout, fingerprint, turns)`` for each record; all other columns are read as the record's fields.

    A layout may also stand inside structs, as ``data.prompt``.  A text that is a list of parts is their texts in order, and one in a struct is
    its ``text``.  ``layout`` is null and ``turns`` empty where no mapping has the record's fingerprint, so such records stay and
    can be counted by fingerprint (``layout_counts``); fields that no mapping names take no part in it.  Null texts and null roles are empty.
    ``roles`` renames roles, by default those of ``ROLES``.
    """
    fields = T.StructType([f for f in records.schema.fields if f.name != key])
    mappings = tuple(_under(m, p) for p in _prefixes(fields) for m in mappings)
    known = {p for m in mappings for p in (*m.required, *m.optional)}
    paths = [(p, held) for p, held in field_paths(fields) if p in known]
    by_path = {p for p, _ in paths}
    present = F.array_compact(F.array(*[F.when(held, F.lit(p)) for p, held in sorted(paths, key=lambda x: x[0])])) if paths else F.array().cast("array<string>")
    digest = F.sha2(F.array_join(present, "\n"), 256)
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    taken: set[str] = set()
    chosen = []
    for m in mappings:
        if by_path >= set(m.required):
            prints = [x for x in map(fingerprint, _choices(m, by_path)) if x not in taken]
            taken.update(prints)
            chosen.append((m, prints))
    for m, prints in reversed(chosen):
        if prints:
            mine = F.col("__print").isin(prints)
            layout = F.when(mine, F.lit(m.name)).otherwise(layout)
            turns = F.when(mine, _mapped(m, by_path, fields, ROLES if roles is None else roles)).otherwise(turns)
    return records.withColumn("__print", digest).select(
        key, layout.alias("layout"), F.col("__print").alias("fingerprint"), turns.alias("turns")
    )


def layout_counts(turns: DataFrame) -> DataFrame:
    """``(layout, fingerprint, records)``; a null layout is one that no mapping takes."""
    return turns.groupBy("layout", "fingerprint").agg(F.count(F.lit(1)).alias("records"))


def _column(path: str) -> Column:
    first, *rest = path.split(".")
    out = F.col(f"`{first}`")
    for name in rest:
        out = out[name]
    return out


def _kind(schema: T.StructType, path: str):
    kind = schema
    for name in path.split("."):
        kind = kind[name].dataType
    return kind


def _text(value: Column, kind) -> Column:
    """A text, the texts of a list of parts without anything between, or a struct's ``text``; null where there is none."""
    if isinstance(kind, T.StructType):
        return _text(value["text"], kind["text"].dataType) if "text" in kind.fieldNames() else F.to_json(value)
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(value, lambda x: F.coalesce(_text(x, kind.elementType), F.lit(""))), "")
    return value.cast("string")


def _mapped(m: Mapping, by_path: set[str], fields: T.StructType, roles: dict[str, str]) -> Column:
    if m.messages:
        path, role, texts = m.messages
        element = _kind(fields, path).elementType

        def turn(x: Column) -> Column:
            name = F.coalesce(x[role].cast("string"), F.lit(""))
            for alias, canonical in roles.items():
                name = F.when(x[role] == alias, F.lit(canonical)).otherwise(name)
            said = [_text(x[t], element[t].dataType) for t in texts]
            return F.struct(name.alias("role"), F.coalesce(*said, F.lit("")).alias("text"))

        return F.transform(_column(path), turn).cast(TURNS)
    made = [
        F.when(_column(path).isNotNull(), F.struct(F.lit(role).alias("role"), _text(_column(path), _kind(fields, path)).alias("text")))
        for role, path in m.turns
        if path in by_path
    ]
    return F.array_compact(F.array(*made)).cast(TURNS)


def escape(text: str) -> str:
    """``<|`` can't occur in the result: every ``<``, backslashes, ``|`` gets one backslash more."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def render(turns: list[tuple[str, str]], trained: tuple[str, ...] = ("assistant",)) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans (code points) of it that the loss covers."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"{START}{_escape_role(role)}\n", escape(text), f"{END}\n"
        parts += [head, body, tail]
        if role in trained and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(tail)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns back from a formatted text."""
    turns = []
    for block in formatted.split(START)[1:]:
        role, _, rest = block.partition("\n")
        turns.append((_unescape_role(role), unescape(rest[: -len(END) - 1])))
    return turns


def formatted_chats(turns: DataFrame, key: str) -> DataFrame:
    """``(key, formatted, loss_spans)``: each row's turns under the template; spans are ``array<struct<start, end>>``."""
    kind = turns.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts, spans = [], []
            for row in batch.column(1).to_pylist():
                text, at = render([(t["role"], t["text"]) for t in row or []])
                texts.append(text)
                spans.append([{"start": a, "end": b} for a, b in at])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=[key, "formatted", "loss_spans"],
            )

    return turns.select(key, "turns").mapInArrow(run, f"{key} {kind}, formatted string, loss_spans array<struct<start:bigint,end:bigint>>")


def conversations_to_records(rows: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text)`` as one record per conversation, in order of turn, then role and text.

    A conversation becomes one text, so it must fit in a task; ``collect_list`` gathers no more than that.
    """
    message = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (
        rows.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(message)).alias("m"))
        .select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages"))
    )


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, taken from the formatted output alone."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for formatted, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(formatted)
                loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
                out[0].append(len(turns))
                out[1].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                out[2].append(len(loss))
                out[3].append(hashlib.sha256(loss.encode()).hexdigest())
                out[4].append(len(formatted))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return chats.mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
