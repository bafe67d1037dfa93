"""Packing documents into sequences by an order-preserving dynamic program.

The documents of a task are one stream of tokens, in the order in which they are read.  A plan cuts the stream into
windows of at most ``length`` tokens.  A window costs its padding and some tokens more, a cut inside a document costs a penalty: a small one after a
sentence, a large one elsewhere.  Padding falls as a window grows, so the best start of a window that ends at a given
cut is the smallest cost so far over the starts within reach: a sliding minimum, kept by a monotone queue.
Windows of exactly a power of two need no padding; their starts are looked up by position.

The stream never leaves its task: texts aren't shuffled, and a hot source is as good as any other.  A plan is made for
some ``block_tokens`` at a time; its last windows are planned again with the tokens that follow.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import _byte_alphabet, tokenizer_path

#: Fixed value: the pattern by which the word tokenizer splits texts.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Normalisers of a tokenizer file that change nothing but the case of settled characters between white space.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: Characters without combining marks, with one lower case and with one class in every Unicode version of the last decades.
_UNSETTLED = "[^!-~¡-įı-ɏ‐-‧‰-⁞€]"
_SETTLED = [chr(k) for k in range(0x21, 0x2100) if not re.search(_UNSETTLED, chr(k))]
_SENTENCE = r"[.!?…。！？][\"')\]}»”’」』]*$"
_INNER_ENDS = "。！？"
#: A longer stretch goes through the library.
_MOST_BYTES = 400
_loaded = sys.__dict__.setdefault("_tidemark_word_tokenizers", {})


class ChunkEncoder:
    """Encodes texts by their distinct stretches without white space, with the tokenizers library's results.

    White space separates words for a tokenizer that drops it, so a text's ids are those of its stretches.  Stretches of settled
    characters go through tiktoken's engine: a line feed stands for the end of a word, and joining it to the last byte comes before every merge.
    All else, and every tokenizer of another kind, goes through the library.  About ``most_known`` stretches are remembered from one call to the next.
    """

    def __init__(self, path: str, most_known: int = 400_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.by_chunks = self._drops_space(spec)
        self.engine = self._engine(spec) if self.by_chunks else None
        self.most_known = most_known
        self._forget()

    @staticmethod
    def _drops_space(spec: dict) -> bool:
        """Whether this is a tokenizer whose words never hold, and never depend on, white space around them."""
        norm, pre = spec["normalizer"] or {}, (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        named = [n["type"] for n in norm.get("normalizers", [])] == _NORMALIZERS
        space = named and norm["normalizers"][1] == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        split = [p["type"] for p in pre] == ["Split", "ByteLevel"] and pre[0]["pattern"] == {"Regex": WORDS} and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
        plain = split and not pre[1]["add_prefix_space"] and not pre[1].get("use_regex", True) and not spec["post_processor"]
        flags = any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        return bool(space and plain and not flags and not any(re.search(r"\s", t["content"]) for t in spec["added_tokens"]))

    def _engine(self, spec: dict):
        import tiktoken

        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback")):
            return None
        alphabet = _byte_alphabet()
        added = set(self.special)

        def raw(token: str) -> bytes:
            ended = token.endswith("</w>") and len(token) > 4
            return bytes(alphabet[c] for c in (token[:-4] if ended else token)) + b"\n" * ended

        pieces = {raw(t): i for t, i in model["vocab"].items() if t not in added}
        letters = [bytes([b]) for b in range(256)]
        made = [raw("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        # Ends of words first, then the merges in order; the file's ids must name each piece once and follow its merges.
        order = [*letters, *(b + b"\n" for b in letters), *made]
        if len(order) != len(set(order)) or set(order) != set(pieces) or sorted(made, key=pieces.get) != made:
            return None
        self.ids = np.array([pieces[p] for p in order], dtype=np.uint32)
        self.ended = np.array([p.endswith(b"\n") for p in order])
        engine = tiktoken.Encoding("words", pat_str=r"[^\n]*\n", mergeable_ranks={p: k for k, p in enumerate(order)}, special_tokens={})
        letters, numbers = ("".join(c for c in _SETTLED if unicodedata.category(c)[0] == kind) for kind in "LN")
        self.split = re.compile(WORDS.replace(r"\p{L}", letters).replace(r"\p{N}", numbers) + r"|\n")
        return engine

    def _by_library(self, chunks: list[str]) -> list[tuple[list[int], list[int]]]:
        out = []
        for chunk, e in zip(chunks, self.library.encode_batch(chunks, add_special_tokens=False), strict=True):
            inner = any(c in chunk for c in _INNER_ENDS)
            out.append((e.ids, [k for k, (a, b) in enumerate(e.offsets) if b > a and chunk[b - 1] in _INNER_ENDS] if inner else []))
        return out

    def _by_engine(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of settled stretches end to end, and the number of each one's."""
        words = self.split.findall("\n".join(chunks).lower() + "\n")
        text = "\n".join([w for w in words if w != "\n"])
        got = np.array(self.engine.encode_ordinary(text + "\n") if text else [], dtype=np.int64)
        of_word = np.diff(np.concatenate([[0], np.flatnonzero(self.ended[got]) + 1]))
        line = np.array([w == "\n" for w in words])
        counts = np.bincount(np.cumsum(line)[~line], weights=of_word, minlength=len(chunks))
        return self.ids[got], counts.astype(np.int64)

    def _learn(self, fresh: pa.Array, chunks: list[str]) -> None:
        """Adds stretches to the memo, and their ids to the store."""
        odd = np.ones(len(chunks), dtype=bool)
        if self.engine is not None:
            odd = pc.match_substring_regex(fresh, _UNSETTLED).to_numpy(zero_copy_only=False) | (pc.binary_length(fresh).to_numpy() > _MOST_BYTES)
            for special in self.special:
                odd |= pc.match_substring(fresh, special).to_numpy(zero_copy_only=False)
        counts, slow, quick = np.zeros(len(chunks), dtype=np.int64), np.flatnonzero(odd), np.flatnonzero(~odd)
        flat = np.zeros(0, dtype=np.uint32)
        if len(quick):
            flat, counts[quick] = self._by_engine([chunks[k] for k in quick.tolist()])
        found = self._by_library([chunks[k] for k in slow.tolist()]) if len(slow) else []
        counts[slow] = [len(x) for x, _ in found]
        begin = np.cumsum(counts) - counts
        ids, ends, own = (np.zeros(int(counts.sum()), dtype=t) for t in (np.uint32, bool, bool))
        for k, (x, e) in zip(slow.tolist(), found, strict=True):
            at = slice(begin[k], begin[k] + counts[k])
            own[at], ids[at] = True, x
            ends[begin[k] + np.array(e, dtype=np.int64)] = True
        ids[~own] = flat
        last = pc.match_substring_regex(fresh, _SENTENCE).to_numpy(zero_copy_only=False) & (counts > 0)
        ends[(begin + counts - 1)[last]] = True
        self.memo.update(zip(chunks, range(len(self.memo), len(self.memo) + len(chunks)), strict=True))
        self.counts, self.begin = np.concatenate([self.counts, counts]), np.concatenate([self.begin, len(self.flat) + begin])
        self.flat, self.ends = np.concatenate([self.flat, ids]), np.concatenate([self.ends, ends])

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.counts, self.begin = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.flat, self.ends = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=bool)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts end to end, the number of each one's, and whether a sentence ends after each id."""
        if not self.by_chunks:
            found = [e.ids for e in self.library.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            flat = np.fromiter((i for x in found for i in x), dtype=np.uint32)
            return flat, np.array([len(x) for x in found], dtype=np.int64), np.zeros(len(flat), dtype=bool)
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = parts.flatten().dictionary_encode()
        distinct = coded.dictionary
        if len(self.memo) > self.most_known:
            self._forget()
        if len(distinct):
            chunks = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), "\n")[0].as_py().split("\n")
            fresh = [k for k, c in enumerate(chunks) if c not in self.memo]
            if fresh:
                self._learn(distinct.take(pa.array(fresh)), [chunks[k] for k in fresh])
            place = np.fromiter(map(self.memo.__getitem__, chunks), dtype=np.int64, count=len(chunks))
            code = place[coded.indices.to_numpy()]
        else:
            code = np.zeros(0, dtype=np.int64)
        size = self.counts[code]
        upto = np.concatenate([[0], np.cumsum(size)])
        narrow = np.int32 if max(upto[-1], len(self.flat)) < 1 << 31 else np.int64
        source = np.repeat((self.begin[code] - upto[:-1]).astype(narrow), size) + np.arange(upto[-1], dtype=narrow)
        at = parts.offsets.to_numpy()
        return self.flat[source], np.diff(upto[at - at[0]]), self.ends[source]


def load(path: str) -> ChunkEncoder:
    """The tokenizer of this process, read once."""
    if path not in _loaded:
        _loaded[path] = ChunkEncoder(path)
    return _loaded[path]


def candidates(n: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, in order, and their kind: 0 a document's end, 1 a sentence's, 2 another place.

    The last are taken every ``step`` tokens where no better place is nearer, so that a window always has an end; and every ``step`` tokens
    before the stream's end and everywhere near its begin, so that a short rest can be parted into powers of two.
    """
    kind = np.full(n + 1, 3, dtype=np.int8)
    kind[n] = 2
    kind[sentence_ends] = 1
    kind[doc_ends] = 0
    kind[0] = 3
    ends = np.flatnonzero(kind < 3)
    before = np.concatenate([[0], ends[:-1]])
    for k in np.flatnonzero(ends - before > step).tolist():
        kind[before[k] + step : ends[k] : step] = 2
    last = np.arange(n - step, max(0, n - 128 * step), -step)
    kind[last[kind[last] == 3]] = 2
    kind[1 : min(step, n)][kind[1 : min(step, n)] == 3] = 2
    places = np.flatnonzero(kind < 3)
    return places, kind[places]


def plan(places: np.ndarray, penalty: np.ndarray, length: int, price: int = 1) -> np.ndarray:
    """The cheapest windows over the stream from 0 to the last of ``places``: the positions where they end.

    ``penalty``: what a cut at each place costs; the last place costs nothing.  ``price``: what a window costs.  Steps between places are at most ``length``.
    """
    p = np.concatenate([[0], places])
    m = len(p)
    js, starts = [], []
    for k in range(length.bit_length()):
        if 1 << k <= length:
            want = p - (1 << k)
            at = np.searchsorted(p, want)
            hit = np.flatnonzero((want >= 0) & (p[np.minimum(at, m - 1)] == want))
            js.append(hit)
            starts.append(at[hit])
    j, s = np.concatenate(js), np.concatenate(starts)
    order = np.argsort(j, kind="stable")
    first = np.searchsorted(j[order], np.arange(m + 1)).tolist()
    exact = s[order].tolist()
    pos, cut = p.tolist(), [0, *penalty.tolist()]
    cut[-1] = 0
    cost, back = [0] * m, [0] * m
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (cost and position, position, place), of growing cost
    for here in range(1, m):
        at = pos[here]
        reach = at - length
        while queue[0][1] < reach:
            queue.popleft()
        best, _, start = queue[0]
        best += length - at
        for other in exact[first[here] : first[here + 1]]:
            if cost[other] < best:
                best, start = cost[other], other
        best += price + cut[here]
        cost[here], back[here] = best, start
        best += at
        while queue and queue[-1][0] >= best:
            queue.pop()
        queue.append((best, at, here))
    ends = []
    here = m - 1
    while here > 0:
        ends.append(pos[here])
        here = back[here]
    return np.array(ends[::-1], dtype=np.int64)


def byte_slices(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """(from, to) ranges of an array of texts with about ``most_bytes`` in each."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    begin = 0
    while begin < len(texts):
        before = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, before + most_bytes, "right")))
        yield begin, end
        begin = end


class Packer:
    """The stream of one task: takes encoded documents, gives rows of pieces whose windows are settled."""

    def __init__(self, length: int, sentence_penalty: int, inner_penalty: int, block_tokens: int, window_penalty: int = 16):
        self.length, self.block_tokens, self.window_penalty = length, block_tokens, window_penalty
        self.price = np.array([0, sentence_penalty, inner_penalty], dtype=np.int64)
        self.step = max(1, length // 64)
        self.ids, self.ends = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=bool)
        # Of each document: its key, where it begins in the stream that is left, and how many ids it has.
        self.keys: list = []
        self.begin, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.windows = 0

    def add(self, keys: list, ids: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> None:
        self.keys += keys
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(counts) - counts])
        self.size = np.concatenate([self.size, counts])
        self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, ends])

    def settled(self, last: bool) -> dict | None:
        """Pieces of all windows if this is the ``last`` call, else of those that what follows can hardly change."""
        n = len(self.ids)
        if not n or not last and n < self.block_tokens:
            return None
        places, kind = candidates(n, self.begin + self.size, np.flatnonzero(self.ends) + 1, self.step)
        cuts = np.concatenate([[0], plan(places, self.price[kind], self.length, self.window_penalty)])
        if not last:
            cuts = cuts[: np.searchsorted(cuts, n - 4 * self.length, "right")]
        if len(cuts) < 2:
            return None
        until = int(cuts[-1])
        starts = np.zeros(until, dtype=bool)
        starts[cuts[:-1]] = True
        starts[self.begin[(self.begin >= 0) & (self.begin < until)]] = True
        x = np.flatnonzero(starts)
        size = np.diff(np.append(x, until))
        doc, window = np.searchsorted(self.begin, x, "right") - 1, np.searchsorted(cuts, x, "right") - 1
        raw = memoryview(self.ids[:until].astype("<u4").tobytes())
        out = {
            "doc_id": [self.keys[k] for k in doc.tolist()], "start": x - self.begin[doc], "length": size,
            "ids_crc32": np.array([zlib.crc32(raw[4 * a : 4 * (a + s)]) for a, s in zip(x.tolist(), size.tolist(), strict=True)], dtype=np.int64),
            "doc_tokens": self.size[doc], "sequence": self.windows + window, "offset": x - cuts[window], "ids": self.ids[:until],
        }
        self.windows += len(cuts) - 1
        keep = int(np.searchsorted(self.begin + self.size, until, "right"))
        self.ids, self.ends, self.keys = self.ids[until:], self.ends[until:], self.keys[keep:]
        self.begin, self.size = self.begin[keep:] - until, self.size[keep:]
        return out


def pack(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 2,
    length: int = 4096,
    sentence_penalty: int = 16,
    inner_penalty: int = 64,
    window_penalty: int = 16,
    doc_id: str = "doc_id",
    text: str = "text",
    block_tokens: int = 1 << 20,
    keep_ids: bool = True,
) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids)``, one row for each piece of a document.

    A document is its ids and ``end_id``; null texts count as empty.  Every id lies in exactly one piece, pieces of a sequence lie end to end from
    offset 0 and follow the order of reading.  A document longer than a sequence is cut, by preference after a sentence (a
    stretch that ends with a mark such as ``.``, ``!``, ``?`` or their East Asian forms).  ``sequence_id`` grows with the
    order of reading: the task's number times 2^36, and the window's number in the task; tasks number alike when they run again, as long
    as ``docs`` is a file scan or a written table.  Repeated rows, repeated or null ids are packed like any others.  An empty table gives an empty
    result.  Other columns are left out.  ``ids`` can be left out by ``keep_ids``.  A task holds about ``block_tokens`` ids, and one document's.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * keep_ids

    def run(batches):
        codec = load(tokenizer_path(tokenizer))
        packer = Packer(length, sentence_penalty, inner_penalty, block_tokens, window_penalty)
        base = TaskContext.get().partitionId() << 36
        key_type = None

        def rows(found: dict):
            columns = [pa.array(found["doc_id"], key_type), *(pa.array(found[c]) for c in ("start", "length", "ids_crc32", "doc_tokens")), pa.array(base + found["sequence"]), pa.array(found["offset"])]
            if keep_ids:
                at = np.concatenate([[0], np.cumsum(found["length"])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(found["ids"].astype(np.int32))))
            return pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in schema.split(", ")])

        for batch in batches:
            key_type = batch.column(0).type
            texts = batch.column(1)
            for lo, hi in byte_slices(texts, 8 << 20):
                ids, counts, ends = codec.texts(texts.slice(lo, hi - lo))
                after = np.cumsum(counts)
                packer.add(batch.column(0).slice(lo, hi - lo).to_pylist(), np.insert(ids, after, end_id), counts + 1, np.insert(ends, after, False))
                if found := packer.settled(last=False):
                    yield rows(found)
        if found := packer.settled(last=True):
            yield rows(found)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def padded(pieces: DataFrame, length: int = 4096, pad_id: int = 0) -> DataFrame:
    """``(sequence_id, n_tokens, ids)`` of the pieces of ``pack``: whole sequences, padded to ``length`` unless their size is a power of two.

    A group is one sequence, so no more than ``length`` ids.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    n = F.size("ids")
    power = F.bit_count(n) == 1
    fill = F.array_repeat(F.lit(pad_id), F.when(power, 0).otherwise(F.greatest(F.lit(length) - n, F.lit(0))))
    return whole.select("sequence_id", n.cast("bigint").alias("n_tokens"), F.concat("ids", fill).alias("ids"))
