"""BPE encoding and decoding with a tree of joins for long texts.

A long text is halved until its leaves are short; the leaves are encoded in parallel by threads, as the engine works
outside Python's lock.  Then neighbours are joined, level by level: a window of tokens around each join is encoded again and grown until its first and
last tokens are those that both sides had.  A BPE encoding is the one sequence whose neighbouring tokens all
belong together, so a window that agrees at both ends makes the joined sequence the encoding of the joined text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunk_dedup import slices

#: Characters that every Unicode version of the last decades puts into the same classes.
_SETTLED = re.compile("[^\x00-ɏ‐-‧‰-⁞€]")
LEAF_CHARS, FIRST_WINDOW = 16_384, 16
#: Threads that encode the leaves of long texts in one Python worker.
LEAF_THREADS = 2
_loaded = sys.__dict__.setdefault("_tidemark_tokenizers", {})


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file, on the machine that asks."""
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


def _byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Fixed value: the pattern by which byte-level BPE of this kind splits texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBPE:
    """A byte-level BPE of the tokenizers library's JSON format, with that library's results.

    The vocabulary of the file drives a faster engine where that is known to agree: merges ranked as ids, no normalizer, no
    prefix space, and texts of settled characters.  All else goes through the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = self._engine(spec)
        self.threads: ThreadPoolExecutor | None = None

    def _engine(self, spec: dict):
        import tiktoken

        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        odd = spec["normalizer"] or spec["post_processor"] or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        flags = any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if not plain or odd or flags or model["type"] != "BPE":
            return None
        alphabet = _byte_alphabet()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
        merged = [model["vocab"][a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        if merged != sorted(merged) or merged != list(range(256, 256 + len(merged))):
            return None
        self.pieces = [b""] * (max([*ranks.values(), *added.values()]) + 1)
        for piece, i in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
            self.pieces[i] = piece
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def _encode_fast(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.fast.encode(text, allowed_special="all")
        return self.fast.encode_ordinary(text)

    def encode_batch(self, texts: list[str], parallel: bool = False) -> list[list[int]]:
        """Token ids of every text; ``parallel``: by threads."""
        out: list = [None] * len(texts)
        slow = [k for k, t in enumerate(texts) if self.fast is None or (not t.isascii() and _SETTLED.search(t))]
        left = set(slow)
        quick = [k for k in range(len(texts)) if k not in left]
        if parallel and len(quick) > 1:
            self.threads = self.threads or ThreadPoolExecutor(LEAF_THREADS)
            found = self.threads.map(self._encode_fast, [texts[k] for k in quick])
        else:
            found = map(self._encode_fast, [texts[k] for k in quick])
        for k, ids in zip(quick, found, strict=True):
            out[k] = ids
        if slow:
            for k, e in zip(slow, self.library.encode_batch([texts[k] for k in slow], add_special_tokens=False), strict=True):
                out[k] = e.ids
        return out

    def decode(self, ids: list[int]) -> str:
        if self.fast is None:
            return self.library.decode(ids, skip_special_tokens=False)
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids]).decode("utf-8", "replace")

    def size(self, token: int) -> int:
        return len(self.pieces[token])

    @property
    def splittable(self) -> bool:
        """Whether tokens have byte lengths of their own, which joins need."""
        return self.fast is not None


def load(path: str) -> ByteBPE:
    """The tokenizer of this process, read once."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def _join_windows(codec: ByteBPE, pairs: list[tuple[bytes, list[int], list[int]]]) -> list[list[int]]:
    """Each pair's tokens as one sequence. A pair: the bytes of both texts, the left and the right tokens."""
    out: list = [None] * len(pairs)
    window = dict.fromkeys((k for k, p in enumerate(pairs)), FIRST_WINDOW)
    for k, (_, left, right) in enumerate(pairs):
        if not left or not right:
            out[k] = left + right
            del window[k]
    splits = {k: sum(map(codec.size, pairs[k][1])) for k in window}
    while window:
        jobs = []
        for k, n in window.items():
            raw, left, right = pairs[k]
            a, b = max(0, len(left) - n), min(len(right), n)
            begin = splits[k] - sum(map(codec.size, left[a:]))
            end = splits[k] + sum(map(codec.size, right[:b]))
            while a and raw[begin] & 0xC0 == 0x80:
                a -= 1
                begin -= codec.size(left[a])
            while b < len(right) and raw[end] & 0xC0 == 0x80:
                end += codec.size(right[b])
                b += 1
            jobs.append((k, a, b, begin, end))
        again = codec.encode_batch([pairs[k][0][begin:end].decode() for k, _, _, begin, end in jobs])
        for (k, a, b, _, _), ids in zip(jobs, again, strict=True):
            _, left, right = pairs[k]
            head, tail = a == 0 or ids[:4] == left[a : a + 4], b == len(right) or ids[-4:] == right[b - 4 : b]
            if head and tail and (a == 0 and b == len(right) or len(ids) >= 8):
                out[k] = left[:a] + ids + right[b:]
                del window[k]
            else:
                window[k] *= 2
    return out


def encode_long(codec: ByteBPE, texts: list[str], leaf_chars: int = LEAF_CHARS) -> list[list[int]]:
    """Token ids of every text, those longer than ``leaf_chars`` by halves and joins."""
    if not codec.splittable:
        return codec.encode_batch(texts)
    leaves: list[str] = []
    spans = []
    for t in texts:
        depth = max(0, (max(1, len(t)) - 1) // max(1, leaf_chars)).bit_length()
        cuts = [len(t) * k // (1 << depth) for k in range((1 << depth) + 1)]
        spans.append((len(leaves), len(cuts) - 1))
        leaves += [t[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    parts = {k for at, n in spans if n > 1 for k in range(at, at + n)}
    split, whole = sorted(parts), [k for k in range(len(leaves)) if k not in parts]
    ids = dict(zip(split, codec.encode_batch([leaves[k] for k in split], parallel=True), strict=True))
    ids.update(zip(whole, codec.encode_batch([leaves[k] for k in whole]), strict=True))
    nodes = [[(leaves[k], ids[k]) for k in range(at, at + n)] for at, n in spans]
    while any(len(x) > 1 for x in nodes):
        wide = [k for k, x in enumerate(nodes) if len(x) > 1]
        pairs = [((x[j][0] + x[j + 1][0]), x[j][1], x[j + 1][1]) for k in wide for x in (nodes[k],) for j in range(0, len(x), 2)]
        joined = iter(zip((t for t, _, _ in pairs), _join_windows(codec, [(t.encode(), a, b) for t, a, b in pairs]), strict=True))
        for k in wide:
            nodes[k] = [next(joined) for _ in range(0, len(nodes[k]), 2)]
    return [x[0][1] for x in nodes]


def encode(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", doc_id: str = "doc_id", text: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``(doc_id, ids array<int>)`` for each row; null texts count as empty and have no ids.

    The ids are those of the tokenizers library without added special tokens; special strings inside texts become
    special tokens, as is its default.  ``tokenizer``: a public file's name, or a path that every executor has.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        codec = load(tokenizer_path(tokenizer))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in slices(texts):
                ids = encode_long(codec, texts[lo:hi], leaf_chars)
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1]))
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``, special tokens kept; null ids give an empty text."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches):
        codec = load(tokenizer_path(tokenizer))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [codec.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for each row, encoded and decoded in one pass over the texts."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        codec = load(tokenizer_path(tokenizer))
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in slices(texts):
                n, ids_sha, text_sha = [], [], []
                for ids in encode_long(codec, texts[lo:hi]):
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
