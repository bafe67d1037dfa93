"""Benchmark decontamination by the q-gram lemma.

A stretch of text within e edits of a benchmark item of m characters shares at least m + 1 - q - q*e of its
q-grams, all on diagonals that differ by e at most.  So shared q-grams are counted in overlapping bands of diagonals, bands that
meet the bound are kept, and each is verified by a banded alignment of the whole item.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.chunk_dedup import slices

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BITS = 20
_MOST_HITS = 1 << 22


def normalize(text: str) -> bytes:
    """Lower case; runs of anything but letters, digits and non-ASCII characters become one space."""
    return b" ".join(text.lower().encode().translate(_PLAIN).split())


def qgram_codes(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code of the q bytes from each position on; equal q-grams have equal codes.  q is from 8 to 16."""
    n = len(data) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    c = data.astype(np.uint64)
    for width in (1, 2, 4):
        c = (c[:-width] << np.uint64(8 * width)) | c[width:]
    return (c[:n] * _K1) ^ ((c[q - 8 : q - 8 + n] * _K2) >> np.uint64(1))


def banded_distance(item: np.ndarray, region: np.ndarray, shift: int, band: int, most: int) -> tuple[int, int]:
    """Least edits that turn ``item`` into some stretch of ``region``, and that stretch's end; (most + 1, -1) if more.

    Diagonals (region position minus item position) run from ``shift - band`` to ``shift + band``; the stretch
    may begin and end anywhere inside that band.
    """
    lo = shift - band
    width = 2 * band + 1
    none = most + 1
    steps = np.arange(width)
    at = steps + lo  # region positions that stand for item position 0
    row = np.where((at >= 0) & (at <= len(region)), 0, none)
    for i, c in enumerate(item):
        before = at + i  # region position before this item character, by diagonal
        inside = (before >= 0) & (before < len(region))
        match = np.zeros(width, dtype=bool)
        match[inside] = region[before[inside]] == c
        new = np.where(inside, row + ~match, none)  # match or replace
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # leave the item's character out
        new = np.where((before + 1 >= 0) & (before + 1 <= len(region)), new, none)
        new = np.minimum.accumulate(new - steps) + steps  # take region characters in
        row = np.minimum(new, none)
        if row.min() >= none:
            return none, -1
    k = int(row.argmin())
    end = lo + k + len(item)
    return (int(row[k]), end) if row[k] <= most and end <= len(region) else (none, -1)


@dataclass
class Index:
    """Items, their edit budgets and bounds, and the sorted q-gram codes of all of them."""

    ids: list
    items: list[np.ndarray]
    budget: np.ndarray
    bound: np.ndarray
    band: int
    q: int
    codes: np.ndarray
    item: np.ndarray
    at: np.ndarray
    bitmap: np.ndarray
    short: list[tuple[int, bytes]]

    @classmethod
    def build(cls, rows: list[tuple], q: int, rate: float, short_items: bool = False) -> Index:
        """``rate`` times an item's length is its edit budget, lowered where the lemma's bound would not be positive.

        Items shorter than q have no q-gram: they are left out, or with ``short_items`` found as exact, whole words.
        """
        rows = [(i, normalize(t or "")) for i, t in rows if i is not None]
        short = [(i, t) for i, t in rows if 0 < len(t) < q] if short_items else []
        rows = [(i, t) for i, t in rows if len(t) >= q]
        items = [np.frombuffer(t, dtype=np.uint8) for _, t in rows]
        size = np.array([len(t) for t in items], dtype=np.int64)
        budget = np.minimum((size * rate).astype(np.int64), (size - q) // q)
        codes = [qgram_codes(t, q) for t in items]
        code = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(items)), [len(c) for c in codes])
        at = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.empty(0, np.int64)
        order = np.argsort(code, kind="stable")
        code, item, at = code[order], item[order], at[order]
        bitmap = np.zeros(1 << _BITS, dtype=bool)
        bitmap[code >> np.uint64(64 - _BITS)] = True
        band = int(budget.max()) if len(budget) else 0
        return cls([i for i, _ in rows], items, budget, size + 1 - q - q * budget, band, q, code, item, at, bitmap, short)

    def search(self, texts: list[str]) -> list[tuple[int, object, int, int]]:
        """(index of the text, item id, start and end of the stretch in the normalised text, edits), best stretch first in each band."""
        raw = [normalize(t) for t in texts]
        found = []
        for i, t in self.short:
            found += [(k, i, p, 0) for k, r in enumerate(raw) if (p := (b" " + r + b" ").find(b" " + t + b" ")) >= 0]
        data = np.frombuffer(b"\0".join(raw) + b"\0", dtype=np.uint8)
        begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
        code = qgram_codes(data, self.q)
        pos = np.flatnonzero(self.bitmap[code >> np.uint64(64 - _BITS)])
        code = code[pos]
        low, high = np.searchsorted(self.codes, code, "left"), np.searchsorted(self.codes, code, "right")
        n = high - low
        if n.sum() > _MOST_HITS and len(texts) > 1:
            # Each half in turn; short items are in ``found`` already.
            half = len(texts) // 2
            longer = Index(**{**vars(self), "short": []})
            return found + longer.search(texts[:half]) + [(k + half, *rest) for k, *rest in longer.search(texts[half:])]
        deals = max(1, -(-int(n.sum()) // _MOST_HITS))
        for deal in range(deals if n.sum() else 0):
            found += self._in_bands(raw, begins, *self._hits(pos, low, n, deal, deals))
        return found

    def _hits(self, pos: np.ndarray, low: np.ndarray, n: np.ndarray, deal: int, deals: int) -> tuple[np.ndarray, ...]:
        """Text position, item and item position of each shared q-gram of one of ``deals`` sets of items, so that common ones don't fill the memory."""
        parts = []
        at = 0
        ends = np.cumsum(n)
        while at < len(pos):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _MOST_HITS, "right")))
            some = slice(at, to)
            pick = np.repeat(low[some] - (np.cumsum(n[some]) - n[some]), n[some]) + np.arange(n[some].sum())
            mine = self.item[pick] % deals == deal
            parts.append((np.repeat(pos[some], n[some])[mine], self.item[pick][mine], self.at[pick][mine]))
            at = to
        return tuple(np.concatenate([p[k] for p in parts]) for k in range(3))

    def _in_bands(self, raw: list[bytes], begins: np.ndarray, pos: np.ndarray, item: np.ndarray, at: np.ndarray) -> list[tuple]:
        """Bands of diagonals with enough shared q-grams, verified."""
        found = []
        if not len(pos):
            return found
        text = np.searchsorted(begins, pos, "right") - 1
        diagonal = pos - at
        step = self.band + 1
        # Bands of two steps that overlap by one: diagonals at most `band` apart share one of them.
        cell = np.concatenate([diagonal // step, diagonal // step - 1])
        both = [np.concatenate([x, x]) for x in (text, item, pos)]
        # Bands repeat along a diagonal when an item occurs twice in a text, which is a different diagonal; so no cut along the text.
        keys = np.stack([both[0], both[1], cell], axis=1)
        order = np.lexsort((both[2], cell, both[1], both[0]))
        keys, at_pos = keys[order], both[2][order]
        fresh = np.ones(len(keys), dtype=bool)
        fresh[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        first = np.flatnonzero(fresh)
        # Distinct positions of the text: an item's repeated q-grams count once for each place.
        moved = fresh.copy()
        moved[1:] |= at_pos[1:] != at_pos[:-1]
        count = np.add.reduceat(moved.astype(np.int64), first)
        enough = count >= self.bound[keys[first, 1]]
        done = set()
        for k, it, band in keys[first[enough]].tolist():
            m, e = len(self.items[it]), int(self.budget[it])
            lo = band * step - e - int(begins[k])
            hi = lo + e + 2 * step + m + 2 * e
            region = np.frombuffer(raw[k], dtype=np.uint8)
            a, b = max(lo, 0), min(max(hi, 0), len(region))
            half = step + e + 1
            edits, end = banded_distance(self.items[it], region[a:b], band * step + step - int(begins[k]) - a, half, e)
            if edits <= e and (k, it) not in done:
                done.add((k, it))
                found.append((k, self.ids[it], max(a + end - m, 0), edits))
        return found


def _indexes(benchmark: DataFrame, q: int, rate: float, most_bytes: int, short_items: bool):
    """The benchmark's items in groups of about ``most_bytes`` UTF-8 bytes, each as an index that every executor gets."""
    items = benchmark.select("item_id", F.col("text").alias("text")).where("item_id is not null and text is not null")
    n_groups = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most_bytes))
    for group in range(n_groups):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_groups)) == group) if n_groups > 1 else items
        yield benchmark.sparkSession.sparkContext.broadcast(Index.build([(r["item_id"], r["text"]) for r in part.collect()], q, rate, short_items))


def leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", q: int = 12, rate: float = 0.05, most_bytes: int = 4 << 20, short_items: bool = False
) -> DataFrame:
    """``(doc_id, item_id, position, edits)``: each document and benchmark item of which it holds a stretch within the edit budget.

    ``benchmark`` is ``(item_id, text)``, its ids of any type.  An index of at most about ``most_bytes`` of items goes to every executor; a larger
    benchmark takes one pass over ``docs`` for each group of that size.  ``position`` is in the normalised text.  Null and
    empty texts and items hold nothing; repeated rows give repeated results.  Items of under ``q`` bytes after normalising are left out,
    since an answer such as "yes" is in too many texts; with ``short_items`` they are found as exact, whole words.
    """
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), benchmark.schema["item_id"].dataType
    rows = docs.where(F.length(text) > 0).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for shared in _indexes(benchmark, q, rate, most_bytes, short_items):

        def run(batches, shared=shared, item_type=to_arrow_type(item_kind)):
            index = shared.value
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for lo, hi in slices(texts):
                    found = index.search(texts[lo:hi])
                    columns = [batch.column(0).take(pa.array([lo + f[0] for f in found], pa.int64()))]
                    columns += [pa.array([f[k] for f in found], t) for k, t in ((1, item_type), (2, pa.int64()), (3, pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "position", "edits"])

        found = rows.mapInArrow(run, f"doc_id {kind}, item_id {item_kind.simpleString()}, position bigint, edits int")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", q: int = 12, rate: float = 0.05, most_bytes: int = 4 << 20, short_items: bool = False) -> DataFrame:
    """``docs`` without the rows whose own text holds a benchmark passage, whatever their doc_id; null texts stay.  No row is moved."""
    place = docs.columns.index(text)
    for shared in _indexes(benchmark, q, rate, most_bytes, short_items):

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                texts = [t or "" for t in batch.column(place).to_pylist()]
                keep = np.ones(len(texts), dtype=bool)
                for lo, hi in slices(texts):
                    keep[[lo + f[0] for f in index.search(texts[lo:hi])]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
