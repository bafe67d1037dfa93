"""Fill-in-the-middle transformation by a byte automaton.

The automaton is a table over byte classes.  Its states follow three things at once: whether the last byte was white space, how many continuation
bytes of a UTF-8 character are still to come, and how much of a sentinel has been read.  Each transition carries counts: one for a unit's begin, one for a
character's begin, one for a sentinel's end.  Pass one scans a text and sums them; pass two finds the byte at which the n-th unit begins.

The automaton forgets all but its last few bytes (as many as a character or the longest sentinel has), so all positions of a
batch of texts are scanned at once: each starts that many bytes earlier and looks its way through the table.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.packing import byte_slices

#: Prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
WHITE = b" \t\n\v\f\r"
#: Stands between texts in a scan; UTF-8 has no such byte.
_BETWEEN = 0xFF
UNIT, CHARACTER, SENTINEL = 1, 2, 4


class ByteAutomaton:
    """``classes`` of bytes, ``step`` from state and class to state, ``emits`` from state and class to a set of events."""

    def __init__(self, sentinels: tuple[str, ...]):
        words = [s.encode() for s in sentinels]
        pairs = [(w, v) for i, w in enumerate(words) for j, v in enumerate(words) if i != j]
        if not all(words) or any(w in v for w, v in pairs) or any(w[:k] == v[-k:] for w in words for v in words for k in range(1, len(w))):
            raise ValueError("sentinels must not be empty, hold or overlap one another")
        if any(b in WHITE for w in words for b in w):
            raise ValueError("sentinels must not hold white space")
        self.reach = max(4, *map(len, words))
        letters = sorted({b for w in words for b in w})
        kinds: dict = {}
        self.classes = np.zeros(256, dtype=np.uint8)
        for b in range(256):
            if b == _BETWEEN:
                kind = "between"
            elif b in WHITE:
                kind = "white"
            elif b in letters:
                kind = b
            else:
                kind = "ascii" if b < 0x80 else "follows" if b < 0xC0 else 2 + (b >= 0xE0) + (b >= 0xF0) + 1000
            self.classes[b] = kinds.setdefault(kind, len(kinds))
        member = {c: next(b for b in range(256) if self.classes[b] == c) for c in range(len(kinds))}
        # States are found from the start: (white space last or none yet, continuation bytes left, read of a sentinel).
        start = (None, 0, b"")
        states = {start: 0}
        step, emits = [], []
        for state in iter_growing(states):
            to, out = [], []
            for c in range(len(kinds)):
                after, events = self._move(state, member[c], words, start)
                to.append(states.setdefault(after, len(states)))
                out.append(events)
            step.append(to)
            emits.append(out)
        self.step, self.emits = np.array(step, dtype=np.uint8), np.array(emits, dtype=np.uint8)

    @staticmethod
    def _move(state, byte: int, words: list[bytes], start):
        white, left, read = state
        if byte == _BETWEEN:
            return start, 0
        now = byte in WHITE
        events = 0
        # A unit begins with a text, and with white space after something else.
        if white is None or now and not white:
            events |= UNIT
        follows = 0x80 <= byte < 0xC0
        if not follows:
            events |= CHARACTER
        left = max(0, left - 1) if follows else (byte >= 0xC0) + (byte >= 0xE0) + (byte >= 0xF0)
        read += bytes([byte])
        if read in words:
            events |= SENTINEL
        read = max((read[k:] for k in range(len(read) + 1) if any(w.startswith(read[k:]) and w != read[k:] for w in words)), key=len)
        return (now, left, read), events

    def scan(self, data: np.ndarray) -> np.ndarray:
        """The events of every byte of texts that lie end to end with 0xFF before each."""
        kind = self.classes[data]
        width = self.step.shape[1]
        table = self.step.reshape(-1).astype(np.uint16) * width
        state = np.zeros(len(data), dtype=np.uint16)  # of the byte before, times width
        for back in range(self.reach, 0, -1):
            if back < len(data):
                state[back:] = table[state[back:] + kind[:-back]]
        return self.emits.reshape(-1)[state + kind]


def iter_growing(states: dict):
    """The keys of a dict that grows meanwhile."""
    at = 0
    while at < len(states):
        yield list(states)[at]
        at += 1


@cache
def automaton(sentinels: tuple[str, ...] = SENTINELS) -> ByteAutomaton:
    return ByteAutomaton(sentinels)


def draws(seed: int, doc_id) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document: the first groups of the digest of seed and id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def transform(
    docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, sentinels: tuple[str, str, str] = SENTINELS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` for each row: its text with a middle moved to the end.

    Units are runs of other than ASCII white space with the white space before them, and white space at a text's end.  Two cuts between the ``n``
    units, a ``rate`` of texts (in percent) and of those an ``spm_rate`` are drawn from the digest of ``seed`` and id, so any run gives the same.
    ``plain`` are null (empty), empty and undrawn texts and those that hold a sentinel; their counts of characters are null.  Repeated rows get
    equal results; a null id counts as empty text.  An empty table gives an empty result; other columns are left out.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    first, second, third = (s.encode() for s in sentinels)
    automaton(tuple(sentinels))  # wrong sentinels are told before any task runs

    def run(batches):
        scanner = automaton(tuple(sentinels))
        for batch in batches:
            for lo, hi in byte_slices(batch.column(1), 4 << 20):
                ids = batch.column(0).slice(lo, hi - lo)
                raw = [t or b"" for t in batch.column(1).slice(lo, hi - lo).cast(pa.binary()).to_pylist()]
                events = scanner.scan(np.frombuffer(b"\xff" + b"\xff".join(raw), dtype=np.uint8))
                begin = np.cumsum([1, *(len(t) + 1 for t in raw)])
                # Pass one: counts of each text.
                units = np.flatnonzero(events & UNIT)
                first_unit = np.searchsorted(units, begin)
                n = np.diff(first_unit)
                marked = np.diff(np.searchsorted(np.flatnonzero(events & SENTINEL), begin)) > 0
                chars = np.concatenate([[0], np.cumsum(events & CHARACTER > 0)])
                form, prefix, middle, output = [], [], [], []
                for k, (key, t) in enumerate(zip(ids.to_pylist(), raw, strict=True)):
                    h1, h2, h3, h4 = draws(seed, key)
                    if not t or marked[k] or h3 % 100 >= rate:
                        form.append("plain")
                        prefix.append(None)
                        middle.append(None)
                        output.append(t)
                        continue
                    # Pass two: the bytes at which the drawn units begin.
                    count, at = int(n[k]), int(begin[k])
                    ends = [int(units[first_unit[k] + u]) if u < count else at + len(t) for u in sorted((h1 % (count + 1), h2 % (count + 1)))]
                    a, b = ends[0] - at, ends[1] - at
                    head, body, tail = t[:a], t[a:b], t[b:]
                    form.append("spm" if h4 % 100 < spm_rate else "psm")
                    output.append(b"".join((second, tail, first, head, third, body) if form[-1] == "spm" else (first, head, second, tail, third, body)))
                    prefix.append(int(chars[ends[0]] - chars[at]))
                    middle.append(int(chars[ends[1]] - chars[ends[0]]))
                columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``transform`` made an output of. Texts of the other forms hold no sentinel, so each is found where it was put."""
    first, second, third = map(F.lit, sentinels)

    def after(mark: Column) -> Column:
        return F.substr(output, F.position(mark, output) + F.char_length(mark))

    def between(mark: Column, until: Column) -> Column:
        begin = F.position(mark, output) + F.char_length(mark)
        return F.substr(output, begin, F.position(until, output) - begin)

    psm = F.concat(between(first, second), after(third), between(second, third))
    spm = F.concat(between(first, third), after(third), between(second, first))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
