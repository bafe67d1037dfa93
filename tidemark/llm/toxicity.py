"""Toxicity scores of texts read through their disguises.

A noisy channel: the writer's letters were replaced by look-alikes, stretched or spaced out.  Every suspicious token becomes a
lattice of the letters it may stand for, and Viterbi decoding under a character trigram model of the whole corpus
restores it.  The restored words and their beginnings are scored by a logistic regression that is learned from labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import discard, materialize

#: Look-alikes and the letters they stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Letters of other scripts that look like Latin ones, and signs that show nothing.
CONFUSABLE = str.maketrans(
    "авекмнорстухіјѕԁԛԝһӏьгαβγεηικνορτυχωϲ" + "АВЕКМНОРСТУХІЈЅҺԚԜΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "abekmhopctyxijsdqwhlbrabyenikvoptuxwc" + "ABEKMHOPCTYXIJSHQWABEZHIKMNOPTYX",
    "\u00ad\u200b\u200c\u200d\u2060\ufeff",
)
_FOREIGN = re.compile("[^\x00-\xac\xae-\xff€“”„‘’…–—]")
_EDGES = " \t\n\r\v\f!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…¿¡–—"
#: Letters and something else together, and a character twice in a row: all that a lattice could read in more than one way.
_MIXED = re.compile(r"[^\W\d_].*[\W\d_]|[\W\d_].*[^\W\d_]|(\S)\1\1", re.S)
_TWICE = re.compile(r"(\S)\1")
_SPACED, _MAYBE_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)"), re.compile(r"(?<!\S)\S\s+\S\s+\S(?!\S)")
NARROW, WIDE = " ", "\n"
_PLAIN = "".join(c for c in _EDGES if c not in LOOKALIKES)
_RUN = re.compile(r"(.)\1*", re.S)
_N = 27  # a word's edge, and a to z
_DROP = -1


def unmasked(text: str) -> str:
    """Lower case, with compatibility forms and look-alikes of other scripts as plain letters and without invisible signs."""
    try:
        text.encode("latin-1")
        odd = "\xad" in text
    except UnicodeEncodeError:
        odd = _FOREIGN.search(text)
    return ("".join(map(_unmasked, text.translate(CONFUSABLE))) if odd else text).lower()


@lru_cache(1 << 16)
def _unmasked(c: str) -> str:
    """A character as NFKC has it, without marks over a Latin letter, and then as its look-alike; all but letters stay."""
    if ord(c) < 256 or not unicodedata.category(c)[0] in "LN":
        return c
    plain = unicodedata.normalize("NFKC", c).translate(CONFUSABLE)
    base = unicodedata.normalize("NFD", plain)[:1]
    return base if len(plain) == 1 and base.isascii() else plain


def _alike() -> dict[str, str]:
    """Letters that some look-alike may both stand for, by one of them."""
    group = {chr(97 + k): chr(97 + k) for k in range(26)}
    for some in LOOKALIKES.values():
        first, *rest = sorted({group[x] for x in some})
        group = {x: first if g in rest else g for x, g in group.items()}
    return group


_GROUP = _alike()


def _fold() -> bytes:
    """Latin-1 characters, lower case, as 0 for anything but a letter and 1 to 26 for letters without their accents."""
    base = [unicodedata.normalize("NFKD", bytes([c]).decode("latin-1").lower())[:1] for c in range(256)]
    base = ["s" if c == 0xDF else b for c, b in enumerate(base)]
    return bytes(ord(b) - 96 if "a" <= b <= "z" else 0 for b in base)


_CLASS = _fold()
PREFIXES = (4, 5, 6, 7)


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("latin-1", "replace").translate(_CLASS), dtype=np.uint8)


class CharModel:
    """A character trigram model with smoothing by lower orders."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(_N, _N, _N).astype(float)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + _N)
        p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
        p3 = (three + 20 * p2[None]) / (three.sum(axis=2, keepdims=True) + 20)
        self.log = np.log(p3).reshape(-1).tolist()

    def restore(self, token: str) -> str:
        """The likeliest letters behind a token, words parted by blanks; its length bounds the lattice, and time grows in proportion.

        NARROW in a token is a gap that may part words, WIDE one that does.
        """
        log = self.log
        beams = {0: (0.0, None)}  # by the last two letters; a path is (letter, path before)
        runs = [(m[0][0], len(m[0])) for m in _RUN.finditer(token)]
        for ch, nth, run in ((c, k, n) for c, n in runs for k in range(n)):
            fate = _options(ch, nth, run)
            new: dict[int, tuple] = {}
            for state, (score, path) in beams.items():
                for letter, cost in fate:
                    if letter == _DROP:
                        to, s, p = state, score + cost, path
                    else:
                        to = (state % _N) * _N + letter
                        s, p = score + cost + log[state * _N + letter], (letter, path)
                    if to not in new or s > new[to][0]:
                        new[to] = (s, p)
            beams = new
        _, path = max(((score + log[state * _N], path) for state, (score, path) in beams.items()), key=lambda x: x[0])
        out = []
        while path:
            out.append(chr(96 + path[0]) if path[0] else " ")
            path = path[1]
        return "".join(reversed(out)).strip()


def _options(ch: str, nth: int, run: int) -> list[tuple[int, float]]:
    """What the nth character of a run of the same may stand for: (letter, log-probability), or nothing at all.

    A letter after itself is mostly spelling in a run of two, and mostly stretching in a longer one.
    """
    if ch == NARROW:
        return [(0, math.log(0.2)), (_DROP, math.log(0.8))]
    if ch == WIDE:
        return [(0, 0.0)]
    again = 0.0 if not nth else 0.2 if run == 2 else 0.7
    code = ch.encode("latin-1", "replace")
    letter = _CLASS[code[0]] if ch.isalpha() else 0
    if letter:
        return [(letter, math.log(1 - again)), (_DROP, math.log(again))] if nth else [(letter, 0.0)]
    if ch in LOOKALIKES:
        some = LOOKALIKES[ch]
        drop = max(again, 1e-4)
        return [(ord(x) - 96, math.log((1 - drop) / len(some))) for x in some] + [(_DROP, math.log(drop))]
    return [(_DROP, 0.0)]


class _Shapes(dict):
    """For ``str.translate``: a letter without its accent, or a look-alike, each as the group of letters that it may be taken for; all else goes."""

    def __init__(self, marks: bool):
        self.marks = marks

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        if ch in LOOKALIKES:
            c = LOOKALIKES[ch][0] if self.marks or ch.isdigit() else ""
        else:
            k = _CLASS[ch.encode("latin-1", "replace")[0]] if ch.isalpha() else 0
            c = chr(96 + k) if k else ""
        self[code] = _GROUP.get(c, c)
        return self[code]


_SHAPES = (_Shapes(True), _Shapes(False))


def _beginning(text: str, marks: bool = True) -> str:
    """The first three letters of a text in their shapes, runs as one; look-alike marks only with ``marks``."""
    out = ""
    for c in text.translate(_SHAPES[not marks]):
        if out[-1:] != c:
            out += c
            if len(out) == 3:
                break
    return out


class Shapes:
    """The shapes of features: no token of another shape can be restored to any of them."""

    def __init__(self, features):
        shape = lambda f: _RUN.sub(r"\1", f[1:].translate(_SHAPES[0]))
        self.words = frozenset(shape(f) for f in features if f[0] == "=")
        self.prefixes = frozenset(shape(f) for f in features if f[0] == "^")
        self.sizes = sorted({len(p) for p in self.prefixes})
        self.begins = frozenset(s[:3] for s in self.words | self.prefixes)

    def _fit(self, text: str, marks: bool = True) -> bool:
        if _beginning(text, marks) not in self.begins:
            return False
        shape = _RUN.sub(r"\1", text.translate(_SHAPES[not marks]))
        return shape in self.words or any(shape[:k] in self.prefixes for k in self.sizes)

    def fit(self, token: str, word: str) -> bool:
        """Whether the token could be a feature's word, with the marks around it or without, with look-alike marks as letters or without."""
        return self._fit(token) or token != word and self._fit(word) or not token.isalnum() and self._fit(token, False)


def readings(token: str, model: CharModel, shapes: Shapes | None = None) -> list[str]:
    """The words that a lower-case token may be read as: itself without the marks around it, and its restored form.

    With ``shapes`` a token is restored only if its own shape fits.
    Without, as while features are being chosen, letters that are only doubled are taken as they stand.
    """
    word = token.strip(_EDGES)
    out = [word] if word else []
    core = token.lstrip(_PLAIN + "(").rstrip(_PLAIN + "!")
    if _MIXED.search(core) if shapes is None else (_TWICE.search(core) or _MIXED.search(core) or not core.isascii()) and shapes.fit(core, word):
        restored = model.restore(core)
        if restored and restored != word:
            out.append(restored)
    return out


def names(word: str) -> list[str]:
    """A word's features: the word, and its beginnings."""
    return ["=" + word, *("^" + word[:k] for k in PREFIXES if len(word) >= k)]


def spaced_out(text: str):
    """Lattices for stretches of single characters that aren't all the same: the characters, with NARROW between them and WIDE where the gap is a wider one."""
    for m in _SPACED.finditer(text):
        if len(set(m[0].split())) < 2:
            continue
        gaps = re.findall(r"\s+", m[0])
        least = min(map(len, gaps))
        yield "".join(c + g for c, g in zip(m[0].split(), [NARROW if len(g) == least else WIDE for g in gaps] + [""], strict=True))


class Reader:
    """Counts features of texts; with ``chosen`` only those, by their index."""

    def __init__(self, model: CharModel, chosen: dict[str, int] | None = None):
        self.model, self.chosen, self.known = model, chosen, {}
        self.shapes = None if chosen is None else Shapes(chosen)
        self.halves: dict[str, set[str]] = {}  # of chosen words, by their first part
        self.joined: dict[tuple[str, str], bool] = {}  # at most one entry for each place in a chosen word
        for f in chosen or ():
            for k in range(1, len(f) - 1) if f[0] == "=" else ():
                self.halves.setdefault(f[1 : 1 + k], set()).add(f[1 + k :])

    def _parted(self, words: list[str]) -> list[str]:
        """Chosen words that stand in two neighbouring parts, where the language model joins the parts."""
        out = []
        for k, rests in enumerate(map(self.halves.get, words[:-1])):
            if rests is not None and (rest := words[k + 1].strip(_EDGES)) in rests:
                first = words[k]
                joined = self.joined.get((first, rest))
                if joined is None:
                    joined = self.joined[first, rest] = self.model.restore(first + NARROW + rest) == first + rest
                if joined:
                    out.append(first + rest)
        return out

    def _of(self, token: str):
        found = [f for w in readings(token, self.model, self.shapes) for f in names(w)]
        if self.chosen is not None:
            found = [self.chosen[f] for f in found if f in self.chosen]
        return tuple(dict.fromkeys(found))

    def features(self, text: str) -> Counter:
        low = unmasked(text)
        words = low.split()
        counts = Counter(words)
        if self.halves:
            counts.update(self._parted(words))
        if _MAYBE_SPACED.search(low):
            for lattice in spaced_out(low):
                counts.update(w for w in self.model.restore(lattice).split() if len(w) > 1)
        out: Counter = Counter()
        known = self.known
        if len(known) > (30_000 if self.chosen is None else 150_000):  # of words' features, not of words
            known.clear()
        for token, n in counts.items():
            of = known.get(token)
            if of is None:
                of = known[token] = self._of(token)
            for f in of:
                out[f] += n
        return out


@dataclass
class Model:
    chars: CharModel
    index: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, reader: Reader, text: str) -> float:
        z = self.bias
        for f, n in reader.features(text).items():
            z += self.weights[f] * math.log2(1 + n)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def char_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts over every text; at most 27^3 sums leave a task or reach the driver."""

    def run(batches):
        total = np.zeros(_N**3, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = [t for t in batch.column(0).slice(at, 256).to_pylist() if t]
                c = np.concatenate([np.zeros(2, np.uint8), letters(" ".join(part)), np.zeros(1, np.uint8)]).astype(np.int32)
                code = c[:-2] * (_N * _N) + c[1:-1] * _N + c[2:]
                # Of neighbouring edges only one is a transition of a word.
                total += np.bincount(code[(c[1:-1] > 0) | (c[2:] > 0)], minlength=_N**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["code", "n"])

    out = np.zeros(_N**3, dtype=np.int64)
    for code, n in docs.select(text).mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n")).collect():
        out[code] = n
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``(toxic, text)`` of at most ``most`` labelled documents outside the held-out fold, drawn by a hash of doc_id.

    Of rows with one doc_id the smallest text is taken, so repeated ids don't add rows.
    """
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = marked.where(~held_out()).orderBy(F.xxhash64("doc_id", F.lit("train")), "doc_id").limit(most)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")


def _feature_counts(rows: DataFrame, chars: CharModel) -> DataFrame:
    """``(feature, pos, neg)``: in how many of the toxic and of the other rows each feature is."""
    shared = rows.sparkSession.sparkContext.broadcast(chars)

    def run(batches):
        reader = Reader(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                seen = (Counter(), Counter())
                for toxic, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    seen[toxic > 0].update(reader.features(text).keys())
                every = sorted(seen[0].keys() | seen[1].keys())
                columns = [pa.array(every, pa.string()), pa.array([seen[1][f] for f in every], pa.int64()), pa.array([seen[0][f] for f in every], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["feature", "pos", "neg"])

    return rows.mapInArrow(run, "feature string, pos bigint, neg bigint").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, min_rows: int = 4, errors: float = 4.5) -> Model:
    """A model from at most ``most_rows`` labelled rows of ``docs``, and character counts of all its texts.

    Features are all those of ``min_rows`` training rows or more whose share among toxic rows exceeds that among the
    others by over ``errors`` standard errors.  Without labelled rows of both kinds every score is the share of toxic ones.
    """
    spark = docs.sparkSession
    chars = CharModel(char_counts(docs))
    rows = materialize(training_rows(docs, labels, most_rows), "training-rows")
    tally = rows.groupBy("toxic").count().collect()
    n_pos, n_neg = (float(sum(r["count"] for r in tally if (r["toxic"] > 0) == t)) for t in (True, False))
    prior = (n_pos + 0.5) / (n_pos + n_neg + 10)
    if not n_pos or not n_neg:
        discard(rows)
        return Model(chars, {}, np.zeros(0), math.log(prior / (1 - prior)))
    share = (F.col("pos") + F.col("neg")) / F.lit(n_pos + n_neg)
    z = (F.col("pos") / F.lit(n_pos) - F.col("neg") / F.lit(n_neg)) / F.sqrt(share * (1.0000001 - share) * F.lit(1 / n_pos + 1 / n_neg))
    ranked = _feature_counts(rows, chars).where(F.col("pos") + F.col("neg") >= min_rows).withColumn("z", z).where(F.col("z") > errors)
    index = {r["feature"]: k for k, r in enumerate(ranked.orderBy(F.desc("z"), "feature").collect())}
    shared = spark.sparkContext.broadcast((chars, index))

    def run(batches):
        reader = Reader(*shared.value)
        for batch in batches:
            found = [reader.features(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["toxic", "f", "n"])

    data = rows.mapInArrow(run, "toxic int, f array<int>, n array<int>").collect()
    discard(rows)
    y = np.array([r["toxic"] > 0 for r in data], dtype=float)
    row = np.repeat(np.arange(len(data)), [len(r["f"]) for r in data])
    col = np.array([f for r in data for f in r["f"]], dtype=np.int64)
    val = np.log2(1 + np.array([n for r in data for n in r["n"]], dtype=float))
    weights, bias = _logistic(y, row, col, val, len(index))
    return Model(chars, index, weights, bias)


def _logistic(y, row, col, val, n_features: int, ridge: float = 1.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with a ridge penalty, by gradient steps scaled per weight, on sparse rows."""
    w, b = np.zeros(n_features), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    scale = np.bincount(col, weights=val * val, minlength=n_features) / 4 + ridge
    m, mb, before = np.zeros(n_features), 0.0, np.inf
    rate = 0.5
    for _ in range(steps):
        z = b + np.bincount(row, weights=w[col] * val, minlength=len(y))
        p = 1 / (1 + np.exp(-z))
        loss = float(np.logaddexp(0, z).sum() - y @ z + ridge / 2 * w @ w)
        if loss > before:
            rate, m, mb = rate / 2, m * 0, 0.0
        before = loss
        g = np.bincount(col, weights=(p - y)[row] * val, minlength=n_features) + ridge * w
        m = 0.8 * m + rate * g / scale
        mb = 0.8 * mb + rate * float((p - y).sum()) / (len(y) / 4)
        w, b = w - m, b - mb
    return w, float(b)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, model: Model | None = None, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``; ``predicted`` is 1 from ``threshold`` on.

    Scores read whole texts and nothing else.  Null and empty texts get the score of a text without features.
    ``held_out`` is null for a null doc_id.  Repeated rows give repeated rows.
    """
    model = model or fit(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        reader = Reader(model.chars, model.index)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                scores = [model.score(reader, t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """``docs`` without the documents whose score reaches ``threshold``; all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))

    def run(batches):
        model = shared.value
        reader = Reader(model.chars, model.index)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keep = [model.score(reader, t or "") < threshold for t in part.column("text").to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
