"""Substring dedup by content-defined chunking with a gear rolling hash.

A cut falls before a word where the gear hash of the 16 bytes before it is smaller than before the neighbouring words, so
cuts depend on local content only: an insertion moves the cuts near it and no others.  Pairs of neighbouring chunks are deduplicated by
digest: the smallest doc_id that holds one owns it.  Runs of pairs that one earlier document holds are then grown
character by character to the true ends of the match, and are repeated passages if they are long enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Gear table: one pseudo-random word for each byte, from a seed; 0 for the NUL that separates texts here.
GEAR = np.random.default_rng(0x6EA2).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
GEAR[0] = 0
#: Words, and characters of text without white space, on either side among which a cut has the smallest hash; bytes of a chunk.
NEAR_WORDS, NEAR_CHARS, MAX_BYTES = 3, 8, 96
_GAP = 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum over j < 32 of GEAR[data[i-j]] << j, modulo 2^32, by doubling.  Its low 16 bits see 16 bytes only."""
    h = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint32(width)
        h = h + shifted
    return h


def smallest(value: np.ndarray, group: np.ndarray, reach: int) -> np.ndarray:
    """Whether each value is the smallest within ``reach`` places of its group, the last of equals."""
    keep = np.ones(len(value), dtype=bool)
    for s in range(1, min(reach, len(value) - 1) + 1):
        apart = group[s:] != group[:-s]
        keep[:-s] &= apart | (value[:-s] < value[s:])
        keep[s:] &= apart | (value[s:] <= value[:-s])
    return keep


def chunk_bounds(joined: bytes, begins: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """Begin and end of every chunk of the texts ``joined[begin:stop]``, and two running counts over bytes: characters and words.

    Texts must have _GAP NULs between them.  Stretches without white space of over MAX_BYTES are cut by the same rule at characters.  What
    is still longer is cut after MAX_BYTES at most, before the word of the smallest hash in reach or where no word begins there.
    """
    data = np.frombuffer(joined, dtype=np.uint8)
    space = _SPACE[data]
    first_byte = (data & 0xC0) != 0x80
    word = ~space & first_byte
    word[1:] &= space[:-1] | (data[:-1] == 0)
    chars, words = (np.concatenate([[0], np.cumsum(x)]) for x in (first_byte, word))
    low = (gear_hash(data) & np.uint32(0xFFFF)).astype(np.int32)
    at = np.setdiff1d(np.flatnonzero(word & (data != 0)), begins, assume_unique=True)
    edges = [at[smallest(low[at - 1], np.searchsorted(begins, at, "right"), NEAR_WORDS)], begins, stops]
    breaks = np.concatenate([[-1], np.flatnonzero(space | (data == 0))])
    for k in np.flatnonzero(np.diff(breaks) > MAX_BYTES):
        inside = np.arange(breaks[k] + 2, breaks[k + 1])
        inside = inside[first_byte[inside]]
        edges.append(inside[smallest(low[inside - 1], np.zeros(len(inside)), NEAR_CHARS)])
    edge = np.unique(np.concatenate(edges))
    more = []
    for k in np.flatnonzero((np.diff(edge) > MAX_BYTES) & ~np.isin(edge[:-1], stops)):
        last, stop = int(edge[k]), int(edge[k + 1])
        while stop - last > MAX_BYTES:
            near = at[np.searchsorted(at, last, "right") : np.searchsorted(at, last + MAX_BYTES, "right")]
            if len(near):
                last = int(near[len(near) - 1 - int(low[near[::-1] - 1].argmin())])
            else:
                last += MAX_BYTES
                while not first_byte[last]:
                    last -= 1
            more.append(last)
    edge = np.unique(np.concatenate([edge, np.array(more, dtype=np.int64)]))
    inner = ~np.isin(edge[:-1], stops)
    return edge[:-1][inner], edge[1:][inner], chars, words


#: Fields of a pair's packed ``info``, by their bits from the lowest on.
FIELDS = {"chars": 10, "first_words": 8, "second_words": 8, "words_before": 8, "words_after": 8, "chars_before": 9, "chars_after": 9}


def pack(**fields: np.ndarray) -> np.ndarray:
    out, shift = np.zeros(len(fields["chars"]), dtype=np.int64), 0
    for name, bits in FIELDS.items():
        out |= fields[name].astype(np.int64) << shift
        shift += bits
    return out


def field(name: str, info: str = "info"):
    """One field of the packed column."""
    shift = sum(bits for n, bits in list(FIELDS.items())[: list(FIELDS).index(name)])
    return F.shiftrightunsigned(info, shift).bitwiseAND(F.lit((1 << FIELDS[name]) - 1))


def chunk_pairs(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Pairs of neighbouring chunks of all texts: index of the text, start in code points, info, digest of the bytes.

    White space at a pair's end takes no part in digest and length.  A text of one chunk is a pair of its own.
    """
    raw = [t.encode() for t in texts]
    filled = [k for k, r in enumerate(raw) if r]
    if not filled:
        return (np.empty(0, dtype=np.int64),) * 4
    joined = (b"\0" * _GAP).join(raw[k] for k in filled) + b"\0" * _GAP
    sizes = np.array([len(raw[k]) for k in filled], dtype=np.int64)
    begins = np.cumsum(sizes + _GAP) - sizes - _GAP
    begin, end, chars, words = chunk_bounds(joined, begins, begins + sizes)
    text = np.searchsorted(begins, begin, "right") - 1
    n_words = np.minimum(words[end] - words[begin], 255)
    n_chars = chars[end] - chars[begin]
    n = len(begin)
    place = np.arange(n)
    linked = np.append(text[1:] == text[:-1], False)
    alone = ~linked & ~np.concatenate([[False], linked[:-1]])
    take = place[linked | alone]
    second = np.where(linked[take], take + 1, take)

    def beside(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        inside = (at >= 0) & (at < n)
        at = np.where(inside, at, 0)
        return np.where(inside & (text[at] == text[take]), values[at], 0)

    digest = xxhash.xxh3_64_intdigest
    bodies = [joined[b:e].rstrip() for b, e in zip(begin[take].tolist(), end[second].tolist(), strict=True)]
    digests = np.fromiter(map(digest, bodies), dtype=np.uint64, count=len(take)).view(np.int64)
    length = chars[begin[take] + np.fromiter(map(len, bodies), dtype=np.int64, count=len(take))] - chars[begin[take]]
    info = pack(
        chars=length, first_words=n_words[take], second_words=np.where(second > take, n_words[second], 0),
        words_before=beside(n_words, take - 1), words_after=beside(n_words, second + 1),
        chars_before=beside(n_chars, take - 1), chars_after=beside(n_chars, second + 1),
    )
    start = chars[begin[take]] - chars[begins[text[take]]]
    return np.array(filled)[text[take]], start, info, digests


def slices(texts, most_chars: int = 1 << 20):
    """(from, to) ranges of a list of texts with about ``most_chars`` in each."""
    begin, n = 0, 0
    for k, t in enumerate(texts):
        n += len(t)
        if n >= most_chars:
            yield begin, k + 1
            begin, n = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def local_owners(rank: np.ndarray, same: np.ndarray, start: np.ndarray, digest: np.ndarray, often: int) -> np.ndarray:
    """For each pair of a digest that one slice has over ``often`` times, the pair of the slice's smallest document with it.

    -1 for the pairs of that document itself, and of rarer digests.  ``rank`` orders the pairs' documents, ``same`` is equal for equal doc_ids.
    """
    order = np.lexsort((start, rank, digest))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = digest[order][1:] != digest[order][:-1]
    group = np.cumsum(fresh) - 1
    head, size = order[np.flatnonzero(fresh)][group], np.bincount(group)[group] if len(group) else group
    owner = np.full(len(order), -1, dtype=np.int64)
    owner[order] = np.where((size <= often) | (same[head] == same[order]), -1, head)
    return owner


def content_key(text: str = "text"):
    """32 bits that tell apart the texts of rows with one doc_id."""
    return F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 1, often: int = 64) -> DataFrame:
    """``(doc_id, at, info, digest, owner, owner_at)`` for each pair of chunks of texts of ``least_chars`` or more with a doc_id.

    ``at`` is the text's content key << 31 | start.  ``owner`` and ``owner_at`` are set where a slice of a task's input has the pair over
    ``often`` times and this isn't its smallest document: pairs in very many documents are grouped once for each slice only.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        names = ["doc_id", "at", "info", "digest", "owner", "owner_at"]
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in slices(texts, 1 << 21):
                ids, keys = batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo).to_numpy()
                which, start, info, digest = chunk_pairs(texts[lo:hi])
                listed = ids.to_pylist()
                order = sorted(range(len(listed)), key=lambda k: (listed[k], int(keys[k])))  # noqa: B023
                rank, same = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=np.int64)
                for n, k in enumerate(order):
                    rank[k] = n
                    same[k] = same[order[n - 1]] if n and listed[order[n - 1]] == listed[k] else n
                at = (keys[which] << 31) | start
                head = local_owners(rank[which], same[which], start, digest, often)
                none = head < 0
                owner = ids.take(pa.array(np.where(none, 0, which[head]), mask=none))
                columns = [ids.take(pa.array(which)), pa.array(at), pa.array(info), pa.array(digest), owner, pa.array(at[head], mask=none)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.where((F.length(text) >= least_chars) & F.col(doc_id).isNotNull())
    rows = rows.select(F.col(doc_id).alias("doc_id"), content_key(text).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, at bigint, info bigint, digest bigint, owner {kind}, owner_at bigint")


def _is_space(char: str) -> bool:
    return char in " \t\n\r\v\f"


def common_end(a: str, b: str, whole_a: bool, whole_b: bool) -> int:
    """How many last characters of two stretches are alike, down to the beginning of a word in both.

    ``whole_*``: nothing comes before the stretch.
    """
    n = 0
    while n < min(len(a), len(b)) and a[-1 - n] == b[-1 - n]:
        n += 1
    for m in range(n, 0, -1):
        begins = (m == len(a) and whole_a or m < len(a) and _is_space(a[-1 - m])) and (m == len(b) and whole_b or m < len(b) and _is_space(b[-1 - m]))
        if not _is_space(a[-m]) and (begins or m < n and _is_space(a[-1 - m])):
            return m
    return 0


def common_start(a: str, b: str, whole_a: bool, whole_b: bool) -> int:
    """How many first characters of two stretches are alike, up to the end of a word in both."""
    return common_end(a[::-1], b[::-1], whole_a, whole_b)


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50, min_chars: int = 400, reach: int = 400) -> DataFrame:
    """Passages that an earlier document holds too: ``(doc_id, content, start, end, words, found_in)``, one row per passage and such document.

    A passage is a stretch of ``min_words`` whole words, or of ``min_chars`` code points, that a document of a smaller doc_id
    holds character by character: it begins and ends where its text and the other's part, ``start`` and ``end`` being code points.  Followed
    from document to document, ``found_in`` leads to one that keeps the passage.  Words are parted by ASCII white space.

    A pair of chunks belongs to the smallest document that has it; runs of pairs of one owner at one distance are grown by up to
    ``reach`` characters on both sides, more than a chunk, by comparing the texts.  Inside a run texts are equal by 64-bit digests.
    In a stretch of one short repeated phrase up to a chunk may stay at either end.  Repeats inside one document are left alone, rows with one doc_id count as one document, and rows with a null
    doc_id neither own nor lose a passage.
    """
    made = chunks(docs, doc_id, text, min(2 * min_words - 1, min_chars))
    free = F.col("owner_at").isNull()
    key = F.when(free, F.col("digest")).otherwise(F.xxhash64("doc_id", "at"))
    same = Window.partitionBy("key", "free").orderBy("doc_id", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keyed = made.withColumn("key", key).withColumn("free", free).drop("digest").withColumn("first", F.first(F.struct("doc_id", "at")).over(same))
    own = F.when(F.col("free"), F.col("first.doc_id")).otherwise(F.col("owner"))
    own_at = F.when(F.col("free"), F.col("first.at")).otherwise(F.col("owner_at"))
    start = lambda c: F.col(c).bitwiseAND(F.lit(0x7FFFFFFF))
    copies = keyed.select("doc_id", "at", "info", own.alias("owner"), own_at.alias("owner_at")).where("owner < doc_id")
    copies = copies.select(
        "doc_id", F.shiftright("at", 31).alias("content"), start("at").alias("start"), (start("at") + field("chars")).alias("end"), "info",
        "owner", F.shiftright("owner_at", 31).alias("owner_content"), (start("owner_at") - start("at")).alias("shift"),
    )

    def in_runs(rows: DataFrame, *line: str) -> DataFrame:
        """``rows`` numbered by runs of touching pairs, with the words that each adds to its run."""
        along = Window.partitionBy(*line).orderBy("start")
        opens = F.coalesce((F.col("start") > F.lag("end").over(along) + 1).cast("int"), F.lit(1))
        last = F.coalesce(F.lead("start").over(along) >= F.col("end"), F.lit(True))
        marked = rows.withColumn("opens", opens).withColumn("words", field("first_words") + F.when(last, field("second_words")).otherwise(F.lit(0)))
        return marked.withColumn("run", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("opens")

    # What no stretch of copied pairs, whoever owns them, and the chunks beside it can fill is no passage.
    whole = Window.partitionBy("doc_id", "content", "run")
    ends = F.struct(F.min("start").over(whole).alias("a"), F.max("end").over(whole).alias("b"), F.sum("words").over(whole).alias("n"))
    beside = F.struct(F.max(field("words_before") + field("words_after")).over(whole).alias("n"), F.max(field("chars_before") + field("chars_after")).over(whole).alias("c"))
    dense = in_runs(copies, "doc_id", "content").withColumn("ends", ends).withColumn("beside", beside)
    enough = (F.col("ends.n") + F.col("beside.n") * 2 >= min_words) | (F.col("ends.b") - F.col("ends.a") + F.col("beside.c") * 2 >= min_chars)
    line = ["doc_id", "content", "owner", "owner_content", "shift"]
    runs = in_runs(dense.where(enough).select(*line, "start", "end", "info"), *line).groupBy(*line, "run")
    runs = runs.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words")).drop("run")

    def asked(side: int, of: str, content: str, shift):
        return F.struct(F.lit(side).alias("side"), F.col(of).alias("of"), F.col(content).alias("of_content"), (F.col("start") + shift).alias("from"), (F.col("end") + shift).alias("to"))

    wanted = runs.withColumn("w", F.explode(F.array(asked(0, "doc_id", "content", F.lit(0)), asked(1, "owner", "owner_content", F.col("shift")))))
    wanted = wanted.select(*line, "start", "end", "words", "w.*")
    texts = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("of"), content_key(text).alias("of_content"), F.col(text).alias("text"))
    before = F.substring(F.col("text"), F.greatest(F.col("from") - reach, F.lit(0)).cast("int") + 1, F.least(F.col("from"), F.lit(reach)).cast("int"))
    after = F.substring(F.col("text"), F.col("to").cast("int") + 1, F.lit(reach))
    seen = wanted.join(texts, ["of", "of_content"]).select(*line, "start", "end", "words", "side", before.alias("before"), after.alias("after"))
    side = lambda n: F.max(F.when(F.col("side") == n, F.struct("before", "after")))
    both = seen.groupBy(*line, "start", "end", "words").agg(side(0).alias("mine"), side(1).alias("theirs"))
    both = both.select("doc_id", "content", "owner", "start", "end", "words", F.col("start") + F.col("shift"), "mine.before", "mine.after", "theirs.before", "theirs.after")
    kind = docs.schema[doc_id].dataType.simpleString()

    def grow(batches):
        for batch in batches:
            out = []
            for at, end, words, other, mine, after, their, their_after in zip(*(batch.column(k).to_pylist() for k in range(3, 11)), strict=True):
                left = common_end(mine or "", their or "", len(mine or "") == at, len(their or "") == other)
                right = common_start(after or "", their_after or "", len(after or "") < reach, len(their_after or "") < reach)
                added = (mine[len(mine) - left :] if left else "", after[:right] if right else "")
                out.append((at - left, end + right, words + sum(len(x.encode().split()) for x in added)))
            columns = [pa.array([x[k] for x in out], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, batch.column(2)], names=["doc_id", "content", "start", "end", "words", "found_in"])

    grown = both.toDF("doc_id", "content", "owner", "start", "end", "words", "other", "mine", "after", "their", "their_after").mapInArrow(
        grow, f"doc_id {kind}, content bigint, start bigint, end bigint, words bigint, found_in {kind}"
    )
    return grown.where((F.col("words") >= min_words) | (F.col("end") - F.col("start") >= min_chars)).distinct()


def without_spans(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` whose texts lose the spans ``(doc_id, content, start, end)``, which may overlap; rows without a span are as they were."""
    of = spans.groupBy(F.col("doc_id").alias("__doc"), F.col("content").alias("__content")).agg(
        F.array_sort(F.collect_set(F.struct(F.col("start").cast("int").alias("a"), F.col("end").cast("int").alias("b")))).alias("__spans")
    )
    same = (F.col(doc_id) == F.col("__doc")) & (content_key(text) == F.col("__content"))
    before = lambda s, k: F.coalesce(F.array_max(F.transform(F.slice("__spans", 1, k), lambda x: x["b"])), F.lit(0))
    gaps = F.transform("__spans", lambda s, k: F.struct(before(s, k).alias("a"), s["a"].alias("b")))
    gaps = F.concat(gaps, F.array(F.struct(F.array_max(F.transform("__spans", lambda x: x["b"])).alias("a"), F.length(text).alias("b"))))
    pieces = F.transform(F.filter(gaps, lambda g: g["b"] > g["a"]), lambda p: F.substring(F.col(text), p["a"] + 1, p["b"] - p["a"]))
    cut = F.when(F.col("__spans").isNull(), F.col(text)).otherwise(F.array_join(pieces, ""))
    return docs.join(of, same, "left").withColumn(text, cut).select(*docs.columns)


def with_length(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with ``n_chars`` set to the text's code points again, where there is such a column."""
    if n_chars not in docs.columns:
        return docs
    return docs.withColumn(n_chars, F.char_length(text).cast(docs.schema[n_chars].dataType))
