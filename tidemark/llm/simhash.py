"""SimHash near-duplicates with BK-trees.

Two fingerprints within radius r of 64 bits in r+4 blocks agree on at least four of them.  So the distinct
fingerprints are sharded by the value of each choice of four blocks; each shard's BK-tree has children keyed by their integer Hamming distance to
the parent, and a query follows only the edges within the radius.  The shards' trees travel to the tasks with
the shuffle instead of a broadcast, since fingerprints grow with the data.  A shard returns a spanning forest of
its links, never all pairs; components come from the links of all shards.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.graph import connected_components
from tidemark.llm.storage import discard, materialize

SEED, WIDTH = 42, 3


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 of each of a text's word shingles, repeats included; none for a text without words or a null.

    Only A-Z are lower-cased, and words are runs of anything but space and the bytes 9 to 13: what bytes.lower()
    and bytes.split() do.  Fewer words than ``width`` make one shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")


def fold(h: np.ndarray) -> int:
    """The SimHash of shingle hashes: the bits set in over half of them; 0 for none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a text's 3-word shingles, repeats included; 0 for a text without words or a null."""
    return fold(shingle_hashes(text))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp long, content long)`` for each row: the fingerprint as a signed long and a hash of the text."""

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), batch.column(1)], names=["doc_id", "fp", "content"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("content"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, fp bigint, content bigint")


class BKForest:
    """BK-trees over distinct 64-bit values, one for each group; built level by level, as by insertion in order."""

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        self.values = values
        self.group_ids, first, inverse = np.unique(groups, return_index=True, return_inverse=True)
        self.roots = first
        keys, children = [], []
        active = np.setdiff1d(np.arange(len(values)), first, assume_unique=True)
        parent = first[inverse[active]]
        while len(active):
            key = parent * 65 + np.bitwise_count(values[active] ^ values[parent]).astype(np.int64)
            unique, at, inverse = np.unique(key, return_index=True, return_inverse=True)
            child = active[at]
            keys.append(unique)
            children.append(child)
            stay = np.ones(len(active), dtype=bool)
            stay[at] = False
            parent, active = child[inverse[stay]], active[stay]
        key = np.concatenate(keys) if keys else np.empty(0, np.int64)
        order = np.argsort(key)
        self.keys, self.children = key[order], (np.concatenate(children) if keys else np.empty(0, np.int64))[order]

    def within(self, values: np.ndarray, groups: np.ndarray, radius: int, step: int = 1 << 15):
        """Yields (query index, member index) arrays of pairs at distance ``radius`` or less, in the query's own group."""
        for at in range(0, len(values), step):
            query = np.arange(at, min(at + step, len(values)))
            slot = np.searchsorted(self.group_ids, groups[query])
            slot[slot == len(self.group_ids)] = 0
            known = self.group_ids[slot] == groups[query]
            query, node = query[known], self.roots[slot[known]]
            while len(query):
                d = np.bitwise_count(values[query] ^ self.values[node]).astype(np.int64)
                hit = d <= radius
                yield query[hit], node[hit]
                if not len(self.keys):
                    break
                base = node * 65
                low = np.searchsorted(self.keys, base + np.maximum(d - radius, 0), side="left")
                high = np.searchsorted(self.keys, base + np.minimum(d + radius, 64), side="right")
                n = high - low
                query = np.repeat(query, n)
                node = self.children[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def forest_labels(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n points over the links (a, b), given the labels of earlier links."""
    while True:
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            return labels
        low, high = np.minimum(la, lb)[differ], np.maximum(la, lb)[differ]
        np.minimum.at(labels, high, low)
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped


def shard_links(values: np.ndarray, groups: np.ndarray, tree: np.ndarray, ask: np.ndarray, radius: int):
    """A spanning forest of the links within each group: members with ``tree`` set form the tree, those with ``ask`` query it."""
    inside, asking = np.flatnonzero(tree), np.flatnonzero(ask)
    labels = np.arange(len(values))
    if len(inside):
        forest = BKForest(values[inside], groups[inside])
        for q, m in forest.within(values[asking], groups[asking], radius):
            a, b = asking[q], inside[m]
            other = a != b
            labels = forest_labels(len(values), a[other], b[other], labels)
    linked = np.flatnonzero(labels != np.arange(len(values)))
    return values[linked], values[labels[linked]]


def block_keys(radius: int, spare: int = 3) -> list[list[tuple[int, int]]]:
    """Bit ranges (from, to) of each key: all choices of blocks that two values within ``radius`` may agree on.

    The 64 bits are cut into ``radius + 1 + spare`` blocks, of which such values differ in at most ``radius``; with three to spare and
    a radius of 2 a key is four of six blocks, 42 bits or more, so that values far apart hardly ever share one.
    """
    blocks = radius + 1 + spare
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [[(edges[k], edges[k + 1]) for k in chosen] for chosen in itertools.combinations(range(blocks), spare + 1)]


def links(prints: DataFrame, radius: int = 2, shard_cap: int = 1024) -> DataFrame:
    """``(a, b)``: links among the distinct values of ``prints.fp`` whose components are those of all links within the radius.

    Shards over ``shard_cap`` members are cut into parts; every pair of parts meets in a cell of its own, so a hot
    shard neither stays in one task nor loses a link.
    """
    keys = []
    for k, ranges in enumerate(block_keys(radius)):
        value = F.lit(0).cast("long")
        for lo, hi in ranges:
            value = F.shiftleft(value, hi - lo).bitwiseOR(F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)))
        keys.append(F.struct(F.lit(k).alias("block"), value.alias("value")))
    members = prints.select("fp").distinct().select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.block", "k.value")
    large = members.groupBy("block", "value").count().where(F.col("count") > shard_cap)
    large = large.select("block", "value", F.ceil(F.col("count") / shard_cap).cast("int").alias("parts"))
    parted = members.join(large, ["block", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = parted.withColumn("part", part).withColumn("other", other).select(
        "fp", "block", "value", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")
    )

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        col = {n: table.column(n).to_numpy() for n in ("fp", "block", "value", "part", "i", "j")}
        cell = np.stack([col[n].astype(np.int64) for n in ("block", "value", "i", "j")], axis=1)
        groups = np.unique(cell, axis=0, return_inverse=True)[1].reshape(-1)
        a, b = shard_links(col["fp"].view(np.uint64), groups, col["part"] == col["i"], col["part"] == col["j"], radius)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return cells.repartition("block", "value", "i", "j").mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2) -> DataFrame:
    """``(doc_id, fp, content, component_id)`` for each row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links between fingerprints at ``radius`` or fewer
    differing bits.  Null texts count as empty; texts without words share the fingerprint 0 and link like any others.  Null
    doc_ids get their group's smallest id, null only if the whole group has none.  Repeated rows give repeated rows.
    """
    prints = materialize(fingerprints(docs, doc_id, text), "simhash")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = materialize(links(prints, radius), "simhash-links")
    roots = connected_components(found)
    rooted = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "content", "component_id")


def sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """``(doc_id, content, node, n, fp, keys)`` for each row.

    ``node`` is a hash of the set of shingles, ``n`` its size, ``fp`` its SimHash, and ``keys`` one hash for each MinHash band; a
    text without words has no keys.
    """
    odd = np.random.default_rng(SEED).integers(0, 1 << 63, (bands * rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sketch(text: str | None):
        own = np.unique(shingle_hashes(text, width))
        keys = []
        if len(own):
            least = np.min([(own[at : at + 4096] * odd).min(axis=1) for at in range(0, len(own), 4096)], axis=0)
            keys = [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(bands, rows))]
        return xxhash.xxh64_intdigest(own.tobytes()), len(own), fold(own), np.array(keys, dtype=np.uint64).view(np.int64)

    def run(batches):
        for batch in batches:
            found = [sketch(t) for t in batch.column(2).to_pylist()]
            node, fp = (pa.array(np.array([f[k] for f in found], dtype=np.uint64).view(np.int64)) for k in (0, 2))
            n, keys = pa.array([f[1] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), node, n, fp, keys], names=["doc_id", "content", "node", "n", "fp", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows_in = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"), "text")
    return rows_in.mapInArrow(run, f"doc_id {kind}, content bigint, node bigint, n bigint, fp bigint, keys array<bigint>")


def candidate_links(members: DataFrame) -> DataFrame:
    """``(a, b)``: a link from each node of ``members(node, keys)`` to the smallest node of each band that it shares."""
    banded = members.select("node", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least")).where("size > 1")
    return banded.join(shared, "key").where("least <> node").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()


def similar_classes(sets: list[np.ndarray], fps: np.ndarray, start: int, similarity: float, radius: int) -> np.ndarray:
    """For each sorted set, the index of the first one reached of its class, from ``start`` on.

    Links are pairs of a Jaccard similarity of ``similarity`` or more whose SimHashes ``fps`` lie within ``radius``: a BK-tree of the
    sets not reached yet gives the candidates of those just reached, and the sets themselves decide.
    """
    labels = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    left, reached, label = np.delete(labels, start), np.array([start]), start
    while len(left):
        if not len(reached):
            reached, left, label = left[:1], left[1:], left[0]
            continue
        near: dict[int, list] = {}
        for q, m in BKForest(fps[left], np.zeros(len(left), np.int64)).within(fps[reached], np.zeros(len(reached), np.int64), radius):
            if not len(q):
                continue
            by = np.argsort(q, kind="stable")
            edges = np.flatnonzero(np.diff(q[by], prepend=-1))
            for asked, some in zip(q[by][edges].tolist(), np.split(m[by], edges[1:]), strict=True):
                near.setdefault(asked, []).append(some)
        linked = np.zeros(len(left), dtype=bool)
        for asked, parts in near.items():
            at, found = reached[asked], np.concatenate(parts)
            found = found[~linked[found]]
            other = left[found]
            fits = (np.minimum(sizes[other], sizes[at]) >= similarity * np.maximum(sizes[other], sizes[at]) - 1e-9) & (sizes[other] > 0)
            found, other = found[fits], other[fits]
            if not len(found):
                continue
            flat = np.concatenate([sets[k] for k in other])
            place = np.minimum(np.searchsorted(sets[at], flat), sizes[at] - 1)
            common = np.add.reduceat((sets[at][place] == flat).astype(np.int64), np.cumsum(sizes[other]) - sizes[other])
            linked[found[common >= similarity * (sizes[at] + sizes[other] - common) - 1e-9]] = True
        reached, left = left[linked], left[~linked]
        labels[reached] = label
    return labels


def salted(rows: DataFrame, few: DataFrame, key: str, by: str, how: str, salts: int = 64) -> DataFrame:
    """``rows`` joined to ``few``, which has one row for each ``key``, over ``salts`` tasks for each key, dealt by a hash of ``by``."""
    spread = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(by, F.lit("salt")), F.lit(salts)).cast("int")).join(spread, [key, "__salt"], how).drop("__salt")


def _cell_classes(cells: DataFrame, similarity: float, radius: int) -> DataFrame:
    """``(component, node, label)``: exact classes within each cell of ``cells(component, i, j, node, lead, fp, shingles)``."""

    def classes(table: pa.Table) -> pa.Table:
        node, fp = table.column("node").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        sets = [s.values.to_numpy().view(np.uint64) for s in table.column("shingles")]
        label = node[similar_classes(sets, fp, int(np.argmax(table.column("lead").to_numpy())), similarity, radius)]
        return pa.table({"component": table.column("component"), "node": node, "label": label})

    return cells.select("component", "i", "j", "node", "lead", "fp", "shingles").groupBy("component", "i", "j").applyInArrow(classes, "component bigint, node bigint, label bigint")


def _centres(placed: DataFrame) -> DataFrame:
    """``(component, leader)`` of components in several parts: the member nearest to the majority of its fingerprints."""
    many = placed.where("parts > 1")
    centre = F.lit(0).cast("long")
    for k in range(64):
        ones = F.sum(F.shiftrightunsigned("fp", k).bitwiseAND(F.lit(1)))
        centre = centre.bitwiseOR(F.when(ones * 2 > F.count(F.lit(1)), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("centre")))
    near = salted(many, many.groupBy("component").agg(centre.alias("centre")), "component", "node", "inner")
    return near.groupBy("component").agg(F.min(F.struct(far.alias("far"), "node")).getField("node").alias("leader"))


def similar_groups(
    docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 24, bands: int = 20, rows: int = 5, cell: int = 1 << 17
) -> DataFrame:
    """``(node, doc_id, content, class)``: one row per distinct set of ``width``-word shingles of ``docs(doc_id, text)``.

    ``class`` is shared by the sets that links of Jaccard similarity ``similarity`` or more connect; doc_id and content are those of the set's
    first row (smallest doc_id, nulls last).  Texts without words are one set.  Repeated rows, null ids and null texts are
    allowed; an empty table gives none.

    Sets that share one of ``bands`` MinHash bands of ``rows`` values (a pair at similarity 0.8 does with probability
    0.9996) are one shard, and so are shards that have a set in common.  A shard is cut into parts of about ``cell`` shingles, and each part with the
    shard's centre, the member nearest to the majority of its fingerprints, is a cell.  A cell's BK-trees give candidates
    within ``radius`` bits, and the shingle sets decide exactly.  Members not of the centre's class then meet all parts, cell by cell.
    """
    sketch = materialize(sketches(docs, width, bands, rows), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "content")).alias("first")
    grouped = sketch.groupBy("node", "n", "fp", "keys").agg(first)
    members = materialize(grouped.select("node", "n", "fp", "keys", F.col("first.doc_id").alias("doc_id"), F.col("first.content").alias("content")), "sketch-sets")
    discard(sketch)
    components = materialize(connected_components(candidate_links(members)), "similar-shards")
    weight = F.col("n") + F.lit(64)
    chosen = members.drop("keys").join(components, "node")
    big = chosen.groupBy("component").agg(F.sum(weight).alias("weight")).where(F.col("weight") > cell)
    big = big.select("component", F.ceil(F.col("weight") / cell).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    placed = salted(chosen, big, "component", "node", "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), parts).cast("int"))
    placed = materialize(placed.select("node", "fp", "component", weight.alias("weight"), "parts", "part", "doc_id", "content"), "similar-cells")
    centres = materialize(_centres(placed), "similar-centres")

    row = F.xxhash64("doc_id", "content").alias("row")
    texts = docs.select(F.xxhash64("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).alias("row"), "text")
    # A merge join at every size: the rows wanted grow with the table.
    texts = texts.join(placed.select(row, "node", "fp", "component", "weight", "parts", "part").hint("merge"), "row").dropDuplicates(["row"]).drop("row")

    def shingles(batches):
        for batch in batches:
            found = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names[1:], "shingles"])

    sets = texts.select("text", "node", "fp", "component", "weight", "parts", "part")
    sets = materialize(sets.mapInArrow(shingles, "node bigint, fp bigint, component bigint, weight bigint, parts int, part int, shingles array<bigint>"), "similar-sets")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = sets.withColumn("i", F.col("part")).withColumn("lead", F.lit(False))
    leads = sets.where("parts > 1").join(centres.select(F.col("leader").alias("node")), "node").withColumn("i", upto("parts")).withColumn("lead", F.lit(True))
    within = own.unionByName(leads.where("i <> part")).withColumn("j", F.lit(0))
    near = materialize(_cell_classes(within, similarity, radius).distinct(), "similar-links")

    # Classes that a part has besides the centre's; a node may be of one class in its own part only, and the centre of one in each.
    ledger = salted(placed.where("parts > 1"), centres, "component", "node", "inner")
    centred = salted(near, centres, "component", "node", "inner")
    central = centred.where("node = leader").select("component", F.col("label").alias("head")).distinct()
    apart = centred.join(central, (centred["component"] == central["component"]) & (F.col("label") == F.col("head")), "left_anti").select("node").distinct()
    lone = materialize(ledger.join(apart, "node").select("component", "node", "weight"), "similar-apart")
    rest = lone.groupBy("component").agg(F.ceil(F.sum("weight") / cell).cast("int").alias("others"))
    mine = lone.select("node", F.lit(True).alias("apart"))
    cross = salted(sets, rest, "component", "node", "inner").join(mine, "node", "left")
    other = F.pmod(F.xxhash64("node", F.lit("other")), F.col("others")).cast("int")
    as_member = cross.withColumn("j", upto("others")).withColumn("i", F.col("part"))
    as_other = cross.where("apart").withColumn("i", upto("parts")).withColumn("j", other).where("i <> part")
    far = _cell_classes(as_member.unionByName(as_other).withColumn("lead", F.lit(False)), similarity, radius)
    found = near.unionByName(far).where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    roots = connected_components(found)
    classes = members.join(roots, "node", "left").select("node", "doc_id", "content", F.coalesce("component", "node").alias("class"))
    classes = materialize(classes, "similar-classes")
    for done in (members, components, placed, centres, sets, near, lone):
        discard(done)
    return classes


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of similar texts (five-word shingles, similarity 0.8): that of the smallest doc_id, nulls last.

    Texts alone decide: of rows with the kept doc_id and text, the first by the other columns stays.
    """
    groups = similar_groups(docs.select("doc_id", "text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "content")).alias("f")
    kept = groups.groupBy("class").agg(first).select(F.xxhash64("f.doc_id", "f.content").alias("__row"), F.col("f.doc_id").alias("__doc"), F.col("f.content").alias("__content"))
    mine = docs.withColumn("__mine", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("__key", F.xxhash64("doc_id", "__mine"))
    same = (F.col("__key") == F.col("__row")) & F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__mine") == F.col("__content"))
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text") and docs.schema[c].dataType.simpleString().split("<")[0] not in ("map", "variant")]
    nth = F.row_number().over(Window.partitionBy("__key", "doc_id", "__mine").orderBy(*(rest or ["__key"])))
    return mine.join(kept, same, "left_semi").withColumn("__nth", nth).where("__nth = 1").select(*docs.columns)
