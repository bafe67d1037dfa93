"""Centroid clustering of integer vectors with block-norm screening.

A vector is compressed to the norms of its segments, positive and negative components apart.  By Cauchy and Schwarz the product of two vectors is at most the product of
their compressed forms, so |v|^2 + |c|^2 - 2 * that bounds their squared distance from below.  The centroid of the least bound
is measured exactly; only centroids whose bound isn't above that distance are measured too.

Vectors and norms are written once.  Each round sends the centroids (a few kilobytes) to all tasks; a task gives a count and a sum
for each cluster of its rows, so one row for each cluster and task is shuffled, and the driver gets one for each cluster.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize

#: Components saturate here, so that a squared distance of up to 128 of them stays within 64 bits.
MOST = 1 << 27
SEGMENT = 8


def integer_rows(rows: DataFrame, dims: int = 64, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, v array<int>)``: floor(scale * x) of each component as double, of the vectors with ``dims`` finite components.

    Rows with a null vector, another number of components, or a component that is null or not finite, are left out.  Components beyond 2^27 saturate.
    """
    x = F.col(embedding)
    good = x.isNotNull() & (F.size(x) == dims) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))

    def whole(e: Column) -> Column:
        scaled = F.least(F.greatest(e.cast("double") * scale, F.lit(float(-MOST))), F.lit(float(MOST)))
        return F.floor(scaled).cast("int")

    return rows.where(good).select(F.col(vec_id).alias("vec_id"), F.transform(x, whole).alias("v"))


def compressed(vectors: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Norms of the positive and of the negative parts of each segment, rounded up to single precision."""
    n, dims = vectors.shape
    wide = np.zeros((n, -(-dims // segment) * segment), dtype=np.float64)
    wide[:, :dims] = vectors
    parts = [np.einsum("nsk,nsk->ns", x, x) for x in (np.maximum(wide, 0).reshape(n, -1, segment), np.minimum(wide, 0).reshape(n, -1, segment))]
    norms = np.sqrt(np.concatenate(parts, axis=1))
    return np.nextafter((norms * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


@dataclass
class Screen:
    """Assigns vectors to the nearest of some centroids; counts the exact distances that it took."""

    centroids: np.ndarray
    segment: int = SEGMENT
    measured: int = 0
    norms: np.ndarray = field(init=False)
    square: np.ndarray = field(init=False)

    def __post_init__(self):
        self.norms = compressed(self.centroids, self.segment).astype(np.float64)
        self.square = np.einsum("kd,kd->k", self.centroids, self.centroids)

    def assign(self, vectors: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid of each vector, the smaller number if two are as near, and the squared distance."""
        n = len(vectors)
        rows = np.arange(n)
        square = np.einsum("nd,nd->n", vectors, vectors)
        total = square[:, None].astype(np.float64) + self.square
        bound = total - 2 * (norms.astype(np.float64) @ self.norms.T)
        bound -= 1e-9 * total  # of the double-precision sums
        likely = bound.argmin(axis=1)
        distance = np.full((n, len(self.centroids)), np.iinfo(np.int64).max)
        distance[rows, likely] = self._exact(vectors, rows, likely)
        left = bound <= distance[rows, likely][:, None]
        left[rows, likely] = False
        r, c = np.nonzero(left)
        distance[r, c] = self._exact(vectors, r, c)
        self.measured += n + len(r)
        best = distance.argmin(axis=1)
        return best, distance[rows, best]

    def _exact(self, vectors: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), dtype=np.int64)
        for at in range(0, len(rows), 16_384):
            part = slice(at, at + 16_384)
            gap = vectors[rows[part]] - self.centroids[cols[part]]
            out[part] = np.einsum("nd,nd->n", gap, gap)
        return out


def _matrix(lists: pa.Array, dims: int, kind) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(lists), dims)


def with_norms(vectors: DataFrame, dims: int, segment: int = SEGMENT) -> DataFrame:
    """``(vec_id, v, norms)``: vectors with their compressed forms."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            norms = compressed(_matrix(batch.column(1), dims, np.int64), segment)
            offsets = pa.array(np.arange(len(norms) + 1, dtype=np.int32) * norms.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(norms.reshape(-1)))], names=["vec_id", "v", "norms"])

    return vectors.select("vec_id", "v").mapInArrow(run, f"vec_id {kind}, v array<int>, norms array<float>")


def first_centroids(vectors: DataFrame, k: int, seed: int = 1) -> list[list[int]]:
    """The k vectors with the smallest digests of seed and id, in that order; the ids' decimals are digested, repeated ids go by their components, null ids take no part."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where(F.col("vec_id").isNotNull()).select(digest.alias("h"), "v").orderBy("h", "v").limit(k)
    return [list(r["v"]) for r in rows.collect()]


def _chunks(batches, dims: int):
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            part = batch.slice(at, 8192)
            yield part.column(0), _matrix(part.column(1), dims, np.int64), _matrix(part.column(2), part.column(2).value_lengths()[0].as_py(), np.float32)


def assigned(prepared: DataFrame, centroids: list[list[int]], segment: int = SEGMENT) -> DataFrame:
    """``(vec_id, cluster, distance)`` of prepared vectors."""
    kind = prepared.schema["vec_id"].dataType.simpleString()
    dims = len(centroids[0])

    def run(batches):
        screen = Screen(np.array(centroids, dtype=np.int64), segment)
        for ids, vectors, norms in _chunks(batches, dims):
            cluster, distance = screen.assign(vectors, norms)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return prepared.select("vec_id", "v", "norms").mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")


def moved(prepared: DataFrame, centroids: list[list[int]], segment: int = SEGMENT) -> tuple[list[list[int]], int]:
    """One round: each centroid becomes the floor of its vectors' mean, one without vectors stays. Also how many exact distances were taken."""
    k, dims = len(centroids), len(centroids[0])

    def run(batches):
        screen = Screen(np.array(centroids, dtype=np.int64), segment)
        n, total = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for _, vectors, norms in _chunks(batches, dims):
            cluster, _ = screen.assign(vectors, norms)
            n += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, vectors)
        met = np.flatnonzero(n)
        if len(met):
            offsets = pa.array(np.arange(len(met) + 1, dtype=np.int32) * dims)
            seen = [screen.measured, *[0] * (len(met) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(n[met]), pa.array(seen, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(total[met].reshape(-1)))], names=["cluster", "n", "measured", "total"])

    parts = prepared.select("vec_id", "v", "norms").mapInArrow(run, "cluster int, n bigint, measured bigint, total array<bigint>")
    sums = [F.sum(F.get("total", F.lit(d))).alias(f"s{d}") for d in range(dims)]
    out, measured = [list(c) for c in centroids], 0
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("measured").alias("measured"), *sums).collect():
        out[r["cluster"]] = [r[f"s{d}"] // r["n"] for d in range(dims)]
        measured += r["measured"]
    return out, measured


def clusters(vectors: DataFrame, dims: int = 64, k: int = 16, rounds: int = 3, seed: int = 1, segment: int = SEGMENT) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid)`` for each row of ``(vec_id, v)`` with ``dims`` components.

    Lloyd's rounds on exact integers: nearest centroid by squared distance, the smaller number in a tie; then the floor of each mean.  Fewer than
    k vectors give fewer centroids; repeated rows count each; an empty table gives an empty result.  The driver holds k centroids and k sums.
    """
    spark: SparkSession = vectors.sparkSession
    prepared = materialize(with_norms(vectors, dims, segment), "vectors")
    centroids = first_centroids(prepared, k, seed)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not centroids:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    for _ in range(rounds):
        centroids, _ = moved(prepared, centroids, segment)
    found = materialize(assigned(prepared, centroids, segment), "clusters")
    sums = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    total = sum(sums.values())
    facts = [(c, sums[c], total, centroids[c]) for c in sorted(sums)]
    by_cluster = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return found.join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


