"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Every dimension has a posting list of its vectors, ordered by value and cut into segments of one quantised impact.  A query takes
all dimensions' segments by descending gain and adds them up.  A vector's score is bounded from below by what was
added, and from above by that, the quantising error, and the next segment of each dimension that it was not met in.
Processing stops only when these bounds prove that few vectors can be among the best; those are scored exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class ImpactIndex:
    """Posting segments of integer vectors, by dimension and quantised impact."""

    def __init__(self, vectors: np.ndarray, levels: int = 64):
        self.vectors = vectors
        n, self.dims = vectors.shape
        self.order = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T)
        ranked = np.take_along_axis(vectors.T, self.order, axis=1)
        self.low, self.high = ranked[:, 0].copy(), ranked[:, -1].copy()
        width = np.maximum(1, -(-(self.high - self.low + 1) // levels))
        level = (ranked - self.low[:, None]) // width[:, None]
        starts = [np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1]) for x in level]
        ends = [np.append(x[1:], n) for x in starts]
        self.dim = np.repeat(np.arange(self.dims), [len(x) for x in starts])
        self.start, self.end = np.concatenate(starts), np.concatenate(ends)
        self.lo, self.hi = ranked[self.dim, self.start], ranked[self.dim, self.end - 1]
        # What a segment is sure to add for each unit of a positive or negative weight, by posting.
        rise = [np.repeat(self.lo[self.dim == d] - self.low[d], e - s) for d, (s, e) in enumerate(zip(starts, ends, strict=True))]
        fall = [np.repeat(self.high[d] - self.hi[self.dim == d], e - s) for d, (s, e) in enumerate(zip(starts, ends, strict=True))]
        self.rise, self.fall = np.array(rise, dtype=np.float64), np.array(fall, dtype=np.float64)
        self.spread = np.zeros(self.dims, dtype=np.int64)
        np.maximum.at(self.spread, self.dim, self.hi - self.lo)

    def search(self, query: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """Indices and exact scores of a set that holds the k best vectors and every tie with the k-th.

        Segments are taken by descending gain, in ``rounds`` steps of about as many postings; of one dimension these
        are neighbours in its list.  The proof is tried after each of the later steps.
        """
        n = len(self.vectors)
        possible = np.arange(n)
        if n > 4 * k:
            weight = query[self.dim]
            base = np.minimum(query * self.low, query * self.high)
            gain = np.maximum(weight * self.lo, weight * self.hi) - base[self.dim]
            turn = np.argsort(-gain, kind="stable")
            size = self.end - self.start
            ends = np.cumsum(size[turn])
            error = np.abs(query) * self.spread
            low = np.zeros(n)
            met = np.zeros((self.dims, n), dtype=np.float32)
            taken = np.zeros(self.dims, dtype=np.int64)
            done = 0
            for step in range(1, rounds + 1):
                until = len(turn) if step == rounds else int(np.searchsorted(ends, ends[-1] * step // rounds, "right"))
                now = turn[done:until]
                done = until
                more = np.bincount(self.dim[now], weights=size[now], minlength=self.dims).astype(np.int64)
                for d in np.flatnonzero(more).tolist():
                    q, a, b = int(query[d]), int(taken[d]), int(taken[d] + more[d])
                    at = slice(n - b, n - a) if q > 0 else slice(a, b)
                    ids = self.order[d, at]
                    if q:
                        low[ids] += (self.rise if q > 0 else self.fall)[d, at] * abs(q)
                    met[d][ids] = 1
                taken += more
                if step * 2 < rounds:
                    continue
                bound = np.zeros(self.dims, dtype=np.int64)  # of what a dimension may still add
                np.maximum.at(bound, self.dim[turn[done:]], gain[turn[done:]])
                slack = bound.sum() + ((error - bound).astype(np.float32) @ met).astype(np.float64)
                margin = 1e-4 * (float(np.abs(error).sum()) + float(bound.sum())) + 1  # of the single-precision sums
                kth = np.partition(low, n - k)[n - k]
                possible = np.flatnonzero(low + slack + margin >= kth)
                if len(possible) <= max(4 * k, n // 64):
                    break
        return possible, self.vectors[possible] @ query


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """``(vec_id, v array<bigint>)``: floor(scale * x) of each component as double. Rows with a null vector, component or id, or a component that isn't finite, are left out."""
    x = F.col(embedding)
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    ints = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    return rows.where(x.isNotNull() & good & F.col(vec_id).isNotNull()).select(F.col(vec_id).alias("vec_id"), ints.alias("v"))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims), dtype=np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.concatenate([np.arange(s) for s in sizes]) if len(sizes) else []] = lists.flatten().to_numpy()
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 16_384, block_rows: int = 4_096) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k vectors of the largest inner product for each query, other than itself.

    Both inputs are ``(vec_id, v)``.  Ties go to the smaller vec_id; fewer candidates give fewer rows; a query whose id is repeated is taken once.  Vectors
    of unequal length are filled up with zeros.  Shards of about ``shard_rows`` vectors meet blocks of about
    ``block_rows`` queries, each pair in a task of its own, so neither side grows past memory.  Copies are spread
    over shards by their place in the table.
    """
    queries = queries.dropDuplicates(["vec_id"])
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    dims = max(size["d"] or 0, queries.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    n_shards = max(1, math.ceil(size["n"] / shard_rows))
    n_blocks = max(1, math.ceil(queries.count() / block_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shard = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n_shards)).cast("int")
    side = vectors.withColumn("shard", shard).withColumn("block", every(n_blocks))
    asks = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")).withColumn("shard", every(n_shards))

    def run(members: pa.Table, asking: pa.Table) -> pa.Table:
        out = [[], [], []]
        if members.num_rows and asking.num_rows:
            ids = members.column("vec_id").to_numpy()
            index = ImpactIndex(_matrix(members.column("v"), dims))
            own = {}
            for i, v in enumerate(ids.tolist()):
                own.setdefault(v, []).append(i)
            for q, query in zip(asking.column("vec_id").to_pylist(), _matrix(asking.column("v"), dims), strict=True):
                found, score = index.search(query, k + len(own.get(q, ())))
                found = ids[found]
                found, score = found[found != q], score[found != q]
                best = np.lexsort((found, -score))[:k]
                out[0] += [q] * len(best)
                out[1] += found[best].tolist()
                out[2] += score[best].tolist()
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    near = side.groupBy("shard", "block").cogroup(asks.groupBy("shard", "block")).applyInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
