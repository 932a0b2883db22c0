"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are dealt out by length, so that a batch of a task is a bucket of similar length. The
longest few give each query a first threshold. For a query and a bucket, threshold / (query length *
bucket length) is the cosine that a candidate needs at least: above 1 the bucket is skipped; near 1
two coordinates of a candidate must lie in narrow ranges; else its length alone decides. What is
left is verified by its integer product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridseek.llm.common import durable

#: Queries of one pass over the candidates, candidates for the first thresholds, rows of a bucket, queries that are multiplied at once.
QUERIES, SEEDS, BUCKET, TILE = 4096, 4096, 1000, 256
#: Cosine from which coordinates are looked at.
NARROW = 0.9
EDGE = 1e-6


def _numbers(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of all components, and the end of each vector."""
    ends = np.append(0, np.cumsum(column.value_lengths().to_numpy()))
    return np.floor(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * scale), ends


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products as long: by floats while these are exact, else by whole numbers, kept within the range of long."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], dtype=object) @ np.array([[int(x) for x in row] for row in b], dtype=object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Queries:
    """Queries of one dimension with their best scores so far."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.rows, self.ids, self.vectors, self.k = rows, ids, vectors, k
        self.length = np.sqrt((vectors**2).sum(axis=1))
        self.focus = np.argsort(-np.abs(vectors), axis=1)[:, :2]
        self.least = np.full(len(ids), -np.inf)

    def shortest(self) -> float:
        """The least length of a candidate that any of the queries can still need."""
        with np.errstate(divide="ignore", invalid="ignore"):
            low = np.where(self.length > 0, self.least / self.length, np.where(self.least > 0, np.inf, -np.inf))
        return float(low.min(initial=np.inf)) * (1 - EDGE) - EDGE

    def met(self, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of all pairs of this bucket that may be among the best k; raises the thresholds."""
        length = np.sqrt((vectors**2).sum(axis=1))
        longest = length.max(initial=0)
        reach = self.length * longest
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(reach > 0, self.least / reach, np.where(self.least > 0, np.inf, -np.inf))
        out = []
        every = np.flatnonzero((cosine < NARROW) & (cosine <= 1 + EDGE))
        for wide in (every[i : i + TILE] for i in range(0, len(every), TILE)):
            # lengths alone: those too short for each of these queries are left out
            low = (self.least[wide] / np.maximum(self.length[wide], EDGE)).min()
            some = np.flatnonzero(length >= low * (1 - EDGE) - EDGE) if low > 0 else np.arange(len(ids))
            score = _products(self.vectors[wide], vectors[some])
            # only the best k of each bucket can be among the best k
            own = self.ids[wide][:, None] == ids[some][None, :]
            if len(some) > self.k:
                enough = np.where(own, np.iinfo(np.int64).min, score)
                kth = np.partition(enough, len(some) - self.k, axis=1)[:, len(some) - self.k]
                self.least[wide] = np.maximum(kth.astype(float), self.least[wide])
            q, c = np.nonzero((score >= self.least[wide][:, None]) & ~own)
            out.append((wide[q], some[c], score[q, c]))
        unit = None
        for q in np.flatnonzero((cosine >= NARROW) & (cosine <= 1 + EDGE)):
            # cosine(q, c) >= t puts coordinate f of c between q_f t -+ sqrt((1 - t^2)(1 - q_f^2))
            unit = vectors / np.maximum(length, EDGE)[:, None] if unit is None else unit
            t = min(1.0, cosine[q])
            keep = length >= self.least[q] / max(self.length[q], EDGE) * (1 - EDGE) - EDGE
            for f in self.focus[q]:
                own = self.vectors[q, f] / self.length[q]
                width = np.sqrt(max(0.0, (1 - t * t) * (1 - own * own))) + EDGE
                # between t and 1 the range's middle moves from own * t to own
                keep &= (unit[:, f] >= min(own * t, own) - width) & (unit[:, f] <= max(own * t, own) + width)
            some = np.flatnonzero(keep & (ids != self.ids[q]))
            if len(some):
                score = _products(self.vectors[q : q + 1], vectors[some])[0]
                good = score >= self.least[q]
                out.append((np.full(int(good.sum()), q), some[good], score[good]))
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*out))


def _by_size(ids: np.ndarray, numbers: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, vectors) for each dimension."""
    sizes = np.diff(ends)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, rows, numbers[(ends[rows][:, None] + np.arange(size)).astype(np.int64)].reshape(len(rows), size)


def _best(out: list, k: int) -> pa.RecordBatch:
    """The best k of each query among found (row, query, candidate, score), ties to the smaller candidate."""
    row, query, found, score = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
    order = np.lexsort((found, -score, row))
    row, query, found, score = (x[order] for x in (row, query, found, score))
    start = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
    keep = rank < k
    return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (row, query, found, score)], names=["row", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of all other rows for each row whose id is divisible by `every`.

    Vectors that are null or empty, or hold null or non-finite components, and rows of a null id take
    no part. Scores are inner products of floor(scale * component) as long; ties go to the smaller
    id. Vectors of another dimension than the query's are not compared with it. A query's own id is
    left out; rows that repeat an id are each a candidate, and each a query. Other columns take no part.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & fine)
    # of the scaled and rounded vector, as the thresholds are
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.floor(x.cast("double") * scale).cast("double") * F.floor(x.cast("double") * scale).cast("double")))
    # by length and then id, so that a common length spreads out; stored once, so that a block of queries reads the files and row groups of its lengths only
    dealt = durable(rows.withColumn("length", length).repartitionByRange(F.desc("length"), F.col("vec_id")).sortWithinPartitions(F.desc("length"), "vec_id"))
    seeds = dealt.orderBy(F.desc("length"), "vec_id").limit(SEEDS).select("vec_id", "embedding").toArrow().combine_chunks()
    asked = dealt.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "embedding")
    n_blocks = max(1, -(-asked.count() // QUERIES))
    results = None
    for block in range(n_blocks):
        # a hashed share of the queries; what is collected has a fixed expected size
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == block) if n_blocks > 1 else asked
        found = _answered(dealt, own.toArrow().combine_chunks(), seeds, k, scale)
        if n_blocks > 1:  # a block's answers are stored, so that the plan doesn't grow with their number
            found = durable(_top(found, k))
        results = found if results is None else results.unionByName(found)
    return _top(results, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("row", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("row", "query_id", "vec_id", "score").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _answered(dealt: DataFrame, queries: pa.Table, seeds: pa.Table, k: int, scale: float) -> DataFrame:
    groups: dict[int, Queries] = {}
    if queries.num_rows:
        column = queries["embedding"].combine_chunks()
        numbers, ends = _numbers(column, scale)
        ids = queries["vec_id"].to_numpy()
        for size, at, vectors in _by_size(ids, numbers, ends):
            groups[size] = Queries(at, ids[at], vectors, k)
        numbers, ends = _numbers(seeds["embedding"].combine_chunks(), scale)
        ids = seeds["vec_id"].to_numpy()
        for size, at, vectors in _by_size(ids, numbers, ends):
            if size in groups:
                groups[size].met(ids[at], vectors)
    shared = dealt.sparkSession.sparkContext.broadcast(groups)
    shortest = min((g.shortest() for g in groups.values()), default=float("inf"))
    near = dealt.where(F.col("length") >= shortest).select("vec_id", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        own = {size: copy.copy(g) for size, g in shared.value.items()}
        for g in own.values():
            g.least = g.least.copy()
        out: list = []
        for batch in batches:
            for part in (batch.slice(i, BUCKET) for i in range(0, len(batch), BUCKET)):
                ids = part.column("vec_id").to_numpy()
                numbers, ends = _numbers(part.column("embedding"), scale)
                for size, at, vectors in _by_size(ids, numbers, ends):
                    if size in own:
                        g = own[size]
                        q, c, score = g.met(ids[at], vectors)
                        out.append((g.rows[q], g.ids[q], ids[at][c], score))
            if out:
                out = [tuple(x.to_numpy() for x in _best(out, k).columns)]
        yield _best(out, k)

    return near.mapInArrow(run, "row long, query_id long, vec_id long, score long")
