"""Exact top-k inner products by three phases with a uniform threshold.

A vector's components form SLICES lists of partial scores. Phase 1 makes the first list only: every partition gathers the
full scores of its head, and each query's k-th best of all heads is a safe cutoff. Phase 2: the cutoff is broadcast and lists are made
again; entries that have the uniform threshold cutoff / SLICES in one list at least are collected, since an entry that reaches the
cutoff has. Candidates whose first half falls so far short for every query of a tile that the other half can't make up for it, by
Cauchy and Schwarz, get no further lists. Phase 3: of the collected entries, and of no others, the scores of all lists are added
up exactly, and each partition's k best go to the final ranking. Queries come in blocks of BLOCK, one after the other, so what is
broadcast has a fixed bound; no pair of a query and a candidate is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import table, trimmed, written

SLICES, BLOCK, TILE = 4, 4096, 1024
#: Below every score, and safe to negate.
LOWEST = -(1 << 62)


def quantised(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and floor(scale * x), by vector length, of the rows that take part."""
    ids, vectors = batch.column(0), batch.column(1)
    size = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten()
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) * scale)
    ends = np.cumsum(size)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    good = ids.is_valid().to_numpy(zero_copy_only=False) & vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - size])
    known = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for n in np.unique(size[good]):
        rows = np.flatnonzero(good & (size == n))
        yield known[rows], x[(ends - size)[rows, None] + np.arange(n)]


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: in float64 where no sum can pass 2**53, else in int64 or Python's integers; what a long
    doesn't hold becomes the largest or smallest score."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(q) @ whole(c).T, LOWEST + 1, -LOWEST - 1).astype(np.int64)


class Best:
    """The k best (score, smaller id) of each query."""

    def __init__(self, k: int):
        self.k, self.q, self.ids, self.scores = k, *(np.empty(0, np.int64) for _ in range(3))

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        q, ids, scores = np.concatenate([self.q, q]), np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        top = rank < self.k
        self.q, self.ids, self.scores = q[top], ids[top], scores[top]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.q), pa.array(self.ids), pa.array(self.scores)], ["q", "vec_id", "score"])


def _tiles(batches, scale, blocks):
    """Each tile of candidates with each block of queries of the same length: numbers, own ids and vectors, ids and vectors."""
    for b in batches:
        for at in range(0, b.num_rows, TILE):
            for ids, rows in quantised(b.slice(at, TILE), scale):
                for numbers, own, vectors in blocks:
                    if vectors.shape[1] == rows.shape[1]:
                        for lo in range(0, len(numbers), TILE):
                            yield numbers[lo : lo + TILE], own[lo : lo + TILE], vectors[lo : lo + TILE], ids, rows


def _cuts(n: int) -> list[tuple[int, int]]:
    at = np.linspace(0, n, SLICES + 1).astype(int)
    return [*zip(at, at[1:])]


def _pairs(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two arrays of one shape."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < 2**53:
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    return np.array([products(x[None], y[None])[0, 0] for x, y in zip(q, c)], np.int64)


def head(q: np.ndarray, c: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1, from the first list alone: places of its ``k`` highest entries of each query, and their full scores."""
    a, z = _cuts(q.shape[1])[0]
    first = np.where(other, products(q[:, a:z], c[:, a:z]), LOWEST)
    near = np.zeros(other.shape, bool)
    np.put_along_axis(near, np.argpartition(-first, min(k, first.shape[1]) - 1, axis=1)[:, :k], True, axis=1)
    i, j = np.nonzero(near & other)
    return i, j, _pairs(q[i], c[j])


def reaching(q: np.ndarray, c: np.ndarray, other: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Phases 2 and 3: places and scores of all entries that reach their query's cutoff; then how many list entries were made, and how many
    entries collected.

    Where all lists of an entry are below cutoff / SLICES, their sum is below the cutoff, so it is not collected and never added up."""
    cuts = _cuts(q.shape[1])
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most >= 2**53:
        cuts = [(0, q.shape[1])]  # partial sums might pass what a long holds
    threshold = -(-cut // len(cuts))[:, None]
    at, lists, collected, made = np.arange(len(c)), [], np.zeros(other.shape, bool), 0
    for n, (a, z) in enumerate(cuts):
        part = q[:, a:z] @ c[at, a:z].T if most < 2**53 else products(q, c)
        collected |= part >= threshold
        lists.append(part)
        made += part.size
        if n == len(cuts) // 2 - 1:
            rest = np.sqrt((q[:, z:] ** 2).sum(1))[:, None] * (np.sqrt((c[:, z:] ** 2).sum(1)) * (1 + 1e-9))[None] + 1
            left = (sum(lists) + rest >= cut[:, None]).any(0)
            if not left.all():
                at, lists, collected = at[left], [x[:, left] for x in lists], collected[:, left]
    i, j = np.nonzero(collected & other[:, at])
    score = sum(x[i, j] for x in lists).astype(np.int64)
    reach = score >= cut[i]
    return i[reach], at[j[reach]], score[reach], made, len(i)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest integer inner products of floor(scale * x), ties to the smaller vec_id.

    Candidates: all rows of ``vectors`` but those with the query's own id. Rows whose id or vector is null or whose vector
    holds null or non-finite components (also after scaling) take no part; vectors of different lengths don't meet, empty
    ones score 0. Scores that a long can't hold count as 2**62 - 1. Repeated candidates are ranked each by itself; of
    repeated query ids each gets its ranks. Fewer than k candidates: all of them. Empty tables give an empty result;
    other columns play no part.
    """
    spark = vectors.sparkSession
    sent_rows = queries.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"))
    candidates = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    found, block = [], []

    def search(block: list[tuple[int, list]]) -> DataFrame:
        by_size: dict[int, list[int]] = {}
        for n, (_, v) in enumerate(block):
            by_size.setdefault(len(v), []).append(n)
        blocks = [(np.array(x, np.int64), np.array([block[n][0] for n in x], np.int64), np.array([block[n][1] for n in x], np.float64).reshape(len(x), size)) for size, x in by_size.items()]
        sent = spark.sparkContext.broadcast(blocks)

        def heads(batches):
            best = Best(k)
            for numbers, own, q, ids, c in _tiles(batches, scale, sent.value):
                i, j, scores = head(q, c, own[:, None] != ids[None], k)
                best.add(numbers[i], ids[j], scores)
            yield best.batch()

        order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        ranked = candidates.mapInArrow(trimmed(heads), "q long, vec_id long, score long").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
        cutoff = np.full(len(block), LOWEST)
        for q, score in ranked.where(F.col("r") == k).select("q", "score").collect():
            cutoff[q] = score
        safe = spark.sparkContext.broadcast(cutoff)

        def collected(batches):
            best = Best(k)
            for numbers, own, q, ids, c in _tiles(batches, scale, sent.value):
                i, j, scores, _, _ = reaching(q, c, own[:, None] != ids[None], safe.value[numbers])
                best.add(numbers[i], ids[j], scores)
            yield best.batch()

        ids = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], "q long, query_id long")
        rows = candidates.mapInArrow(trimmed(collected), "q long, vec_id long, score long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = written(rows.join(F.broadcast(ids), "q").select("query_id", "rank", "vec_id", "score"))
        # the next block takes the place of this one
        sent.unpersist()
        safe.unpersist()
        return out

    for i, v in sent_rows.toLocalIterator():
        if i is None or v is None or any(x is None for x in v):
            continue
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(np.array(v, np.float64) * scale)
        if not np.isfinite(x).all():
            continue
        block.append((i, x))
        if len(block) == BLOCK:
            found.append(search(block))
            block = []
    if block or not found:
        found.append(search(block))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: rows of ``embeddings`` whose id is divisible by 50, against all its rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

QUERIES = {"op9_top_k": op9_top_k}
ORACLES = {"op9_top_k": ORACLE}
