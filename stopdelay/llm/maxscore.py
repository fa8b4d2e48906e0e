"""Exact top-k search by MaxScore.

Vectors of whole numbers are read as documents of terms: a component's place and sign is a term, its size the weight.
Against a query, terms of the query's own sign add to the score and the others only take from it. In each shard the
adding terms are ordered by their bounds (query weight x largest weight in the shard): those whose bounds together stay
below the k-th best score so far are non-essential. The postings of the essential terms are traversed, what they touch
is probed in the other terms for as long as it can still get in, and the shards' best are merged.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import table

#: Rows of a shard and queries of a block, on average; a cell holds one of each.
SHARD_ROWS, BLOCK_QUERIES = 16_384, 16_384
#: Components and sums of products of up to this size are held in 64 bits; larger ones are Python's whole numbers.
LARGEST = 1 << 61


def matrix(column: pa.Array) -> np.ndarray:
    """floor(1024 x) as rows, of Python's whole numbers if any is larger than LARGEST; shorter vectors end with zeros."""
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy()[: offsets[-1]]
    if np.abs(flat[offsets[0] :]).max(initial=0) > LARGEST / 1024:
        # from 2^53 on a float is whole, and its product with 1024 may be none
        flat = np.array([int(x) * 1024 if abs(x) >= 1 << 53 else math.floor(x * 1024.0) for x in flat.tolist()], object)
    else:
        flat = np.floor(flat * 1024.0).astype(np.int64)
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), flat.dtype)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], lengths)] = flat[offsets[0] :]
    return out


class Shard:
    """The postings of one shard's vectors, in the order of their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.columns = ids[order], np.ascontiguousarray(vectors[order].T)
        self.rows = np.ascontiguousarray(self.columns.T)
        self.postings = {}
        self.most = [int(x) for x in np.abs(self.rows).max(axis=0, initial=0)]
        for d, x in enumerate(self.columns):
            for sign in (1, -1):
                at = np.flatnonzero(x * sign > 0)
                self.postings[d, sign] = (at, np.abs(x[at]), int(np.abs(x[at]).max(initial=0)))

    def best(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but those with the id `own`, ties to smaller ids."""
        n = len(self.ids)
        query = query[: len(self.columns)]
        sizes = [abs(int(q)) for q in query]
        if self.rows.dtype == object or max(sizes, default=0) > LARGEST or sum(q * x for q, x in zip(sizes, self.most)) > LARGEST:
            return self._exact(own, query, k)
        query = query.astype(np.int64)
        # a first threshold from some rows' whole scores
        some = np.arange(0, n, max(1, n // (32 * k)))
        first = self.rows[some][:, : len(query)] @ query
        first = first[self.ids[some] != own]
        threshold = int(np.partition(first, len(first) - k)[len(first) - k]) if len(first) >= k else None
        terms = sorted((abs(int(q)) * self.postings[d, 1 if q > 0 else -1][2], d) for d, q in enumerate(query) if q)
        bounds = np.cumsum([b for b, _ in terms]) if terms else np.zeros(0, np.int64)
        cut = int(np.searchsorted(bounds, threshold, side="left")) if threshold is not None else 0
        rest, essential = [d for _, d in terms[:cut]], [d for _, d in terms[cut:]]
        left = int(bounds[cut - 1]) if cut else 0
        score = np.zeros(n, np.int64)
        for d in essential:
            at, weight, _ = self.postings[d, 1 if query[d] > 0 else -1]
            score[at] += weight * abs(int(query[d]))
        if threshold is not None and threshold > 0:
            found = np.flatnonzero((score > 0) & (score + left >= threshold))  # untouched rows score `left` at most, which is less
        else:
            found = np.arange(n)
        found = found[self.ids[found] != own]
        score = score[found]
        sure = set(essential)
        # probe, heavy terms first: essential ones for what they take, the others for all they give or take
        bound_of = {d: b for b, d in terms}
        for step, d in enumerate(sorted((d for _, d in terms), key=lambda d: -abs(int(query[d])))):
            part = self.columns[d][found] * query[d]
            if d in sure:
                np.minimum(part, 0, out=part)
            else:
                left -= bound_of[d]
            score = score + part
            if threshold is not None and step % 4 == 3:
                on = score + left >= threshold
                found, score = found[on], score[on]
        top = np.lexsort((self.ids[found], -score))[:k]
        return self.ids[found[top]], score[top]


    def _exact(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same from whole scores of all rows, where these may not fit in 64 bits."""
        found = np.flatnonzero(self.ids != own)
        score = self.rows[found][:, : len(query)].astype(object) @ query.astype(object)
        top = heapq.nsmallest(k, range(len(found)), key=lambda i: (-score[i], self.ids[found[i]]))
        return self.ids[found[top]], score[top]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k best among all vectors whose id isn't its own.

    Scores are inner products of floor(1024 x), exact for components of any size; one among the best that doesn't fit in
    64 bits fails, as it does in SQL. Ties go to smaller ids; where vectors differ in length the longer one's
    end counts as 0. Rows without an id, and vectors that are null or hold null or non-finite components, take no part.
    Rows that repeat an id are candidates each; a query id that repeats gets the best of all its rows, each candidate row's
    id and score once. Vectors are dealt by row into shards, queries into blocks, and each pair of a shard and a block is
    one bounded group; other columns are not read.
    """
    fine = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(vec_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    v = vectors.where(fine).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    q = queries.where(fine).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).distinct()
    shards, blocks = max(1, -(-v.count() // SHARD_ROWS)), max(1, -(-q.count() // BLOCK_QUERIES))
    row = F.xxhash64("id", F.monotonically_increasing_id())
    v = v.withColumn("s", F.pmod(row, F.lit(shards))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    q = q.withColumn("b", F.pmod(F.xxhash64("id", "v"), F.lit(blocks))).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            x, y = left.combine_chunks(), right.combine_chunks()
            vec = lambda t: matrix(t.column("v").combine_chunks() if t.column("v").num_chunks != 1 else t.column("v").chunk(0))
            shard = Shard(x.column("id").to_numpy(), vec(x))
            found = [(np.full(len(ids), own), ids, scores) for own, z in zip(y.column("id").to_numpy(), vec(y)) for ids, scores in [shard.best(own, z, k)]]
            out = [np.concatenate(c) for c in zip(*found)]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    best = v.groupBy("s", "b").cogroup(q.groupBy("s", "b")).applyInArrow(cell, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
