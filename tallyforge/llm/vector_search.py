"""Approximate nearest neighbours by a forest of hash-prefix trees, in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Neighbours; trees; bits of a tree's hash string; seed of the directions.
NEAREST, TREES, BITS, SEED = 20, 256, 24, 11
#: Candidates of a query: this many times the power POWER of the number of rows, over all blocks together. Chosen so
#: that of vectors that point anywhere, the hardest case, 0.9 of the nearest 20 are found at any number of rows.
TIMES, POWER = 1.9, 0.8
#: Rows of a block of candidates and of queries; every block of queries meets every block of candidates in one task.
BLOCK, QUERY_BLOCK = 8192, 4096
QUERY_EVERY = 20


class Forest:
    """Per tree the rows of a block sorted by hash string: the signs of the vectors' products with random directions.

    In a sorted array, rows that share a prefix with a query lie side by side, so a tree needs no nodes: descending to
    the longest match is a binary search, ascending a level widens the range.
    """

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.trees, self.bits, self.n = trees, bits, len(vectors)
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1], trees * bits)).astype(np.float32)
        codes = self._codes(vectors)
        order = np.argsort(codes, axis=1, kind="stable")
        self.order, self.sorted = order.astype(np.int32).ravel(), np.take_along_axis(codes, order, 1)

    def _codes(self, vectors: np.ndarray) -> np.ndarray:
        """(trees, vectors): hash strings as numbers. Only a vector's direction counts."""
        scaled = (vectors / np.abs(vectors).max(axis=1, keepdims=True)).astype(np.float32)
        powers = np.int32(1) << np.arange(self.bits - 1, -1, -1, dtype=np.int32)
        out = np.empty((self.trees, len(vectors)), np.int32)
        for t in range(self.trees):
            out[t] = (scaled @ self.directions[:, t * self.bits : (t + 1) * self.bits] > 0) @ powers
        return out

    def ranges(self, codes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(trees, queries): places of each tree's array that share the first ``level`` bits with each query."""
        drop = self.bits - level
        low, high = np.empty(codes.shape, np.int64), np.empty(codes.shape, np.int64)
        for t, c in enumerate(codes):
            prefix = c >> drop
            low[t] = np.searchsorted(self.sorted[t], prefix << drop)
            high[t] = np.searchsorted(self.sorted[t], ((prefix + 1) << drop) - 1, "right")
        return low, high

    def candidates(self, queries: np.ndarray, wanted: int) -> Iterator[tuple[int, np.ndarray]]:
        """(query, its rows): at least ``wanted`` rows, or all, from the longest common prefixes on.

        All trees ascend together, a level a round; a round holds the queries that still lack candidates. On its last level a
        query takes tree after tree and stops at the wanted number.
        """
        wanted = max(1, min(wanted, self.n))
        codes, left = self._codes(queries), np.arange(len(queries))
        base = (np.arange(self.trees) * self.n)[:, None]
        level = min(self.bits, max(0, int(math.log2(self.trees * self.n / wanted)) + 2))
        below = np.zeros((2, self.trees, len(queries)), np.int64)
        while len(left):
            low, high = self.ranges(codes[:, left], level)
            enough = np.zeros(len(left), bool)
            for i in np.flatnonzero((high - low).sum(0) >= wanted).tolist():
                starts = np.concatenate([below[0, :, i], low[:, i]])
                many = np.concatenate([below[1, :, i] - below[0, :, i], high[:, i] - low[:, i]])
                at = np.repeat(starts + np.tile(base[:, 0], 2) - (np.cumsum(many) - many), many) + np.arange(many.sum())
                found, first = np.unique(self.order[at], return_index=True)
                if len(found) >= wanted or not level:
                    enough[i] = True
                    yield int(left[i]), found[first <= np.partition(first, wanted - 1)[wanted - 1]] if len(found) > wanted else found
            left = left[~enough]
            below = np.stack([low[:, ~enough], high[:, ~enough]])
            level -= 1


def exact_scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components."""
    out = np.zeros(len(rows))
    for i in range(rows.shape[1]):
        out = out + query[i] * rows[:, i]
    return out


def wanted_of(rows: int, nearest: int) -> float:
    """The share of all rows that are a query's candidates, at least."""
    return min(1.0, max(TIMES * rows**POWER, 4 * nearest) / max(rows, 1))


def _nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, share: float, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> pd.DataFrame:
    forest = Forest(rows, trees, bits, seed)
    longest = np.sqrt((rows**2).sum(axis=1)).max()
    out = []
    for q, found in forest.candidates(queries, math.ceil(share * len(rows))):
        found = found[ids[found] != query_ids[q]]
        if len(found) > 2 * k:  # sums in another order, only to leave out what is below the k-th by more than they err
            near = rows[found] @ queries[q]
            least = np.partition(near, len(near) - k)[len(near) - k]
            found = found[~(near < least - 1e-12 * longest * np.sqrt((queries[q] ** 2).sum()))]
        score = exact_scores(queries[q], rows[found])
        best = np.lexsort((ids[found], -score))[:k]
        out.append(pd.DataFrame({"query_id": query_ids[q], "vec_id": ids[found][best], "score": score[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of rows that take part: no null, not zero, all components finite, and a vec_id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = QUERY_EVERY, trees: int = TREES, bits: int = BITS, share: float | None = None, block: int = BLOCK, query_block: int = QUERY_BLOCK, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by inner product, ties to the smaller vec_id.

    Queries are the rows whose vec_id ``every`` divides, candidates all rows but those of the query's own vec_id. Rows
    are dealt by hash into blocks of about ``block`` rows, queries into blocks of ``query_block``; a task holds one of
    each, and each pair of blocks is a task of its own, so neither grows with the data. Each block of candidates is
    searched with a forest of its own for a ``share`` of its rows (by default as wanted_of() gives it for the whole table,
    so that the share falls as tables grow), and the best k of all blocks count. Null, zero and non-finite vectors take no
    part; vectors of another length than most are compared with their like only. Of repeated vec_ids each row counts.
    """
    rows = usable(vectors).withColumn("size", F.size("v"))
    n = max(1, rows.count())
    part = wanted_of(n, k) if share is None else share
    blocks, query_blocks = -(-n // block), -(-n // (every * query_block))
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    left = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.withColumn("cb", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        out = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if a.num_rows and b.num_rows:
            order_a, order_b = a.sort_by("vec_id"), b.sort_by("vec_id")
            x, y = (np.stack(t["v"].to_numpy()).astype(float) for t in (order_a, order_b))
            out = _nearest(x, order_a["vec_id"].to_numpy(), y, order_b["vec_id"].to_numpy(), k, part, trees, bits, seed)
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    keys = ["cb", "qb", "size"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast(T.IntegerType())).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
