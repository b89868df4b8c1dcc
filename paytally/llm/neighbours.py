"""Approximate nearest neighbours by inner product: a hash-prefix forest.

Each tree gives a vector a string of sign bits of random projections and keeps the strings sorted.
A query descends in every tree to the longest prefix of its string whose rows, summed over the trees, could be
``candidates``; then all trees ascend together, one bit at a time, until the distinct vectors that share the prefix in
any tree are that many. Those are compared by the exact inner product in double precision. Equal vectors of
a block are indexed once, with the list of their ids, so copies fill no query's candidates. Vectors of unequal norms
get one more component that makes all norms equal, so that the largest product is the nearest angle.

Scale: vectors are dealt to blocks of about ``block_rows`` by hash, and queries to blocks of
``query_rows``; a task holds one block of each, builds the block's forest and returns the best
``k`` per query. Every row is indexed, every query meets every block; memory per task is fixed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEED = 20
BITS = 32
TREES = 100
SHARE = 0.6


class Forest:
    """Sorted hash strings of one block's vectors in every tree."""

    def __init__(self, vectors: np.ndarray, trees: int, longest: float):
        self.vectors = vectors
        self.trees = trees
        self.planes = np.random.default_rng(SEED).standard_normal((vectors.shape[1] + 1, trees * BITS))
        rest = np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", vectors, vectors), 0.0))
        strings = self._strings(np.column_stack([vectors, rest]))
        self.order = np.argsort(strings, axis=0, kind="stable").T.astype(np.intp)
        self.sorted = np.ascontiguousarray(np.sort(strings, axis=0).T)

    def _strings(self, lifted: np.ndarray) -> np.ndarray:
        out = np.empty((len(lifted), self.trees), np.uint32)
        for start in range(0, len(lifted), 1024):
            signs = (lifted[start : start + 1024] @ self.planes > 0).reshape(-1, self.trees, BITS)
            out[start : start + 1024] = np.packbits(signs, axis=2).view(">u4")[:, :, 0]
        return out

    def bounds(self, strings: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each string and tree, the rows [low, high) of the sorted strings with its prefix of ``depth`` bits.

        ``depth`` holds one number a string, 1 at least.
        """
        rest = ((np.uint64(1) << (BITS - depth).astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
        first, last = strings & ~rest, strings | rest
        low, high = np.empty(first.shape, np.int64), np.empty(first.shape, np.int64)
        for t in range(self.trees):
            low[:, t] = np.searchsorted(self.sorted[t], first[:, t], "left")
            high[:, t] = np.searchsorted(self.sorted[t], last[:, t], "right")
        return low, high

    def descend(self, strings: np.ndarray, candidates: int) -> np.ndarray:
        """For each string the longest prefix whose ranges, summed over the trees, hold ``candidates`` rows; 0 if none.

        Ranges only shrink as prefixes grow, so the length is found by halving.
        """
        fits, fails = np.zeros(len(strings), np.int64), np.full(len(strings), BITS + 1)
        while (open_ := np.flatnonzero(fails - fits > 1)).size:
            middle = (fits[open_] + fails[open_]) // 2
            low, high = self.bounds(strings[open_], middle)
            enough = (high - low).sum(axis=1) >= candidates
            fits[open_[enough]] = middle[enough]
            fails[open_[~enough]] = middle[~enough]
        return fits

    def search(self, queries: np.ndarray, candidates: int):
        """Yields the place of each query, its candidate rows and their inner products, in no set order."""
        size = len(self.vectors)
        for start in range(0, len(queries), 256):
            part = queries[start : start + 256]
            strings = self._strings(np.column_stack([part, np.zeros(len(part))]))
            # A row met in several trees counts once, so no longer prefix than this can do.
            depth = self.descend(strings, candidates)
            rising = np.arange(len(part))
            while len(rising):
                left = []
                deep = rising[depth[rising] > 0]
                low, high = self.bounds(strings[deep], depth[deep])
                ranges = dict(zip(deep.tolist(), zip(low.tolist(), high.tolist())))
                for query in rising.tolist():
                    if query in ranges:
                        met = np.zeros(size, bool)
                        met[np.concatenate([order[a:b] for order, a, b in zip(self.order, *ranges[query])])] = True
                        rows = np.flatnonzero(met)
                        if len(rows) < candidates:
                            left.append(query)
                            continue
                    else:
                        rows = np.arange(size)
                    yield start + query, rows, self.vectors.take(rows, axis=0) @ part[query]
                rising = np.array(left, np.int64)
                depth[rising] -= 1


def distinct_vectors(vectors: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct rows of ``vectors``, and for each the ascending names of the rows equal to it."""
    vectors = np.ascontiguousarray(vectors) + 0.0  # one zero
    whole = vectors.view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel()
    _, first, group = np.unique(whole, return_index=True, return_inverse=True)
    order = np.lexsort((names, group))
    return vectors[first], np.split(names[order], np.flatnonzero(np.diff(group[order])) + 1)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, dim): vectors with an id, finite, and not zero, as doubles, and their lengths."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))
    return rows.withColumn("dim", F.size("v"))


def nearest(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
    share: float = SHARE,
    block_rows: int = 4096,
    query_rows: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for rows whose id is divisible by ``every``.

    A query ascends until a block's trees have met ``share`` of its distinct vectors, more than ``k``
    at least. Ties go to the smaller id. Vectors that are null, zero, or hold null or non-finite
    components take no part, nor does a null id. Vectors of another length have no inner product with the query's and are
    searched apart. An id that repeats is one query, with its smallest vector, and is never its own neighbour; as a candidate
    each of its rows counts. With fewer than ``k`` candidates all are returned; an empty table gives no rows.
    """
    rows = usable(vectors, id_col, vector_col)
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = queries.withColumn("dim", F.size("v"))
    in_blocks = lambda n, size: F.ceil(n / F.lit(size)).cast("int")
    # One row a vector length.
    sizes = rows.groupBy("dim").agg(
        in_blocks(F.count("*"), block_rows).alias("blocks"), F.sqrt(F.max(squares)).alias("longest")
    )
    asked_sizes = queries.groupBy("dim").agg(in_blocks(F.count("*"), query_rows).alias("parts"))
    sizes = sizes.join(asked_sizes, "dim")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt_to = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    dealt = rows.join(sizes, "dim").select(
        "dim", "vec_id", "v", "longest", dealt_to("blocks").alias("block"), each("parts").alias("part")
    )
    asked = queries.join(sizes, "dim").select(
        "dim", F.col("vec_id").alias("query_id"), "v", dealt_to("parts").alias("part"), each("blocks").alias("block")
    )

    def search(data: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if data.empty or wanted.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        vectors = np.stack(data["v"].to_numpy()).astype(np.float64)
        vectors, names = distinct_vectors(vectors, data["vec_id"].to_numpy())
        forest = Forest(vectors, trees, float(data["longest"].iloc[0]))
        candidates = max(k + 1, math.ceil(share * len(names)))
        found = []
        query_names = wanted["query_id"].to_numpy()
        asked_vectors = np.stack(wanted["v"].to_numpy()).astype(np.float64)
        for place, at, score in forest.search(asked_vectors, candidates):
            name = query_names[place]
            if len(at) > k + 1:  # one may be the query's own; keep all that tie with the last
                kept = score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                at, score = at[kept], score[kept]
            others = [names[i][names[i] != name][:k] for i in at.tolist()]
            score, others = np.repeat(score, [len(o) for o in others]), np.concatenate(others)
            best = np.lexsort((others, -score))[:k]
            found.append((np.full(len(best), name), others[best], score[best]))
        query, row, score = (np.concatenate(c) for c in zip(*found))
        return pd.DataFrame({"query_id": query, "vec_id": row, "score": score})

    key = ["dim", "part", "block"]
    pairs = dealt.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(
        search, "query_id long, vec_id long, score double"
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
