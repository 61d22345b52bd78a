"""Approximate nearest neighbours with a hash-prefix forest.

Each tree hashes a vector to a long bit string, one bit for each random
hyperplane, and keeps the strings as a sorted array.  Vectors that share a
prefix with a query lie side by side there, so that a prefix of any length is
two binary searches.  A query descends to its longest matches in all trees and then
ascends in all of them at the same time, prefix by prefix, until it has met enough
entries; these are scored exactly.

Vectors without clusters are the hard case: to find nine in ten of the true
neighbours there, a forest has to meet a good part of a shard whatever its
parameters.  share sets that part; clustered vectors do with far less.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from lodestar.llm import vectors

#: Trees of a forest and bits of a string.
TREES, BITS = 48, 32
#: Entries that a query meets in a shard at least, however few its rows.
LEAST_ENTRIES = 1024


@lru_cache(maxsize=4)
def planes(width: int, trees: int, seed: int) -> np.ndarray:
    """Normals of the trees' hyperplanes; each run of width of them is orthogonal, which lowers the variance of the angle."""
    rng = np.random.default_rng(seed)
    need = trees * BITS
    turns = [np.linalg.qr(rng.standard_normal((width, width)))[0] for _ in range(-(-need // width))]
    return np.concatenate(turns)[:need]


class Forest:
    """Sorted arrays of bit strings, one for each tree, over the rows of unit vectors."""

    def __init__(self, strings: np.ndarray, order: np.ndarray, seed: int = 1):
        self.sorted, self.order, self.trees, self.seed = strings, order, len(strings), seed

    @classmethod
    def of(cls, units: np.ndarray, trees: int = TREES, seed: int = 1) -> Forest:
        out = cls(np.zeros((trees, 0), np.uint64), np.zeros((trees, 0), np.int64), seed)
        hashed = out.strings(units)
        out.order = np.argsort(hashed, axis=1, kind="stable")
        out.sorted = np.take_along_axis(hashed, out.order, axis=1)
        return out

    def strings(self, units: np.ndarray) -> np.ndarray:
        """(trees, rows): each row's string as an integer whose highest bit comes first."""
        out = np.empty((self.trees, len(units)), np.uint64)
        normals = planes(units.shape[1], self.trees, self.seed)
        for t in range(self.trees):
            bits = units @ normals[t * BITS : (t + 1) * BITS].T > 0
            out[t] = bits @ (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))
        return out

    def ranges(self, strings: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query, the stretch of the sorted array that shares depth bits with the query's string."""
        free = (np.uint64(1) << (BITS - depth).astype(np.uint64)) - np.uint64(1)
        low, high = strings & ~free, strings | free
        return np.stack([np.searchsorted(s, x) for s, x in zip(self.sorted, low, strict=True)]), np.stack([np.searchsorted(s, x, "right") for s, x in zip(self.sorted, high, strict=True)])

    def candidates(self, units: np.ndarray, enough: int):
        """For each query, the places of the rows that it meets on the way up until they are enough entries (or all)."""
        strings = self.strings(units)
        least, most = np.zeros(len(units), np.int64), np.full(len(units), BITS)
        while (least < most).any():  # counts grow on the way up: halve between the root, which has all, and the longest prefix
            depth = (least + most + 1) // 2
            low, high = self.ranges(strings, depth)
            full = (high - low).sum(axis=0) >= enough
            least, most = np.where(full, depth, least), np.where(full, most, depth - 1)
        low, high = self.ranges(strings, least)
        for q in range(len(units)):
            met = np.zeros(self.order.shape[1], bool)
            for t in range(self.trees):
                met[self.order[t, low[t, q] : high[t, q]]] = True
            yield np.flatnonzero(met)


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row in the same order of additions, so that equal rows get equal values."""
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two, so that no square over- or underflows and nothing is rounded: cosines stay as they are."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, share: float = 0.5, trees: int = TREES, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query id the k rows of largest cosine that the forest finds, ties to the smaller id.

    share is how many entries of its trees a query meets in each shard, as a
    part of the shard's rows, LEAST_ENTRIES at least.  Rows of the query's own id are
    no candidates.  Ids and vectors that are null, vectors that are empty, zero or
    hold null or non-finite components take no part; vectors of different lengths
    are compared as if the shorter ended in zeros; rows that share an id are
    candidates each, and as queries they share their k.  With fewer than k
    candidates all are returned, and empty tables give an empty one.
    """

    def prepare(x: np.ndarray) -> vectors.Arrays:
        forest = Forest.of(scaled(x), trees)
        return {"strings": forest.sorted.astype(np.uint32), "order": forest.order.astype(np.uint32)}

    def ask(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, shard: vectors.Arrays):
        q, x = scaled(q), scaled(shard["vectors"])
        forest = Forest(shard["strings"].reshape(trees, -1).astype(np.uint64), shard["order"].reshape(trees, -1))
        for i, met in enumerate(forest.candidates(q, max(LEAST_ENTRIES, int(share * len(ids))))):
            met = met[ids[met] != query_ids[i]]
            scores = cosines(x[met], q[i])
            top = vectors.best(ids[met], scores, k)
            yield ids[met][top], scores[top]

    usable = lambda df: vectors.valid(df, vec_id, vector).where("exists(vector, e -> e <> 0)")
    return vectors.search(usable(rows), usable(queries), k, "double", prepare, ask)
