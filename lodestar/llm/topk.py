"""Exact top-k by inner product with block-at-a-time pruning.

A shard's rows lie in blocks of consecutive ids.  For each block and term
(component) the largest and smallest weight is known; a query's weights times
these, summed over its terms, bound every score in the block.  A query visits
the blocks in the order of their bounds, scores a block's rows through the
block's own forward index, and ends once the next bound is below its kth score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from lodestar.llm import vectors

#: Rows of a block, and blocks that a query scores between two looks at its kth score.
BLOCK_ROWS, STEP = 32, 8
#: Queries whose bounds are held at once.
BOUNDED = 256
#: Scores below this are exact in doubles; beyond, whole numbers of any length are used and scores end at plus or minus the largest long.
EXACT = 1 << 53
LONGEST = (1 << 63) - 1


def extremes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest and the smallest weight of each block and term."""
    starts = np.arange(0, len(rows), BLOCK_ROWS)
    return np.maximum.reduceat(rows, starts, axis=0), np.minimum.reduceat(rows, starts, axis=0)


class Blocks:
    """Forward index of whole-number rows in id order, with each block's extreme weights."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, most: np.ndarray, least: np.ndarray):
        self.ids, self.rows, self.most, self.least = ids, rows, most, least

    @classmethod
    def of(cls, ids: np.ndarray, rows: np.ndarray) -> Blocks:
        return cls(ids, rows, *extremes(rows))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return np.maximum(queries, 0) @ self.most.T + np.minimum(queries, 0) @ self.least.T

    def top(self, own: int, query: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the best k rows but own, and how many blocks were scored."""
        order = np.argsort(-bounds, kind="stable")
        ids, scores, seen = np.zeros(0, np.int64), np.zeros(0), 0
        for at in range(0, len(order), STEP):
            if len(ids) == k and bounds[order[at]] < scores[-1]:
                break
            near = order[at : at + STEP]
            near = near[bounds[near] >= scores[-1]] if len(ids) == k else near
            places = (near[:, None] * BLOCK_ROWS + np.arange(BLOCK_ROWS)).ravel()
            places = places[places < len(self.ids)]
            places = places[self.ids[places] != own]
            ids, scores = np.concatenate([ids, self.ids[places]]), np.concatenate([scores, self.rows[places] @ query])
            keep = vectors.best(ids, scores, k)
            ids, scores, seen = ids[keep], scores[keep], seen + len(near)
        return ids, scores, seen


def whole(rows: np.ndarray) -> np.ndarray:
    """floor(256 * x) of each component, as doubles that hold whole numbers."""
    return np.floor(256.0 * rows)


def _by_long_numbers(ids: np.ndarray, rows: np.ndarray, own: int, query: np.ndarray, k: int) -> tuple[list, list]:
    """For components so large that doubles can't hold the scores: Python's whole numbers, every row."""
    weights = [int(v) for v in query]
    found = sorted((-min(max(sum(int(a) * b for a, b in zip(r, weights, strict=True)), -LONGEST), LONGEST), int(i)) for i, r in zip(ids, rows, strict=True) if i != own)[:k]
    return [i for _, i in found], [-s for s, _ in found]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score long): for each query id exactly the k rows of largest inner product of floor(256 * x).

    Ties go to the smaller id; rows of the query's own id are no candidates.  Ids
    and vectors that are null, vectors that are empty or hold null or non-finite
    components take no part; vectors of different lengths are compared as if
    the shorter ended in zeros; rows that share an id are candidates each, and as
    queries they share their k.  With fewer than k candidates all are returned, and
    empty tables give an empty one.
    """

    def prepare(x: np.ndarray) -> vectors.Arrays:
        with np.errstate(over="ignore"):
            most, least = extremes(whole(x))
        return {"most": most, "least": least}

    def ask(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, shard: vectors.Arrays):
        x, wide = shard["vectors"], q.shape[1]
        with np.errstate(over="ignore"):
            asked, held = whole(q), whole(x)
            safe = float(np.abs(asked).max(initial=0)) * float(np.abs(held).max(initial=0)) * wide < EXACT
        if safe:
            blocks = Blocks(ids, held, shard["most"].reshape(-1, wide), shard["least"].reshape(-1, wide))
            for at in range(0, len(asked), BOUNDED):
                for i, bounds in enumerate(blocks.bounds(asked[at : at + BOUNDED]), at):
                    top_ids, scores, _ = blocks.top(query_ids[i], asked[i], bounds, k)
                    yield top_ids, scores.astype(np.int64)
        else:
            exact = lambda m: [[(lambda a, b: 256 * a // b)(*float(v).as_integer_ratio()) for v in r] for r in m]
            xs, qs = exact(x), exact(q)
            for i in range(len(query_ids)):
                top_ids, scores = _by_long_numbers(ids, xs, query_ids[i], qs[i], k)
                yield np.array(top_ids, np.int64), np.array(scores, np.int64)

    return vectors.search(vectors.valid(rows, vec_id, vector), vectors.valid(queries, vec_id, vector), k, "long", prepare, ask)
