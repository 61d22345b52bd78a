import math
from pathlib import Path

import numpy as np
import pytest

from lodestar.llm import neighbours, registry, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, score double, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0.0, 0) for i, v in rows], SCHEMA)


ODD = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [0.0, 0.0]), (8, []), (None, [1.0, 1.0]), (9, [1.0]), (9, [1.0]), (10, [-1.0, 0.25])]


def found(df):
    return [(r.query_id, r.rank, r.vec_id, r.score) for r in df.orderBy("query_id", "rank").collect()]


def test_nearest_of_odd_rows(spark):
    rows = frame(spark, ODD)
    got = found(neighbours.nearest(rows, rows.where("vec_id in (0, 3, 7)"), 4))
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 9), (0, 3, 9), (0, 4, 2)]
    assert got[0][3] == got[1][3] == got[2][3] == 1.0 and math.isclose(got[3][3], math.sqrt(0.5))
    assert found(neighbours.nearest(rows.limit(0), rows, 3)) == [] == found(neighbours.nearest(rows, rows.limit(0), 3))


def test_top_k_of_odd_rows(spark):
    rows = frame(spark, ODD)
    got = found(topk.top_k(rows, rows.where("vec_id in (0, 3, 7)"), 9))
    assert [x for x in got if x[0] == 0] == [(0, 1, 1, 65536), (0, 2, 9, 65536), (0, 3, 9, 65536), (0, 4, 2, 32768), (0, 5, 7, 0), (0, 6, 10, -65536)]
    assert [x[3] for x in got if x[0] == 7] == [0] * 6 and [x[2] for x in got if x[0] == 7] == [0, 1, 2, 9, 9, 10]
    assert found(topk.top_k(rows.limit(0), rows, 3)) == []


def test_rows_that_share_an_id(spark):
    """Each is a candidate; as queries they share their k."""
    rows = frame(spark, [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.5]), (2, [0.0, 3.0]), (2, [2.0, 0.0]), (3, [-1.0, -1.0])])
    got = found(topk.top_k(rows, rows.where("vec_id = 0"), 4))
    assert got == [(0, 1, 2, 768 * 256), (0, 2, 2, 512 * 256), (0, 3, 1, 65536), (0, 4, 1, 32768)]
    near = found(neighbours.nearest(rows, rows.where("vec_id = 0"), 3))
    assert [(r, v) for _, r, v, _ in near] == [(1, 2), (2, 2), (3, 1)] and near[0][3] == near[1][3] == 1.0


def test_squares_that_overflow(spark):
    rows = spark.createDataFrame([(0, [1e200, 1e200]), (1, [1e300, 1e300]), (2, [1e-300, 0.0]), (3, [5e-324, 5e-324])], "vec_id long, embedding array<double>")
    got = found(neighbours.nearest(rows, rows.where("vec_id = 0"), 3))
    assert [v for _, _, v, _ in got] == [1, 3, 2] and math.isclose(got[0][3], 1.0) and math.isclose(got[1][3], 1.0) and math.isclose(got[2][3], math.sqrt(0.5))


def test_top_k_beyond_doubles(spark):
    rows = frame(spark, [(1, [1e6, 1.0]), (2, [1e6, 2.0]), (3, [3e38, 0.0])])
    got = found(topk.top_k(rows, rows.where("vec_id = 1"), 5))
    big = 256 * int(np.float32(1e6))
    assert got == [(1, 1, 3, topk.LONGEST), (1, 2, 2, big * big + 512 * 256)]


def test_pruning_skips_blocks_and_stays_exact():
    rng = np.random.default_rng(0)
    rows = topk.whole(np.sort(rng.standard_normal((2000, 8)) * np.geomspace(1, 0.01, 2000)[:, None], axis=1))
    blocks = topk.Blocks.of(np.arange(2000), rows)
    skipped = 0
    for q in range(0, 2000, 50):
        bounds = blocks.bounds(rows[q][None])[0]
        ids, scores, seen = blocks.top(q, rows[q], bounds, 5)
        every = rows @ rows[q]
        every[q] = -np.inf
        right = np.lexsort((np.arange(2000), -every))[:5]
        assert ids.tolist() == right.tolist() and scores.tolist() == every[right].tolist()
        skipped += len(bounds) - seen
    assert skipped > 0


def test_forest_meets_longest_prefixes_first():
    rng = np.random.default_rng(1)
    rows = rng.standard_normal((500, 16))
    forest = neighbours.Forest.of(rows, trees=4)
    own = forest.strings(rows[:20])
    for q, met in enumerate(forest.candidates(rows[:20], 60)):
        assert q in met
        strings = forest.strings(rows)
        shared = np.array([[neighbours.BITS - int(a ^ b).bit_length() for a, b in zip(strings[t], [own[t, q]] * 500, strict=True)] for t in range(4)])
        counts = [(shared >= d).sum() for d in range(neighbours.BITS + 1)]
        depth = max(d for d in range(neighbours.BITS + 1) if counts[d] >= 60)
        assert sorted(met) == np.flatnonzero((shared >= depth).any(axis=0)).tolist()


@pytest.mark.parametrize("shards", [4096, 100])
def test_recall_and_scores(spark, sf, monkeypatch, shards):
    monkeypatch.setattr(vectors, "SHARD_ROWS", shards)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.array(rows.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert recall(x, found(registry.op1_nearest(spark, sf))) >= 0.9


def recall(x, got):
    """The share of each fiftieth row's five nearest that were found; all found have their own cosine."""
    hit = total = 0
    for q in range(0, len(x), 50):
        every = x @ x[q]
        every[q] = -9
        best = set(np.argsort(-every)[:5].tolist())
        mine = [g for g in got if g[0] == q]
        assert [g[1] for g in mine] == [1, 2, 3, 4, 5] and all(math.isclose(g[3], every[g[2]], abs_tol=1e-12) for g in mine)
        hit, total = hit + len(best & {g[2] for g in mine}), total + 5
    return hit / total


def test_recall_where_a_forest_meets_a_part_of_the_rows(spark, sf):
    """On 2,000 vectors a query meets about half of the rows, far from all of them."""
    folder = Path(sf).parent / "sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.array(rows.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert recall(x, found(registry.op1_nearest(spark, str(folder)))) >= 0.9
    forest = neighbours.Forest.of(x)
    met = [len(m) for m in forest.candidates(x[::50], max(neighbours.LEAST_ENTRIES, len(x) // 2))]
    assert np.mean(met) < 0.6 * len(x)


def test_exact_top_k_of_the_table(spark, sf, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 100)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 4)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(256 * np.array(rows.embedding.tolist(), float)).astype(np.int64)
    expected = []
    for q in range(0, len(x), 50):
        every = x @ x[q]
        order = [int(i) for i in np.lexsort((np.arange(len(x)), -every)) if i != q][:5]
        expected += [(q, r, i, int(every[i])) for r, i in enumerate(order, 1)]
    assert found(registry.op4_top_k(spark, sf)) == expected
