import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestar.operators import fusion, ranking, similarity
from lodestar.schemas import RANKED, SCORES

MODELS = ("siglip2", "clip")


def long_scores(spark, by_model):
    """{model: {file: [score of q0001, ...]}} -> long scores."""
    rows = [(m, f"q{j + 1:04d}", f, float(s)) for m, files in by_model.items() for f, line in files.items() for j, s in enumerate(line)]
    return spark.createDataFrame(rows, SCORES)


def by_query(ranked):
    out = {}
    for r in ranked.orderBy("query_id", "rank").collect():
        out.setdefault((r.model_id, r.query_id), []).append(r.file_id)
    return out


@pytest.mark.parametrize(
    "files, k, expected",
    [
        ({0: [0.99, 0.10], 1: [0.98, 0.20], 2: [0.97, 0.90], 3: [0.96, 0.80]}, 2, [[0, 1], [2, 3]]),
        ({i: [i / 10, (10 - i) / 10] for i in range(10)}, 3, [[9, 8, 7], [0, 1, 2]]),
        ({7: [0.8, 0.7], 8: [0.2, 0.1]}, 2, [[7, 8], [7, 8]]),
        ({9: [0.5, 0.5], 2: [0.5, 0.5], 5: [0.5, 0.5]}, 2, [[2, 5], [2, 5]]),
    ],
)
def test_top_k_of_each_query_is_its_own(spark, files, k, expected):
    found = by_query(ranking.top_k(long_scores(spark, {m: files for m in MODELS}).repartition(3), k))
    assert found == {(m, f"q000{j + 1}"): expected[j] for m in MODELS for j in (0, 1)}


def test_scores_must_be_finite(spark):
    for bad in (float("nan"), float("inf")):
        with pytest.raises(PySparkException, match="finite"):
            ranking.top_k(long_scores(spark, {"clip": {1: [bad]}}), 1).collect()


def test_a_row_needs_a_value_for_each_query(spark):
    wide = spark.createDataFrame([(1, [0.5])], "file_id long, scores array<double>")
    with pytest.raises(PySparkException, match="one value per query"):
        similarity.from_matrix(wide, "clip", ["q0001", "q0002"]).collect()
    whole = spark.createDataFrame([(1, [0.5, 0.25])], "file_id long, scores array<double>")
    assert {(r.query_id, r.score) for r in similarity.from_matrix(whole, "clip", ["q0001", "q0002"]).collect()} == {("q0001", 0.5), ("q0002", 0.25)}


def test_k_must_be_positive(spark):
    with pytest.raises(ValueError):
        ranking.top_k(long_scores(spark, {"clip": {1: [1]}}), 0)


def test_the_rank_filter_is_a_group_limit_at_the_default_k(spark):
    frame = ranking.top_k(long_scores(spark, {"clip": {1: [1.0]}}), 5000)
    assert "WindowGroupLimit" in frame._jdf.queryExecution().executedPlan().toString()


def test_search_equals_scoring_every_pair(spark):
    index = spark.range(200).select(F.lit("clip").alias("model_id"), F.col("id").alias("file_id"), F.array(F.sin("id"), F.cos("id"), (F.col("id") % 7).cast("double") + 1).cast("array<float>").alias("embedding")).repartition(5)
    queries = spark.createDataFrame([("clip", "q0001", [1.0, 0.0, 0.0]), ("clip", "q0002", [0.0, 1.0, 1.0])], "model_id string, query_id string, embedding array<float>")
    fast = by_query(ranking.top_k(similarity.search(index, queries, 10), 10))
    slow = by_query(ranking.top_k(similarity.score_pairs(index, queries), 10))
    assert fast == slow and all(len(v) == 10 for v in fast.values())


@pytest.mark.parametrize("sizes", [(4096, 1 << 15), (7, 5), (1, 40)])
def test_a_grid_equals_scoring_every_pair(spark, sizes):
    """Blocks of any size, more of them than are merged at once, repeated vectors that tie, a model without items and one without queries."""
    vector = F.array(F.sin(F.col("id") % 83), F.cos(F.col("id") % 83), (F.col("id") % 7).cast("double") + 1).cast("array<float>")
    index = spark.range(200).select(F.when(F.col("id") < 190, "clip").otherwise("alone").alias("model_id"), F.col("id").alias("file_id"), vector.alias("embedding"))
    queries = spark.range(23).select(F.when(F.col("id") < 20, "clip").otherwise("none").alias("model_id"), F.concat(F.lit("q"), "id").alias("query_id"), vector.alias("embedding"))
    fast = by_query(ranking.top_k(similarity.grid(index, queries, 6, *sizes), 6))
    slow = by_query(ranking.top_k(similarity.score_pairs(index, queries), 6))
    assert fast == slow and len(fast) == 20 and all(len(v) == 6 for v in fast.values())
    assert similarity.grid(index.limit(0), queries, 3).count() == 0 == similarity.grid(index, queries.limit(0), 3).count()


def test_a_grid_stores_what_grows_with_the_rows(spark, monkeypatch):
    """Items are written once and named to cells: no vector is sent for each block of the other side; files, runs of them and ties change nothing."""
    vector = F.array(*[F.cos(F.col("id") % 31 * (i + 1)) for i in range(6)]).cast("array<float>")
    index = spark.range(400).select(F.lit("clip").alias("model_id"), F.col("id").alias("file_id"), vector.alias("embedding"))
    queries = index.select("model_id", F.col("file_id").cast("string").alias("query_id"), "embedding")
    asked = similarity.grid(index, queries, 3, 10, 10)
    items = asked._jdf.queryExecution().optimizedPlan().children().head().toString()  # what a cell gets beside its queries
    assert "name" in items and "embedding" not in items and asked.count() == 1200
    slow = by_query(ranking.top_k(similarity.score_pairs(index, queries), 3))
    monkeypatch.setattr(similarity, "FILE_BYTES", 48 * 40)
    monkeypatch.setattr(similarity, "CELL_ITEMS", 100)
    for sizes in ((10, 10), (1000, 7), (33, 1000)):
        assert by_query(ranking.top_k(similarity.grid(index, queries, 3, *sizes), 3)) == slow


def test_many_queries_go_through_the_grid(spark, monkeypatch):
    monkeypatch.setattr(similarity, "MOST_QUERIES", 3)
    index = spark.range(50).select(F.lit("clip").alias("model_id"), F.col("id").alias("file_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    queries = index.where("file_id < 9").select("model_id", F.col("file_id").cast("string").alias("query_id"), "embedding")
    found = similarity.search(index, queries, 4)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert by_query(ranking.top_k(found, 4)) == by_query(ranking.top_k(similarity.score_pairs(index, queries), 4))


def test_fusion_of_many_models_adds_in_order(spark):
    import random

    pick = random.Random(4)
    rows = [(f"m{m:03d}", f"q{pick.randrange(3)}", pick.randrange(6), 0.0, pick.randrange(1, 400)) for m in range(300) for _ in range(4)]
    order = [f"m{m:03d}" for m in pick.sample(range(300), 280)]
    models = spark.createDataFrame([(m, i) for i, m in enumerate(order)], "model_id string, place int")
    many = {(r.query_id, r.file_id): (r.fusion_score, r.final_rank) for r in fusion.fuse_many(ranked_rows(spark, rows), models).collect()}
    one = {(r.query_id, r.file_id): r.fusion_score for r in fusion.fuse(ranked_rows(spark, rows), models=order).collect()}
    assert {k: s for k, (s, _) in many.items()} == one  # to the last bit
    assert "collect_list" not in fusion.fuse_many(ranked_rows(spark, rows), models)._jdf.queryExecution().optimizedPlan().toString()
    for q in ("q0", "q1", "q2"):
        mine = sorted((v for k, v in many.items() if k[0] == q), key=lambda v: v[1])
        assert [r for _, r in mine] == list(range(1, len(mine) + 1)) and [s for s, _ in mine] == sorted((s for s, _ in mine), reverse=True)
    assert fusion.fuse_many(ranked_rows(spark, []), models).count() == 0


def ranked_rows(spark, rows):
    return spark.createDataFrame([(m, q, f, float(s), r) for m, q, f, s, r in rows], RANKED)


def test_rrf_adds_reciprocal_ranks(spark):
    ranked = ranked_rows(spark, [("siglip2", "q0001", 42, 0.3, 12), ("siglip2", "q0002", 42, 0.1, 820), ("clip", "q0001", 42, 0.2, 19)])
    rows = {r.query_id: r for r in fusion.model_columns(fusion.fuse(ranked)).collect()}
    one, two = rows["q0001"], rows["q0002"]
    assert (one.models_matched, one.fusion_score) == ("SigLIP2+CLIP", 1 / 72 + 1 / 79)
    assert (two.models_matched, two.fusion_score, two.clip_rank, two.clip_cos) == ("SigLIP2", 1 / 880, None, None)


def test_fusion_end_to_end(spark):
    scores = long_scores(spark, {"siglip2": {0: [0.9, 0.8], 1: [0.7, 0.1], 2: [0.2, 0.7]}, "clip": {0: [0.8, 0.1], 1: [0.6, 0.9], 2: [0.1, 0.8]}})
    rows = {(r.file_id, r.query_id): r for r in fusion.fuse(ranking.top_k(scores, 1)).collect()}
    assert set(rows) == {(0, "q0001"), (0, "q0002"), (1, "q0002")}
    assert rows[0, "q0001"].fusion_score == 2 / 61
    assert (rows[0, "q0002"].final_rank, rows[1, "q0002"].final_rank) == (1, 2)


def test_fusion_takes_the_best_of_repeats_and_other_models(spark):
    ranked = ranked_rows(spark, [("clip", "q0001", 1, 0.5, 3), ("clip", "q0001", 1, 0.6, 2), ("clip", "q0001", 1, 0.7, 2), ("zeta", "q0001", 1, 0.1, 1)])
    row = fusion.fuse(ranked).first()
    assert (row.ranks, row.scores, row.models_matched) == ({"clip": 2, "zeta": 1}, {"clip": 0.7, "zeta": 0.1}, "CLIP+zeta")
    assert [(r.rank, r.score) for r in ranking.dedupe(ranked).where("model_id = 'clip'").collect()] == [(2, 0.7)]


def test_fusion_refuses_bad_input(spark):
    with pytest.raises(ValueError):
        fusion.fuse(ranked_rows(spark, []), rrf_constant=-1)
    with pytest.raises(ValueError, match="unique"):
        fusion.fuse(ranked_rows(spark, []), queries=["a", "a"])
    with pytest.raises(PySparkException, match="is 1 or more"):
        fusion.fuse(ranked_rows(spark, [("clip", "q", 1, 0.5, 0)])).collect()


def test_queries_that_no_order_names_come_last(spark):
    ranked = ranked_rows(spark, [("clip", q, 1, 0.5, 1) for q in ("x", "b", "a")])
    rows = fusion.fuse(ranked, queries=["b", "a"]).orderBy("position", "query_id", "final_rank").collect()
    assert [r.query_id for r in rows] == ["b", "a", "x"]


def strong(spark, rows):
    return spark.createDataFrame(rows, "file_id long, query_id string, final_rank int")


@pytest.mark.parametrize(
    "rows, k, files, counts",
    [
        ([(1, "dog", 1), (2, "cat", 95), (2, "dog", 96)], 100, [2, 1], [2, 1]),
        ([(3, "cat", 101), (3, "dog", 12)], 100, [3], [1]),
        ([(1, "cat", 2), (1, "dog", 50), (2, "cat", 10), (2, "dog", 50)], 100, [1, 2], [2, 2]),
        ([(9, "cat", 5), (9, "dog", 6), (2, "cat", 5), (2, "dog", 6)], 10, [2, 9], [2, 2]),
    ],
)
def test_evaluator(spark, rows, k, files, counts):
    out = fusion.evaluate(strong(spark, rows).repartition(3), k, queries=["cat", "dog"]).orderBy("evaluator_rank").collect()
    assert [r.file_id for r in out] == files and [r.strong_query_count for r in out] == counts
    for r in out:
        assert math.isclose(r.evaluator_score, sum(m.reciprocal_contribution for m in r.query_matches))
        assert r.best_query_rank == min(m.final_rank for m in r.query_matches)


def test_evaluator_refuses_bad_input(spark):
    with pytest.raises(ValueError):
        fusion.evaluate(strong(spark, [(1, "a", 1)]), 0)
    with pytest.raises(ValueError):
        fusion.evaluate(strong(spark, [(1, "a", 1)]), 1, -1)
    with pytest.raises(PySparkException, match="unique"):  # even beyond the cutoff
        fusion.evaluate(strong(spark, [(1, "a", 1), (1, "a", 9)]), 5).collect()


def test_empty_tables_give_empty_results(spark):
    empty = ranked_rows(spark, [])
    assert ranking.top_k(empty.drop("rank"), 3).count() == 0
    assert fusion.evaluate(fusion.fuse(empty), 3).count() == 0


def test_counts_include_queries_without_candidates(spark):
    queries = spark.createDataFrame([("q0001", 0), ("q0002", 1)], "query_id string, position int")
    rows = ranking.candidate_counts(ranked_rows(spark, [("clip", "q0001", 1, 0.5, 1)]), list(MODELS), queries).collect()
    assert {(r.model_id, r.query_id): r.candidates for r in rows} == {("siglip2", "q0001"): 0, ("siglip2", "q0002"): 0, ("clip", "q0001"): 1, ("clip", "q0002"): 0}


def test_ordinals_follow_the_order_over_many_ranges(spark):
    rows = ranking.ordinals(spark.range(1000).repartition(7), F.desc("id")).collect()
    assert sorted((r.ordinal, 999 - r.id) for r in rows) == [(i, i) for i in range(1000)]


def test_walk_order_makes_each_key_once(spark, sf, monkeypatch):
    """No sort has case folding in its own order, where it is made anew for each comparison."""
    from lodestar.plans import catalog

    plans, plain = [], ranking.materialized
    monkeypatch.setattr(ranking, "materialized", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    for name in ("folded_order", "dfs_order"):
        assert catalog.queries()[name](spark, sf).count()
    plans.append(catalog.queries()["limit_discovery"](spark, sf)._jdf.queryExecution().optimizedPlan().toString())
    sorts = [line for plan in plans for line in plan.splitlines() if "Sort [" in line]
    assert len(sorts) == 3 and all("walk_key" in line and "translate" not in line for line in sorts)
