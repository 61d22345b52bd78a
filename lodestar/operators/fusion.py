"""Reciprocal rank fusion of models, and the consolidation of queries into one row for each file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.checks import ensured, non_negative, positive, unique
from lodestar.operators.ranking import checked_ranks
from lodestar.schemas import MODELS
from lodestar.session import few


def label(model_ids: Column) -> Column:
    """Display names joined by '+': the known models in their order, then others by id."""
    known = list(MODELS)
    place = lambda m: F.when(m == known[0], 0).when(m == known[1], 1).otherwise(2)
    name = lambda m: F.when(m == known[0], MODELS[known[0]]).when(m == known[1], MODELS[known[1]]).otherwise(m)
    keyed = F.array_sort(F.transform(model_ids, lambda m: F.struct(place(m).alias("place"), m.alias("id"))))
    return F.array_join(F.transform(keyed, lambda x: name(x["id"])), "+")


def positions(queries: DataFrame | Sequence[str] | None, spark) -> DataFrame | None:
    """(query_id, position) of an order of queries; an order that names one twice fails."""
    if queries is None:
        return None
    if isinstance(queries, DataFrame):
        return queries.select("query_id", "position")
    return spark.createDataFrame([(q, i) for i, q in enumerate(unique("query_order", queries))], "query_id string, position int")


def _with_position(df: DataFrame, order: DataFrame | None) -> DataFrame:
    """df with position; queries that the order doesn't name come after all that it does."""
    if order is None:
        return df.withColumn("position", F.lit(0))
    unnamed = order.count()
    return df.join(few(order), "query_id", "left").withColumn("position", F.coalesce("position", F.lit(unnamed)))


def fuse(ranked: DataFrame, rrf_constant: int = 60, models: Sequence[str] = tuple(MODELS), queries: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """ranked -> (file_id, query_id, scores, ranks, models_matched, fusion_score, final_rank, position).

    fusion_score is the sum of 1 / (rrf_constant + rank) over the models that
    ranked the file for the query, added in the order of models (others by id
    after them); raw scores are never compared across models.  final_rank
    counts 1 to n inside a query by fusion score, number of models, best rank,
    the rank in each of MODELS (missing last), and file_id.  position is the
    query's place in queries; sort by (position, query_id, final_rank) for output.

    One shuffle by (file_id, query_id), whose groups have a row for each
    model, and one by query_id, whose groups hold models x k rows at most.
    """
    non_negative("rrf_constant", rrf_constant)
    place = F.lit(len(models))
    for i, m in reversed(list(enumerate(models))):
        place = F.when(F.col("model_id") == m, i).otherwise(place)
    entry = F.struct(place.alias("place"), F.col("model_id").alias("model"), "rank", (-F.col("score")).alias("minus"))
    grouped = checked_ranks(ranked).groupBy("file_id", "query_id").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    first = F.filter("all", lambda x, i: (i == 0) | (F.get("all", i - 1)["model"] != x["model"]))
    one = grouped.select("file_id", "query_id", first.alias("best"))
    fused = one.select(
        "file_id",
        "query_id",
        F.map_from_entries(F.transform("best", lambda x: F.struct(x["model"], -x["minus"]))).alias("scores"),
        F.map_from_entries(F.transform("best", lambda x: F.struct(x["model"], x["rank"]))).alias("ranks"),
        label(F.transform("best", lambda x: x["model"])).alias("models_matched"),
        F.aggregate("best", F.lit(0.0), lambda s, x: s + F.lit(1.0) / (x["rank"] + rrf_constant)).alias("fusion_score"),
    )
    by_model = [F.asc_nulls_last(F.col("ranks")[m]) for m in MODELS]
    order = Window.partitionBy("query_id").orderBy(F.desc("fusion_score"), F.desc(F.size("ranks")), F.array_min(F.map_values("ranks")), *by_model, F.asc("file_id"))
    return _with_position(fused.withColumn("final_rank", F.row_number().over(order)), positions(queries, ranked.sparkSession))


def fuse_many(ranked: DataFrame, models: DataFrame, rrf_constant: int = 60) -> DataFrame:
    """ranked -> (file_id, query_id, models, best_rank, fusion_score, final_rank), for any number of models.

    models (model_id, place) is their order; those that it doesn't name come after them, by id.  The
    contributions to a file are added one by one in that order as sorted rows go by, as fuse() adds them, but
    no list of a file's models is made anywhere: equal to it to the last bit.  Repeats of a model's
    file are cut to the best before anything is sent.  final_rank counts by score, number of models, best rank and file_id.
    """
    non_negative("rrf_constant", rrf_constant)
    best = checked_ranks(ranked).groupBy("file_id", "query_id", "model_id").agg(F.min("rank").alias("rank"))
    placed = best.join(few(models.select("model_id", "place")), "model_id", "left")
    keys = ("file_id", "query_id")
    so_far = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("place"), "model_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = placed.select(*keys, F.row_number().over(so_far).alias("models"), F.min("rank").over(so_far).alias("best_rank"), F.sum(F.lit(1.0) / (F.col("rank") + rrf_constant)).over(so_far).alias("fusion_score"))
    whole = added.groupBy(*keys).agg(F.max_by(F.struct("models", "best_rank", "fusion_score"), "models").alias("last")).select(*keys, "last.*")
    order = Window.partitionBy("query_id").orderBy(F.desc("fusion_score"), F.desc("models"), F.asc("best_rank"), F.asc("file_id"))
    return whole.withColumn("final_rank", F.row_number().over(order))


def model_columns(fused: DataFrame) -> DataFrame:
    """fused with a score and a rank column for each of MODELS, null where the model didn't rank the file."""
    named = {"siglip2_score": F.col("scores")["siglip2"], "clip_cos": F.col("scores")["clip"], "siglip2_rank": F.col("ranks")["siglip2"], "clip_rank": F.col("ranks")["clip"]}
    return fused.withColumns(named)


def in_both(fused: DataFrame) -> DataFrame:
    """(candidates, in_both): all fused candidates, and those that two models ranked."""
    return fused.agg(F.count("*").alias("candidates"), F.count_if(F.size("ranks") == 2).alias("in_both"))


def evaluate(fused: DataFrame, top_k: int, rrf_constant: int = 60, queries: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """fused (file_id, query_id, final_rank) -> one row for each file that is among the first top_k of a query.

    (file_id, evaluator_rank, evaluator_score, strong_query_count,
    best_query_id, best_query_rank, query_matches).  Only final ranks matter.
    A file's matches are sorted by rank, then the query's place, then its id,
    and their reciprocal contributions are added in that order, whichever task
    has them, so that equal files tie exactly.  A (file, query) that occurs
    twice, or a rank below one, fails even beyond top_k.

    The last rank is over everything, but everything is queries x top_k rows
    at most, of which a task sends on a few columns.
    """
    positive("evaluator_top_k", top_k)
    non_negative("rrf_constant", rrf_constant)
    own = fused.select("file_id", "query_id", ensured(F.col("final_rank"), F.col("final_rank") >= 1, "a final rank is 1 or more").alias("final_rank"))
    placed = _with_position(own, positions(queries, fused.sparkSession))
    match = F.struct("final_rank", "position", "query_id")
    grouped = placed.groupBy("file_id").agg(F.collect_list("query_id").alias("all"), F.array_sort(F.collect_list(F.when(F.col("final_rank") <= top_k, match))).alias("strong"))
    once = F.size(F.array_distinct("all")) == F.size("all")
    strong = grouped.select("file_id", ensured(F.col("strong"), once, "(file_id, query_id) must be unique").alias("strong")).where(F.size("strong") > 0)
    part = lambda x: F.lit(1.0) / (x["final_rank"] + rrf_constant)
    scored = strong.select(
        "file_id",
        F.aggregate("strong", F.lit(0.0), lambda s, x: s + part(x)).alias("evaluator_score"),
        F.size("strong").alias("strong_query_count"),
        F.col("strong")[0]["query_id"].alias("best_query_id"),
        F.col("strong")[0]["final_rank"].alias("best_query_rank"),
        F.transform("strong", lambda x: F.struct(x["query_id"].alias("query_id"), x["final_rank"].alias("final_rank"), part(x).alias("reciprocal_contribution"))).alias("query_matches"),
    )
    order = Window.orderBy(F.desc("strong_query_count"), F.desc("evaluator_score"), F.asc("best_query_rank"), F.asc("file_id"))
    return scored.select("file_id", F.row_number().over(order).alias("evaluator_rank"), "evaluator_score", "strong_query_count", "best_query_id", "best_query_rank", "query_matches")
