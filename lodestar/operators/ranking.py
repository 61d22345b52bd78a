"""Ranks inside groups, and ordinals over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.checks import ensured, finite, positive
from lodestar.session import few, materialized


def _checked(scores: DataFrame) -> DataFrame:
    return scores.select("model_id", "query_id", F.col("file_id"), finite(F.col("score")).alias("score"))


def full_ranking(scores: DataFrame) -> DataFrame:
    """scores with rank: 1 to n inside each (model, query), by score descending, ties to the smaller file_id.

    Rows are range-sorted by group and score and written once; a row's rank is its
    place in its range plus the rows of its group in the ranges before.  So
    a group that is as long as the corpus is ranked by many tasks, not by one.
    """
    order = (F.col("model_id"), F.col("query_id"), F.desc("score"), F.asc("file_id"))
    ranged = materialized(_checked(scores).orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__at", 33)
    parts = ranged.groupBy("model_id", "query_id", part.alias("__part")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    group = Window.partitionBy("model_id", "query_id").orderBy("__part")
    before = parts.select("model_id", "query_id", "__part", "__first", (F.sum("__n").over(group) - F.col("__n")).alias("__before"))
    joined = ranged.withColumn("__part", part).join(few(before), ["model_id", "query_id", "__part"])
    rank = (F.col("__before") + F.col("__at") - F.col("__first") + 1).cast("int")
    return joined.select("model_id", "query_id", "file_id", "score", rank.alias("rank"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The best k of each (model, query), ranked.

    The filter on the rank becomes a window group limit before and after the
    shuffle, if k is at most spark.sql.optimizer.windowGroupLimitThreshold
    (session.build() raises it): each task then sends k rows of a group.
    """
    positive("top_k", k)
    order = Window.partitionBy("model_id", "query_id").orderBy(F.desc("score"), F.asc("file_id"))
    return _checked(scores).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def candidate_counts(ranked: DataFrame, model_ids: list[str], queries: DataFrame) -> DataFrame:
    """(model_id, query_id, candidates) of each model and query, those without any too."""
    spark = ranked.sparkSession
    models = spark.createDataFrame([(m,) for m in model_ids], "model_id string")
    wanted = few(models).crossJoin(queries.select("query_id"))  # models x queries, the rows of the result
    counts = ranked.groupBy("model_id", "query_id").agg(F.count("*").alias("candidates"))
    return wanted.join(counts, ["model_id", "query_id"], "left").select("model_id", "query_id", F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"))


def dedupe(ranked: DataFrame) -> DataFrame:
    """One candidate for each (model, file, query): the lowest rank, then the highest score."""
    best = F.min_by(F.struct("score", "rank"), F.struct("rank", (-F.col("score")).alias("s")))
    return ranked.groupBy("model_id", "file_id", "query_id").agg(best.alias("best")).select("model_id", "query_id", "file_id", "best.score", "best.rank")


def ordinals(df: DataFrame, *order: Column, name: str = "ordinal", keep: list[str] | None = None) -> DataFrame:
    """df (its columns keep, or all) with 0 to n - 1 in the given order, without a window over everything.

    A sort makes an expression's value anew for each comparison: values that take long to make belong in columns of
    df, which keep can leave out.
    The range-sorted rows are written once; a row's ordinal is its place in its
    range plus the rows of the ranges before, of which there are as many as tasks.
    """
    part, place = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    kept = [F.col(f"`{c}`") for c in keep or df.columns]
    ranged = materialized(df.orderBy(*order).select(*kept, F.monotonically_increasing_id().alias("__at")))
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    joined = ranged.withColumn("__part", part).join(few(before), "__part")
    return joined.select((F.col("__before") + place).alias(name), *kept)


def first_in_order(df: DataFrame, n: int | None, *order: Column) -> DataFrame:
    """The first n rows in order (all if None); a negative n fails."""
    if n is not None and n < 0:
        raise ValueError("the limit must be non-negative")
    return df if n is None else df.orderBy(*order).limit(n)


def checked_ranks(ranked: DataFrame) -> DataFrame:
    """ranked, failing on ranks below one."""
    return ranked.withColumn("rank", ensured(F.col("rank"), F.col("rank") >= 1, "a candidate's rank is 1 or more"))
