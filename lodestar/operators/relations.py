"""Joins and set operations between candidates, manifest and journal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_states(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Vectors (model_id, ordinal, embedding) with the states of their rows (model_id, ordinal, state); a state without a vector has none, a vector without a state is left out."""
    return states.join(rows, ["model_id", "ordinal"], "left").select("model_id", "ordinal", "state", "embedding")


def entries_of(manifest: DataFrame, wanted: DataFrame, file_id: str = "file_id") -> DataFrame:
    """Manifest rows whose ordinal is wanted; Spark broadcasts the ids if it knows them to be few."""
    ids = wanted.select(F.col(file_id).alias("ordinal")).distinct()
    return manifest.join(ids, "ordinal", "left_semi")


def missing(manifest: DataFrame, wanted: DataFrame, file_id: str = "file_id") -> DataFrame:
    """(file_id) of wanted candidates without a manifest row."""
    ids = wanted.select(F.col(file_id).alias("ordinal")).distinct()
    return ids.join(manifest, "ordinal", "left_anti").select(F.col("ordinal").alias(file_id))


def require_entries(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """entries_of(), failing with the first ten ids that the manifest doesn't have."""
    if absent := [r.file_id for r in missing(manifest, wanted).orderBy("file_id").limit(10).collect()]:
        raise RuntimeError(f"candidates are missing from the manifest: {absent}")
    return entries_of(manifest, wanted)


def keys_of(ranked: DataFrame) -> DataFrame:
    """(file_id, query_id) that any model ranked, each once."""
    return ranked.select("file_id", "query_id").distinct()


def unknown_models(commits: DataFrame, known: list[str]) -> DataFrame:
    """(model_id) that commits name and known doesn't."""
    spark = commits.sparkSession
    return commits.select("model_id").distinct().join(spark.createDataFrame([(m,) for m in known], "model_id string"), "model_id", "left_anti")


def largest_difference(one: DataFrame, other: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(pairs, largest): rows of both that share keys, and the largest absolute difference of their values."""
    joined = one.select(*keys, F.col(value).alias("a")).join(other.select(*keys, F.col(value).alias("b")), keys)
    return joined.agg(F.count("*").alias("pairs"), F.max(F.abs(F.col("a") - F.col("b"))).alias("largest"))
