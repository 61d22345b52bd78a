"""The operators as stages of a pipeline: functions of (spark, docs, sf_dir) that return documents.

A filtering stage keeps all columns of docs as they are; names that it adds
on the way can't clash with them.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import language, packing, resemblance, toxicity
from lodestar.llm.common import spread, table


def _own(name: str) -> str:
    return f"__{name}_{uuid.uuid4().hex}"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; the model learns from the labels among docs.

    Null and empty texts have a score like any other.  Without a label, or with labels of one class only, and for an empty table,
    toxicity.learn() says what is scored; rows that share an id or have none are rows each, and texts of any length are scored whole.
    """
    score = _own("toxicity")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_scores(docs, model, score).where(F.col(score) < 0.5).drop(score)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told at or above the calibrated floor; those without a letter go, null and empty texts too.

    Texts of any length are told as a whole; rows that share an id or have none are rows each.  Where no row has a language to learn from, all
    with a letter stay; an empty table stays one.
    """
    names = (_own("language"), _own("share"))
    model = language.learn(docs)
    if model.model is None:  # nothing to tell languages by: only texts without a letter are known to have none
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.with_predictions(docs, model, names)
    return found.where((F.col(names[0]) != language.UNKNOWN) & (F.col(names[1]) >= model.floor)).drop(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each cluster of near-duplicates one row: that with the smallest doc_id (none: last), then with the smallest hash of its text.

    Near-duplicates have a Jaccard similarity of 0.8 or more by shingles of five
    words; SimHash's fuzzy keys and keys of minima find them (resemblance.py), and
    clusters are what they connect.  Rows that share an id, or have none, are rows like
    any other: a text that is nobody's near-duplicate stays whatever its id.
    """
    rows, found = resemblance.clusters(docs)
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "hash", "file", "place")
    kept = found.groupBy("cluster").agg(F.min(order).alias("least"), F.count("*").alias("n")).where("n > 1").select("cluster", "n", F.col("least.file").alias("f"), F.col("least.place").alias("p"))
    gone = spread(found, kept, "cluster").where("file <> f or place <> p").select("file", "place", F.lit(0).cast("long").alias("digest"))
    return resemblance.located(rows, gone, without=True).drop("file", "place").toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences of 1024 tokens: packing.pack() says what null, empty and very long texts become; an empty table has none."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
