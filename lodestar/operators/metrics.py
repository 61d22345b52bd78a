"""Counts of passes, states and commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.schemas import DECODE_ERROR, PENDING, VALID
from lodestar.session import few


def bitmaps(passes: DataFrame) -> DataFrame:
    """passes (model_id, ordinal, status) -> (model_id, status, bucket, bits): the ordinals met, 32768 to a bucket, as bits.

    They are made on the map side, so that what is shuffled doesn't grow with repeats, and can be
    stored and merged with those of other passes.  Rows without an ordinal or status don't count.
    """
    o, call = F.col("ordinal"), F.call_function
    made = call("bitmap_construct_agg", call("bitmap_bit_position", o)).alias("bits")
    return passes.where("ordinal is not null and status is not null").groupBy("model_id", "status", call("bitmap_bucket_number", o).alias("bucket")).agg(made)


def merged(bits: DataFrame, *keys: str) -> DataFrame:
    """(keys, status, bucket, bits): bitmaps of many passes or models as those of all of them; an ordinal counts once, whichever met it."""
    return bits.groupBy(*keys, "status", "bucket").agg(F.call_function("bitmap_or_agg", F.col("bits")).alias("bits"))


def covered(bits: DataFrame, *keys: str) -> DataFrame:
    """(keys, processed, decode_errors): how many ordinals merged() bitmaps hold, without a look at the passes."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.call_function("bitmap_count", F.col("bits")))), F.lit(0))
    return merged(bits, *keys).groupBy(*keys).agg(n("processed").alias("processed"), n("decode_error").alias("decode_errors"))


def record_pass(passes: DataFrame, path: str) -> None:
    """Add a pass's bitmaps to those stored at path."""
    bitmaps(passes).write.mode("append").parquet(path)


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """The bitmaps of all passes stored at path."""
    return spark.read.schema("model_id string, status string, bucket long, bits binary").parquet(path)


def pass_metrics(passes: DataFrame) -> DataFrame:
    """passes (model_id, ordinal, status) -> distinct ordinals processed and failed, of each model."""
    return covered(bitmaps(passes), "model_id")


def scan_metrics(passes: DataFrame) -> DataFrame:
    """The same over all models: an ordinal counts once, whichever passes met it."""
    return covered(bitmaps(passes))


def bitmap_counts(passes: DataFrame) -> DataFrame:
    """(model_id, status, ordinals): distinct ordinals, by bitmaps."""
    return bitmaps(passes).groupBy("model_id", "status").agg(F.sum(F.call_function("bitmap_count", F.col("bits"))).alias("ordinals"))


def state_counts(rows: DataFrame) -> DataFrame:
    """(model_id, valid, decode_errors, pending, unknown_states) of index rows."""
    s = F.col("state")
    return rows.groupBy("model_id").agg(
        F.count_if(s == VALID).alias("valid"), F.count_if(s == DECODE_ERROR).alias("decode_errors"), F.count_if(s == PENDING).alias("pending"), F.count_if(~s.isin(VALID, DECODE_ERROR, PENDING) | s.isNull()).alias("unknown_states")
    )


def commit_chain(commits: DataFrame) -> DataFrame:
    """commits with ``linked``: whether each follows its model's last one, in sequence and range, and isn't empty."""
    order = Window.partitionBy("model_id").orderBy("sequence")
    follows = (F.col("sequence") == F.row_number().over(order) - 1) & (F.col("start") == F.coalesce(F.lag("end").over(order), F.lit(0)))
    return commits.withColumn("linked", F.coalesce(follows & (F.col("end") > F.col("start")), F.lit(False)))


def commit_totals(commits: DataFrame) -> DataFrame:
    """(model_id, commits, committed_prefix, valid, errors, chain_ok) of each model's commits."""
    return commit_chain(commits).groupBy("model_id").agg(
        F.count("*").alias("commits"), F.max("end").alias("committed_prefix"), F.sum("valid_count").alias("valid"), F.sum("error_count").alias("errors"), F.bool_and("linked").alias("chain_ok")
    )


def beyond_prefix(manifest: DataFrame, commits: DataFrame) -> DataFrame:
    """(model_id, ordinal) of what each model's linked commits haven't reached: where a build that is resumed goes on."""
    chain = commit_chain(commits)
    first_gap = chain.groupBy("model_id").agg(F.min(F.when(~F.col("linked"), F.col("sequence"))).alias("gap"))
    linked = chain.join(first_gap, "model_id").where("gap is null or sequence < gap")
    prefix = first_gap.select("model_id").join(linked.groupBy("model_id").agg(F.max("end").alias("prefix")), "model_id", "left")
    return manifest.select("ordinal").join(few(prefix), F.col("ordinal") >= F.coalesce("prefix", F.lit(0))).select("model_id", "ordinal")


def lines(texts: DataFrame, column: str = "value") -> DataFrame:
    """(lines): rows of a text table that aren't blank."""
    return texts.where(F.trim(column) != "").agg(F.count("*").alias("lines"))
