"""Resumable encoding by Structured Streaming.

The manifest's files are a stream; each micro-batch is encoded and appended
to the model's rows under its batch id.  The checkpoint says which files are done, so that a
query started again takes up where it was lost, and a batch that was
written but not recorded is written over, not twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.schemas import INDEX_MANIFEST
from lodestar.sources import images


def encode_stream(spark: SparkSession, manifest_path: str, rows_path: str, checkpoint: str, factory: Callable[[], images.Encoder], files_per_batch: int = 1, decoder=images.decode, batch: int = 64) -> int:
    """Encode what manifest_path (Parquet) has and rows_path hasn't yet; returns how many micro-batches that took."""

    done: list[int] = []  # recentProgress forgets all but the last hundred

    def keep(part: DataFrame, batch_id: int) -> None:
        if part.isEmpty():
            return
        images.encode(part, factory, batch, decoder).write.mode("overwrite").parquet(f"{rows_path}/batch={batch_id}")
        done.append(batch_id)

    stream = spark.readStream.schema(INDEX_MANIFEST).option("maxFilesPerTrigger", files_per_batch).parquet(manifest_path)
    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)


def progress(rows: DataFrame) -> DataFrame:
    """(model_id, processed, decode_errors) of what a stream has written so far."""
    return rows.groupBy("model_id").agg(F.count_if(F.col("state") == 1).alias("processed"), F.count_if(F.col("state") == 2).alias("decode_errors"))
