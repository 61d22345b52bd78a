"""An index's journal as a stream: how far each model is, commit by commit, as state.

Commits arrive in any number of micro-batches.  A model's state is what its linked
commits come to; a commit that doesn't follow the last one breaks the chain, and is told as it
arrives, with all that come after it.  Started again on the same checkpoint, a stream takes up its state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestar.schemas import COMMIT

_STATE = "sequence INT, prefix BIGINT, valid BIGINT, errors BIGINT, broken BOOLEAN"
#: What is told of each commit: the model's prefix and totals behind it, which a commit that isn't linked doesn't change.
LINKED = "model_id STRING, sequence INT, start BIGINT, `end` BIGINT, linked BOOLEAN, prefix BIGINT, valid BIGINT, errors BIGINT"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Chain(StatefulProcessor):
    """The commits of one model."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("chain", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        sequence, prefix, valid, errors, broken = self.state.get() or (0, 0, 0, 0, False)
        out = []
        for c in pd.concat(rows).sort_values(["sequence", "start"], kind="stable").itertuples(index=False):
            linked = not broken and c.sequence == sequence and c.start == prefix and c.end > c.start
            if linked:
                sequence, prefix, valid, errors = sequence + 1, int(c.end), valid + int(c.valid_count), errors + int(c.error_count)
            broken = broken or not linked
            out.append((key[0], int(c.sequence), int(c.start), int(c.end), linked, prefix, valid, errors))
        self.state.update((sequence, prefix, valid, errors, broken))
        yield pd.DataFrame(out, columns=["model_id", "sequence", "start", "end", "linked", "prefix", "valid", "errors"])

    def close(self) -> None: ...


def linked(commits: DataFrame) -> DataFrame:
    """A stream of commits (COMMIT's first columns) as a stream of LINKED rows; needs a session whose states lie in RocksDB (see follow())."""
    own = commits.select("model_id", "sequence", "start", "end", "valid_count", "error_count")
    return own.groupBy("model_id").transformWithStateInPandas(Chain(), LINKED, "Append", "None")


def follow(spark: SparkSession, commits_path: str, out_path: str, checkpoint: str, files_per_batch: int = 1000) -> int:
    """Take up the commits (JSON lines) that commits_path has since the last call, write LINKED rows to out_path (Parquet); the number of micro-batches.

    A model's commits have to arrive in order; within a micro-batch they may lie in any.
    """
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        stream = spark.readStream.schema(COMMIT).option("maxFilesPerTrigger", files_per_batch).json(commits_path)
        query = linked(stream).writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return sum(p["numInputRows"] > 0 for p in query.recentProgress)
