"""The session settings that the plans of this package count on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Top-K of this size and below are kept as bounded heaps by Spark's window group limit.
TOP_K_LIMIT = 5000

#: Rows of a table (query texts, models, ranges of ordinals) up to which it may be sent to every task.
BROADCAST_ROWS = 100_000

_own_dir: list[str] = []


def build(app: str = "lodestar", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI mode, adaptive execution and group limits up to TOP_K_LIMIT."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.optimizer.windowGroupLimitThreshold": str(TOP_K_LIMIT),
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a folder of our own only where it is unset and one machine does all the work."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="lodestar-"))
        atexit.register(shutil.rmtree, urlparse(_own_dir[0]).path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_own_dir[0])
    return _own_dir[0]


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked to be sent to every task if it has no more than rows; if it has more, Spark joins it as it sees fit."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(spark: SparkSession) -> int:
    """Tasks for rows that are small but long to work off, such as names of files: some for each core, whatever the rows' bytes."""
    return 4 * spark.sparkContext.defaultParallelism


def removed(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended before the program: who owns the folder clears it
        pass


def materialized(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that every reader sees the same rows in the same place; the folder goes when the program ends."""
    path = f"{shared_dir(df.sparkSession)}/lodestar/frame-{uuid.uuid4().hex}"
    atexit.register(removed, df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Watch:
    """Hears, while a block runs, how far it is: hear(n) whenever count() has grown, from a thread that asks every so often, and once more at the end.

    What hear() hears only ever grows.  If it raises, it hears no more, and the block's end raises the same.
    """

    def __init__(self, count: Callable[[], int], hear: Callable[[int], None], every: float = 0.5):
        self.count, self.hear, self.every = count, hear, every
        self.heard, self.fault, self.ended = 0, None, threading.Event()

    def _ask(self) -> None:
        try:
            now = self.count()
            if now > self.heard and self.fault is None:
                self.heard = now
                self.hear(now)
        except BaseException as fault:  # it belongs to the block's thread
            self.fault = fault

    def _run(self) -> None:
        while not self.ended.wait(self.every):
            self._ask()

    def __enter__(self) -> Watch:
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, kind, fault, trace) -> None:
        self.ended.set()
        self.thread.join()
        if kind is None:
            self._ask()
            if self.fault is not None:
                raise self.fault
