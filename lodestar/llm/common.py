"""Helpers that several operators of this package share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.session import shared_dir

#: Rows and bytes of one Arrow batch handed to Python: a batch ends at whichever it reaches first.
ARROW_ROWS, ARROW_BYTES = 512, 64 << 20

def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; the folder's owner cleans it then
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    A lost executor then costs a re-read, never a recomputation of the stages before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents, dealt over all cores if its files have fewer parts than there are: a small file is one task otherwise."""
    rows, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


#: A key counts as hot if it has more than HOT_ROWS rows and more than the HOT_KEYS-th part of all: of these there are no more than HOT_KEYS.
HOT_ROWS, HOT_KEYS = 256, 10_000


def spread(big: DataFrame, small: DataFrame, on: str, rows: str = "n") -> DataFrame:
    """big with small's columns, by the key on, of which small has each once, with how many rows of big have it.

    Rows of hot keys meet small's few rows of these where they lie, and go on by hashes of all their
    columns; only the others go by their keys.  So no key's rows gather in one task, however many it has.
    """
    small = written(small, "small")
    hot = F.col(rows) > max(HOT_ROWS, (small.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]) // HOT_KEYS)
    more = [c for c in small.columns if c not in (on, rows)]
    own = F.struct(F.lit(True).alias("there"), *more)
    marked = big.join(F.broadcast(small.where(hot).select(on, own.alias("__hot"))), on, "left")  # HOT_KEYS rows at most
    dealt = marked.withColumn("__salt", F.when(F.col("__hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(*big.columns), F.lit(1 << 20)) + 1))
    # the others' salt is 0 for any number of rows: as a literal Spark would drop it from the keys that rows go by
    met = dealt.join(small.where(~hot).select(on, own.alias("__cold"), F.least(F.col(rows), F.lit(0)).cast("long").alias("__salt")), [on, "__salt"], "left").withColumn("__one", F.coalesce("__hot", "__cold"))
    return met.where("__one is not null").select(*big.columns, *[F.col("__one")[c].alias(c) for c in more])


def release(spark: SparkSession) -> None:
    """Give the system back what the driver has freed: a training's arrays, tables from tasks, and in its JVM the plans of jobs that are over."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()  # a heap shrinks only then; until it is full it keeps what it has grown to
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def arrow_rows(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts can hold.

    These are settings of the session, read when a plan runs, so that they stay after an
    operator has been called; larger values of the caller's are lowered, smaller ones kept.
    """
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key).rstrip("bB"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def remainder(column, modulus: int):
    """crc32 of the id written as text, modulo modulus: the fold a row belongs to; null ids are in fold 0's complement."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1))
