"""Images and what encoders make of them, as table functions.

An encoder is anything with model_id, encode_queries(texts) and
encode_images(rasters), both returning one row of floats each, and
optionally load() and unload().  It is made anew in each Python worker by a
factory, so that nothing heavy is built before a task needs it.
"""

from __future__ import annotations

import hashlib
import io
import os
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, AccumulatorParam, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.schemas import DECODE_ERROR, VALID


class Encoder(Protocol):
    model_id: str

    def encode_queries(self, texts: list[str]) -> np.ndarray: ...

    def encode_images(self, images: list[Any]) -> np.ndarray: ...


def decode(data: bytes) -> Any:
    """An RGB raster (rows, columns, 3), turned upright; needs Pillow, which is asked for only here."""
    from PIL import Image, ImageOps

    with Image.open(io.BytesIO(data)) as image:
        return np.asarray(ImageOps.exif_transpose(image).convert("RGB"))


#: What a broken image raises; anything else is a fault of ours and ends the job.
BROKEN = (OSError, ValueError, SyntaxError)
#: What the image library raises for pictures that would fill the memory; known by name, as it is imported only to decode.
BOMBS = ("DecompressionBombError", "DecompressionBombWarning")


def is_broken(problem: Exception) -> bool:
    """Whether a decoder's exception is about the image."""
    return isinstance(problem, BROKEN) or any(c.__name__ in BOMBS for c in type(problem).__mro__)


def authentic(path: str, size: int, mtime_ns: int, sha256: str) -> bytes:
    """A file's bytes, read once; fails if they aren't those of the manifest."""
    with open(path, "rb") as f:
        stat = os.fstat(f.fileno())
        data = f.read()
    if stat.st_size != size or stat.st_mtime_ns != mtime_ns or hashlib.sha256(data).hexdigest() != sha256:
        raise RuntimeError(f"evidence changed since it was listed: {path}")
    return data


def unit_rows(rows: Any) -> np.ndarray:
    """Finite float32 rows of length one."""
    out = np.asarray(rows, dtype=np.float32)
    if out.ndim != 2 or not np.isfinite(out).all():
        raise ValueError("embeddings must be a finite matrix")
    return out / np.maximum(np.linalg.norm(out.astype(np.float64), axis=1, keepdims=True), 1e-30).astype(np.float32)


def normalized(rows: DataFrame, vector: str, name: str) -> DataFrame:
    """rows with a further column of the vectors at length one (unit_rows() by batch); vectors that aren't finite fail."""
    kind = rows.withColumn(name, F.lit(None).cast("array<float>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(vector)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            units = unit_rows(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 0), np.float32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(units), pa.list_(pa.float32()))], names=[*b.schema.names, name])

    return rows.mapInArrow(run, kind)


class _Largest(AccumulatorParam):
    """Numbers by task, of which the largest counts: a task that runs twice adds nothing."""

    def zero(self, value: dict[int, int]) -> dict[int, int]:
        return {}

    def addInPlace(self, a: dict[int, int], b: dict[int, int]) -> dict[int, int]:  # noqa: N802 (Spark's name)
        for part, n in b.items():
            a[part] = max(a.get(part, 0), n)
        return a


def counter(spark: SparkSession) -> Accumulator:
    """What encode() counts rows in, task by task: a number for each."""
    return spark.sparkContext.accumulator({}, _Largest())


def counted(done: Accumulator) -> int:
    """Rows of the tasks that have ended."""
    return sum(dict(done.value).values())


def encode(manifest: DataFrame, factory: Callable[[], Encoder], batch: int = 64, decoder: Callable[[bytes], Any] = decode, done: Accumulator | None = None) -> DataFrame:
    """manifest -> (model_id, ordinal, state, embedding, error_type, message): one row per file.

    Files of an index manifest (with sha256) are checked against it (a change
    ends the job) and decoded from the same bytes; of a plain manifest they are
    read as they are.  A broken image is a row in state DECODE_ERROR.  batch
    images are encoded together; the encoder is loaded once for each task.
    done, a counter(), hears of a task's rows when it ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = factory(), 0
        getattr(encoder, "load", lambda: None)()
        try:
            for b in batches:
                rows = b.to_pylist()
                for at in range(0, len(rows), batch):
                    yield _encoded(encoder, rows[at : at + batch], decoder)
                seen += len(rows)
            if done is not None:
                done.add({TaskContext.get().partitionId(): seen})
        finally:
            getattr(encoder, "unload", lambda: None)()

    return manifest.mapInArrow(run, "model_id string, ordinal long, state byte, embedding array<float>, error_type string, message string")


def _encoded(encoder: Encoder, rows: list[dict], decoder: Callable[[bytes], Any]) -> pa.RecordBatch:
    images, problems = {}, {}
    for r in rows:
        data = authentic(r["source_path"], r["size"], r["mtime_ns"], r["sha256"]) if "sha256" in r else None
        try:
            images[r["ordinal"]] = decoder(Path(r["source_path"]).read_bytes() if data is None else data)
        except Exception as problem:
            if not is_broken(problem):
                raise
            problems[r["ordinal"]] = problem
    vectors = dict(zip(images, unit_rows(encoder.encode_images(list(images.values()))), strict=True)) if images else {}
    ids = [r["ordinal"] for r in rows]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([encoder.model_id] * len(ids), pa.string()),
            pa.array(ids, pa.int64()),
            pa.array([VALID if i in vectors else DECODE_ERROR for i in ids], pa.int8()),
            pa.array([vectors.get(i) for i in ids], pa.list_(pa.float32())),
            pa.array([type(problems[i]).__name__ if i in problems else None for i in ids], pa.string()),
            pa.array([str(problems[i]) if i in problems else None for i in ids], pa.string()),
        ],
        names=["model_id", "ordinal", "state", "embedding", "error_type", "message"],
    )


def query_vectors(queries: DataFrame, encoder: Encoder) -> DataFrame:
    """(model_id, query_id, embedding) of a few queries, encoded together on the driver, once."""
    rows = queries.orderBy("position").select("query_id", "model_query").collect()
    vectors = unit_rows(encoder.encode_queries([r.model_query for r in rows]))
    return queries.sparkSession.createDataFrame([(encoder.model_id, r.query_id, v.tolist()) for r, v in zip(rows, vectors, strict=True)], "model_id string, query_id string, embedding array<float>")
