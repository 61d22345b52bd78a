"""Discovery: a folder tree as a table of its images, and their order.

Spark's own binaryFile source isn't enough here: it skips names that begin
with a dot or an underscore, follows links, and matches suffixes by case.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.paths import EXTENSIONS
from lodestar.operators.ranking import first_in_order, ordinals
from lodestar.session import materialized

_SCHEMA = "relative_path STRING, source_path STRING, size BIGINT, mtime_ns BIGINT, walk_key ARRAY<STRUCT<is_dir: INT, fold: STRING, name: STRING>>, error_type STRING, message STRING"
_ARROW = pa.schema(
    [("relative_path", pa.string()), ("source_path", pa.string()), ("size", pa.int64()), ("mtime_ns", pa.int64()), ("walk_key", pa.list_(pa.struct([("is_dir", pa.int32()), ("fold", pa.string()), ("name", pa.string())]))), ("error_type", pa.string()), ("message", pa.string()), ("folder", pa.string())]
)
#: Entries that a task looks at before it hands on the folders it hasn't been to: while there are few folders, and later.
FIRST, LATER = 512, 1 << 17
#: Rows of a batch that a walk hands on.
BATCH = 4096


class Walk:
    """A task's walk: rows of what it finds, then of the folders that are left for others."""

    def __init__(self, root: str, extensions: tuple[str, ...], most: int):
        self.root, self.extensions, self.most = root, extensions, most

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, seen, out = [f for b in batches for f in b.column(0).to_pylist()], 0, []
        while pending and seen < self.most:
            folder = pending.pop()
            try:
                with os.scandir(folder) as entries:
                    for e in entries:  # a folder of any size goes by entry by entry
                        seen += 1
                        try:
                            if e.is_dir(follow_symlinks=False):
                                pending.append(e.path)
                            elif e.is_file(follow_symlinks=False) and Path(e.name).suffix.casefold() in self.extensions:
                                out.append(self._row(e))
                        except OSError as problem:
                            out.append(_error(e.path, problem))
                        if len(out) >= BATCH:
                            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                            out = []
            except OSError as problem:
                out.append(_error(folder, problem))
        out += [{"folder": f} for f in pending]
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    def _row(self, entry: os.DirEntry) -> dict:
        stat, parts = entry.stat(follow_symlinks=False), Path(entry.path).relative_to(self.root).parts
        key = [{"is_dir": int(i < len(parts) - 1), "fold": p.casefold(), "name": p} for i, p in enumerate(parts)]
        return {"relative_path": "/".join(parts), "source_path": entry.path, "size": stat.st_size, "mtime_ns": stat.st_mtime_ns, "walk_key": key}


def _error(path: str, problem: OSError) -> dict:
    return {"source_path": path, "error_type": type(problem).__name__, "message": str(problem)}


def scan(spark: SparkSession, root: str | Path, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """The tree's rows in no order: one for each regular file of these types, links left out, with what sorts it
    into walk order; and one with error_type and message for each folder or file that can't be read, while the rest goes on.

    Rounds: tasks walk the folders of the frontier, and after so many entries hand on
    those they haven't been to, which are dealt over all cores.  So whatever the tree's shape, a
    deep chain as well as one crowded folder of folders, no task has more than its share; only the entries of a single folder
    are read by one.  All executors must see root.
    """
    top = Path(os.path.abspath(root))
    if not top.exists():
        raise FileNotFoundError(f"no such folder: {root}")
    if not top.is_dir():
        raise NotADirectoryError(f"not a folder: {root}")
    tasks = 4 * spark.sparkContext.defaultParallelism
    frontier, waiting, out = spark.createDataFrame([(str(top),)], "folder string"), 1, None
    while waiting:
        walk = Walk(str(top), tuple(e.casefold() for e in extensions), FIRST if waiting < tasks else LATER)
        found = materialized(frontier.mapInArrow(walk, _SCHEMA + ", folder STRING"))
        rows = found.where("folder is null").drop("folder")
        out = rows if out is None else out.unionByName(rows)
        waiting = found.where("folder is not null").count()
        frontier = found.where("folder is not null").select("folder").repartition(min(max(waiting, 1), tasks))
    return out


def discover(spark: SparkSession, root: str | Path, max_images: int | None = None, extensions: tuple[str, ...] = EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """(manifest, errors): images in walk order with ordinals from 0, the first max_images of them; and what couldn't be read."""
    rows = scan(spark, root, extensions)
    found = first_in_order(rows.where("error_type is null"), max_images, F.col("walk_key"))
    manifest = ordinals(found, F.col("walk_key"), keep=["relative_path", "source_path", "size", "mtime_ns"])
    return manifest, rows.where("error_type is not null").select(F.col("source_path").alias("path"), "error_type", "message")
