"""Exact cosine similarity of items and queries."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.checks import finite, positive
from lodestar.session import materialized, removed, shared_dir

#: Query vectors are sent to every task; beyond so many bytes they go block by block.
QUERY_BYTES = 64 << 20
#: Queries up to which all their vectors are sent to every task as rows.
MOST_QUERIES = 4096


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, from the first component to the last."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Parts into which each model's items are dealt where its queries are too many to be sent to every task.
PARTS = 256


def score_pairs(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(model_id, query_id, file_id, score) of every item and query of the same model, all in Catalyst.

    index (model_id, file_id, embedding), queries (model_id, query_id,
    embedding).  The result has items times queries rows: for the best few use
    search(), which never makes them.  Scores that aren't finite fail.  Each
    vector's length is taken once.  Queries are sent to the items if they are few;
    if not, each model's items are dealt to PARTS, to each of which its queries
    go, so that no task has all items of a model.
    """
    length = lambda v: F.sqrt(dot(F.col(v), F.col(v)))
    q = queries.select("model_id", "query_id", F.col("embedding").alias("wanted"), length("embedding").alias("__own"))
    items = index.withColumn("__length", length("embedding"))
    on = ["model_id"]
    if queries.limit(MOST_QUERIES + 1).count() <= MOST_QUERIES:
        q = F.broadcast(q)
    else:
        on = ["model_id", "__part"]
        q = q.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        items = items.withColumn("__part", F.pmod(F.xxhash64("file_id"), F.lit(PARTS)).cast("int"))
    score = dot(F.col("embedding"), F.col("wanted")) / (F.col("__length") * F.col("__own"))
    return items.join(q, on).select("model_id", "query_id", "file_id", finite(score).alias("score"))


def from_matrix(scores: DataFrame, model_id: str, query_ids: list[str]) -> DataFrame:
    """Wide (file_id, scores array, one for each query) -> long scores; another width than the queries' fails."""
    wide = F.when(F.size("scores") == len(query_ids), F.col("scores")).otherwise(F.raise_error(F.lit("each row must have one value per query")))
    long = scores.select("file_id", F.posexplode(wide).alias("at", "score"))
    name = F.element_at(F.array(*[F.lit(q) for q in query_ids]), F.col("at") + 1)
    return long.select(F.lit(model_id).alias("model_id"), name.alias("query_id"), "file_id", finite(F.col("score")).alias("score"))


def _normal(rows: np.ndarray) -> np.ndarray:
    if not np.isfinite(rows).all():
        raise ValueError("embeddings must be finite")
    length = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    if (length == 0).any():
        raise ValueError("scores must be finite")
    return rows / length[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and len(flat) % len(column):
        raise ValueError("embeddings must have one dimension")
    return flat.reshape(len(column), -1)


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Scores of each query's best k items of each partition, for top_k() to rank: what a bounded heap holds after the scan.

    A matrix product by Arrow batch; a batch's rows are cut to the best k at
    once, so that a task holds queries x k rows and emits no more.  Ties go to
    the smaller file_id.  Up to MOST_QUERIES query vectors are sent to all tasks, in blocks of
    QUERY_BYTES at most; more of them go through grid(), and none through the driver.
    """
    positive("top_k", k)
    wanted = queries.select("model_id", "query_id", F.col("embedding").cast("array<double>"))
    asked = wanted.limit(MOST_QUERIES + 1).collect()
    if len(asked) > MOST_QUERIES:
        return grid(index, queries, k)
    blocks, size = [[]], 0
    for q in asked:
        if blocks[-1] and size + 8 * len(q.embedding) > QUERY_BYTES:
            blocks.append([])
            size = 0
        blocks[-1].append(q)
        size += 8 * len(q.embedding)
    out = None
    for block in blocks:
        part = _search_block(index, block, k)
        out = part if out is None else out.unionByName(part)
    return out


#: Queries of a cell of the grid, items and queries whose scores it holds at a time, bytes of a file of items, and items that a cell goes past at most.
GRID_QUERIES, GRID_ITEMS, AT_ONCE, FILE_BYTES, CELL_ITEMS = 4096, 1 << 15, 256, 16 << 20, 1 << 20
#: By how much a score of a matrix product may differ from score_pairs()'s, and how many candidates are scored anew at a time.
SLACK, ANEW = 1e-11, 1 << 16


def grid(index: DataFrame, queries: DataFrame, k: int, query_rows: int = GRID_QUERIES, item_rows: int = GRID_ITEMS) -> DataFrame:
    """The same for any number of queries: blocks of queries past runs of files of items, each pair of these in a task of its own.

    Items are written once, dealt by their hashes to files of FILE_BYTES in the shared folder, and a cell is sent
    its queries and the names of its files only.  So what is shuffled and stored grows with the rows, not with the pairs (as long as a model has
    up to CELL_ITEMS items, or fewer queries blocks than cores; each further run sends the queries once more), whatever model, file or vector is common.
    A cell goes past its items item_rows at a time and keeps k for each of its query_rows queries; what
    a matrix product finds is scored as by score_pairs(), so that ties are the same however items are cut.
    """
    positive("top_k", k), positive("query_rows", query_rows), positive("item_rows", item_rows)
    spark = index.sparkSession
    cores = spark.sparkContext.defaultParallelism
    sizes = lambda rows: rows.groupBy("model_id").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).agg(F.max("n").alias("n"), F.max("d").alias("d"), F.count("*").alias("models")).first()
    parts = lambda n, size: max(1, -(-(n or 0) // size))
    own, other = sizes(index), sizes(queries)
    across, files = parts(other.n, query_rows), parts(own.n, max(1, FILE_BYTES // (8 * max(1, own.d or 1))))
    down = min(files, max(parts(own.n, CELL_ITEMS), parts(4 * cores, across)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    folder = f"{shared_dir(spark)}/lodestar/items-{uuid.uuid4().hex}"
    atexit.register(removed, spark, folder)

    def write(group: pa.Table) -> pa.Table:
        name, (fs, path) = uuid.uuid4().hex, FileSystem.from_uri(folder)  # a task that runs twice writes two files, of which one is named
        fs.create_dir(path)
        with fs.open_output_stream(f"{path}/{name}") as out, pa.ipc.new_file(out, group.schema) as file:
            file.write_table(group.sort_by("file_id"))
        return pa.table({"model_id": group["model_id"][:1], "row": group["row"][:1], "name": [name]})

    items = index.select("model_id", F.col("file_id").cast("long"), F.col("embedding").cast("array<double>"), dealt(files, "file_id").alias("row"))
    held = materialized(items.groupBy("model_id", "row").applyInArrow(write, "model_id string, row int, name string"))
    cell = ["model_id", "row", "column"]
    spans = held.withColumn("row", F.pmod("row", F.lit(down))).withColumn("column", every(across))
    asked = queries.select("model_id", "query_id", F.col("embedding").cast("array<double>"), dealt(across, "query_id").alias("column")).withColumn("row", every(down))

    def run(names: pa.Table, wanted: pa.Table) -> pa.Table:
        if not (names.num_rows and wanted.num_rows):
            return pa.schema([("model_id", pa.string()), ("query_id", pa.string()), ("file_id", pa.int64()), ("score", pa.float64())]).empty_table()
        best, (fs, path) = _Best(k, wanted["embedding"]), FileSystem.from_uri(folder)
        for name in names["name"].to_pylist():
            with fs.open_input_file(f"{path}/{name}") as f:
                best.add(pa.ipc.open_file(f).read_all(), item_rows)
        at, ids, scores = best.found()
        return pa.table({"model_id": pa.repeat(wanted["model_id"][0], len(at)), "query_id": wanted["query_id"].take(pa.array(at)), "file_id": ids, "score": scores})

    tasks = max(1, min(across * down * max(1, other.models), 16 * cores))  # by number: cells are small to send, but not to work off
    sent = [t.repartition(tasks, *cell).groupBy(*cell) for t in (spans, asked)]
    return sent[0].cogroup(sent[1]).applyInArrow(run, "model_id string, query_id string, file_id long, score double")


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows as dot() makes them: from the first component to the last."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


class _Best:
    """The best k of each of some queries among all items added so far."""

    def __init__(self, k: int, wanted: pa.ChunkedArray):
        self.k, self.wanted = k, _matrix(wanted.combine_chunks())
        self.units, self.lengths = _normal(self.wanted), np.sqrt(_dots(self.wanted, self.wanted))
        self.least = np.full(len(self.wanted), -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.waiting = 0

    def add(self, items: pa.Table, item_rows: int) -> None:
        ids, rows = items["file_id"].to_numpy(), _matrix(items["embedding"].combine_chunks())
        if len(rows) and rows.shape[1] != self.wanted.shape[1]:
            raise ValueError("embeddings must have one dimension")
        units, lengths = _normal(rows), np.sqrt(_dots(rows, rows))
        for low in range(0, len(ids), item_rows):
            for first in range(0, len(self.wanted), AT_ONCE):
                scores = units[low : low + item_rows] @ self.units[first : first + AT_ONCE].T
                least, n = self.least[first : first + AT_ONCE], len(scores)
                if n > self.k and np.isinf(least).any():
                    least = np.maximum(least, np.partition(scores, n - self.k, axis=0)[n - self.k] - SLACK)
                i, j = np.nonzero(scores >= least)
                for at in range(0, len(i), ANEW):
                    mine, theirs = i[at : at + ANEW] + low, j[at : at + ANEW] + first
                    self._keep(theirs, ids[mine], _dots(rows[mine], self.wanted[theirs]) / (lengths[mine] * self.lengths[theirs]))

    def _keep(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.parts.append((at, ids, scores))
        self.waiting += len(at)
        if self.waiting > max(ANEW, len(self.parts[0][0])):
            self.found()

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, score), query by query, the best first; ties to the smaller id."""
        at, ids, scores = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -scores, at))
        order = order[np.arange(len(order)) - np.searchsorted(at[order], at[order]) < self.k]
        self.parts, self.waiting = [(at[order], ids[order], scores[order])], 0
        ends = np.cumsum(np.bincount(at[order], minlength=len(self.wanted)))
        full = np.flatnonzero(np.diff(ends, prepend=0) == self.k)
        self.least[full] = scores[order][ends[full] - 1] - SLACK
        return self.parts[0]


def _search_block(index: DataFrame, asked: list, k: int) -> DataFrame:
    by_model: dict[str, tuple[list[str], np.ndarray]] = {}
    for model in sorted({q.model_id for q in asked}):
        mine = [q for q in asked if q.model_id == model]
        by_model[model] = [q.query_id for q in mine], _normal(np.array([q.embedding for q in mine], np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            models = np.array(b.column("model_id").to_pylist(), object)
            ids = b.column("file_id").to_numpy(zero_copy_only=False)
            for model, (_, wanted) in by_model.items():
                rows = np.flatnonzero(models == model)
                if not len(rows):
                    continue
                scores = _normal(_matrix(b.column("embedding").take(pa.array(rows)))) @ wanted.T
                for j in range(scores.shape[1]):
                    old_ids, old = held.get((model, j), (ids[:0], scores[:0, 0]))
                    all_ids, every = np.concatenate([old_ids, ids[rows]]), np.concatenate([old, scores[:, j]])
                    best = np.lexsort((all_ids, -every))[:k]
                    held[model, j] = all_ids[best], every[best]
        for (model, j), (ids, scores) in held.items():
            yield pa.RecordBatch.from_pydict({"model_id": [model] * len(ids), "query_id": [by_model[model][0][j]] * len(ids), "file_id": ids, "score": scores})

    usable = index.where(F.col("model_id").isin(list(by_model))).select("model_id", F.col("file_id").cast("long"), F.col("embedding").cast("array<double>"))
    return usable.mapInArrow(run, "model_id string, query_id string, file_id long, score double")
