"""What the two vector searches share: valid rows, shards and blocks as mapped files, the merge of their best.

The index is dealt to shards once, and each shard written as a file with what a
search needs of it; queries are written as blocks.  A task takes one block past a
run of shards, which it maps, and keeps only the best of each query, so that neither
index rows nor queries are sent anywhere a second time.
"""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import shared_dir, written
from lodestar.llm.elias_fano import dump, load

#: Least and most rows of an index shard, and queries of a block: what one task holds at a time.
SHARD_ROWS, MOST_ROWS, QUERY_ROWS = 4096, 1 << 16, 4096

Arrays = dict[str, np.ndarray]


def valid(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id long, vector array<double>) of rows whose id isn't null and whose vector has only finite components, one at least."""
    x = F.col(f"`{vector}`").cast("array<double>")
    out = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), x.alias("vector"))
    finite = F.forall("vector", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return out.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite)


def matrix(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors in the order of ids, then of vectors; shorter vectors end in zeros."""
    ids = table["vec_id"].to_numpy().astype(np.int64)
    lists = table["vector"].combine_chunks()
    lens = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(ids), width))
    out[np.repeat(np.arange(len(ids)), lens), np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)] = lists.flatten().to_numpy()
    order = np.lexsort((*out.T[::-1], ids))
    return ids[order], out[order]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search(index: DataFrame, queries: DataFrame, k: int, score: str, prepare: Callable[[np.ndarray], Arrays], ask: Callable[[np.ndarray, np.ndarray, np.ndarray, Arrays], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query id the best k of what ask finds for its rows in all shards, ties to the smaller id.

    prepare makes a shard's further arrays of its vectors; ask takes the ids and vectors of queries and a
    shard's ids and arrays (vectors among them), and gives for each query ids and scores.
    Rows are dealt by their place in a written table, so that equal ids, equal vectors and crowded ones
    spread evenly: the index to four shards for each core, of SHARD_ROWS to MOST_ROWS, the
    queries to blocks of about QUERY_ROWS.  Where blocks are fewer than four for each
    core, each is asked of several runs of shards at the same time.
    """
    spark = index.sparkSession
    url = urlparse(shared_dir(spark))
    if url.scheme not in ("", "file"):
        raise ValueError(f"shards are mapped from files: mount the shared folder {url.geturl()} on every node and name it as a file: path")
    folder = f"{url.path}/lodestar/vectors-{uuid.uuid4().hex}"
    Path(folder).mkdir(parents=True)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    index, queries = written(index, "index"), written(queries, "queries")
    (rows, wide), (asked, wide_too) = (df.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first() for df in (index, queries))
    wide, tasks = max(wide, wide_too), 4 * spark.sparkContext.defaultParallelism
    shards = max(1, -(-rows // min(MOST_ROWS, max(SHARD_ROWS, rows // tasks))))
    blocks = max(1, -(-asked // QUERY_ROWS))

    def write(df: DataFrame, parts: int, name: str, more: Callable[[np.ndarray], Arrays]) -> None:
        def one(group: pa.Table) -> pa.Table:
            part = group["part"][0].as_py()
            ids, x = matrix(group, wide)
            dump(Path(folder, f"{name}-{part:08d}"), {"ids": ids, "vectors": x.ravel()} | {n: a.ravel() for n, a in more(x).items()})
            return pa.table({"part": pa.array([part], pa.int32())})

        dealt = df.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int"))
        dealt.groupBy("part").applyInArrow(one, "part int").agg(F.count("*")).collect()

    write(index, shards, "shard", prepare)
    write(queries, blocks, "block", lambda x: {})
    runs = min(shards, max(1, -(-tasks // blocks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for job in (j for b in batches for j in b.column(0).to_pylist()):
            block, turn = divmod(job, runs)
            file = Path(folder, f"block-{block:08d}")
            if not file.exists():  # rows are dealt at random: with few of them a part may have none
                continue
            held = load(file)
            query_ids, q = held["ids"], held["vectors"].reshape(-1, wide)
            found = [(np.zeros(0, np.int64), np.zeros(0))] * len(query_ids)
            for s in range(turn, shards, runs):
                file = Path(folder, f"shard-{s:08d}")
                if file.exists():
                    shard = load(file)
                    more = {n: a.reshape(-1, wide) if n == "vectors" else a for n, a in shard.items() if n != "ids"}
                    for i, (ids, scores) in enumerate(ask(query_ids, q, shard["ids"], more)):
                        ids, scores = np.concatenate([found[i][0], ids]), np.concatenate([found[i][1], scores]) if len(found[i][1]) else scores
                        top = best(ids, scores, k)
                        found[i] = ids[top], scores[top]
            lens = [len(f[0]) for f in found]
            if sum(lens):
                kind = np.int64 if score == "long" else np.float64
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, lens)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([np.asarray(f[1]).astype(kind) for f in found]))], names=["query_id", "vec_id", "score"])

    made = spark.range(0, blocks * runs, 1, min(blocks * runs, 1 << 16)).mapInArrow(run, f"query_id long, vec_id long, score {score}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return made.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
