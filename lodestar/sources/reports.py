"""Reports: their rows as DataFrames, and CSV and JSON files of them."""

from __future__ import annotations

import csv
import io
import json
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.digests import sync, utc_now
from lodestar.functions.paths import display
from lodestar.operators.fusion import model_columns
from lodestar.operators.relations import require_entries
from lodestar.session import BROADCAST_ROWS, few

#: Columns of the three reports, in order (fixed values).
AUDIT = ("FilePath", "OriginalQuery", "MatchedQuery", "SigLIP2Score", "CLIPCos", "SigLIP2Rank", "CLIPRank", "ModelsMatched", "FinalRank", "FusionScore", "SigLIP2Model", "SigLIP2Revision", "CLIPModel", "CLIPRevision", "ScanTimestamp")
FINAL = ("FilePath", "EvaluatorRank", "EvaluatorScore", "StrongQueryCount", "BestOriginalQuery", "BestMatchedQuery", "BestQueryRank", "QueryMatches", "EvaluatorTopK", "EvaluatorRRFConstant", "AuditReport", "ScanTimestamp")
ALL_RESULTS = ("FilePath", "Query", "SigLIP2Score", "Rank", "Model", "Revision")


def audit_rows(fused: DataFrame, manifest: DataFrame, queries: DataFrame, models: dict[str, tuple[str, str | None]], stamp: str, display_root: str | None = None, checked: bool = True) -> DataFrame:
    """The audit report, a row for each fused candidate, with place and rank to sort by.

    models: by model id the name and revision to show.  checked fails on candidates without a manifest row.
    """
    entries = require_entries(manifest, fused) if checked else manifest
    rows = model_columns(fused).drop("position").join(entries.withColumnRenamed("ordinal", "file_id"), "file_id").join(few(queries), "query_id")
    shown = {m: tuple(F.lit(x).cast("string") for x in models.get(m, (None, None))) for m in ("siglip2", "clip")}
    values = (display(F.col("relative_path"), F.col("source_path"), display_root), "original_query", "model_query", "siglip2_score", "clip_cos", "siglip2_rank", "clip_rank", "models_matched", "final_rank", "fusion_score", *shown["siglip2"], *shown["clip"], F.lit(stamp))
    return rows.select(*[(F.col(v) if isinstance(v, str) else v).alias(n) for n, v in zip(AUDIT, values, strict=True)], F.col("position").alias("_position"), F.col("query_id").alias("_query_id"))


def final_rows(evaluated: DataFrame, manifest: DataFrame, queries: DataFrame, top_k: int, rrf_constant: int, audit_report: str, stamp: str, display_root: str | None = None) -> DataFrame:
    """The final report, a row for each evaluated file; QueryMatches is an array of structs."""
    texts = queries.select("query_id", "original_query", "model_query")
    asked = texts.limit(BROADCAST_ROWS + 1).count()
    if asked > BROADCAST_ROWS:
        raise ValueError(f"a final report names the texts of up to {BROADCAST_ROWS} queries")
    lookup = F.broadcast(texts.agg(F.map_from_entries(F.collect_list(F.struct("query_id", F.struct("original_query", "model_query")))).alias("texts")))
    rows = evaluated.join(manifest.withColumnRenamed("ordinal", "file_id"), "file_id").crossJoin(lookup)  # one row, of a checked size
    text = lambda q, n: F.col("texts")[q][n]
    match = lambda x: F.struct(
        x["query_id"].alias("QueryId"), text(x["query_id"], "original_query").alias("OriginalQuery"), text(x["query_id"], "model_query").alias("MatchedQuery"), x["final_rank"].alias("FinalRank"), x["reciprocal_contribution"].alias("ReciprocalContribution")
    )
    best = F.col("best_query_id")
    values = (
        display(F.col("relative_path"), F.col("source_path"), display_root), F.col("evaluator_rank"), F.col("evaluator_score"), F.col("strong_query_count"), text(best, "original_query"), text(best, "model_query"),
        F.col("best_query_rank"), F.transform("query_matches", match), F.lit(top_k), F.lit(rrf_constant), F.lit(audit_report), F.lit(stamp),
    )
    return rows.select(*[v.alias(n) for n, v in zip(FINAL, values, strict=True)])


def all_results_rows(ranked: DataFrame, manifest: DataFrame, queries: DataFrame, model: str, revision: str | None, display_root: str | None = None) -> DataFrame:
    """The full ranking of one model, with place to sort by."""
    rows = ranked.join(manifest.withColumnRenamed("ordinal", "file_id"), "file_id").join(few(queries), "query_id")
    values = (display(F.col("relative_path"), F.col("source_path"), display_root), F.col("original_query"), F.col("score"), F.col("rank"), F.lit(model), F.lit(revision).cast("string"))
    return rows.select(*[v.alias(n) for n, v in zip(ALL_RESULTS, values, strict=True)], F.col("position").alias("_position"))


def _places(n: int) -> Callable:
    return lambda v: "" if v is None else f"{v:.{n}f}"


def _matches(rows) -> str:
    return json.dumps([dict(r) for r in rows], ensure_ascii=False, separators=(",", ":"))


#: How cells are written where str() isn't it (Python's rounding, not Spark's).
FORMATS = {"SigLIP2Score": _places(6), "CLIPCos": _places(6), "FusionScore": _places(12), "EvaluatorScore": _places(12), "QueryMatches": _matches}


def _cell(column: str, value: Any) -> Any:
    return FORMATS[column](value) if column in FORMATS else "" if value is None else value


def write_csv(rows: DataFrame, columns: tuple[str, ...], order: list[str], path: str | Path) -> int:
    """Write a report as one CSV file with a byte order mark, atomically, and return the number of rows.

    Rows are sorted by ranges.  Each task writes its range beside the file; their
    sizes, of which the driver holds one for each task, say where in the file each begins, and tasks copy them there. Only
    then does the file get its name.  So rows never go through the driver; the file's folder must be one that all executors see.
    """
    target = Path(path).resolve()
    parts = Path(tempfile.mkdtemp(dir=target.parent, prefix=f".{target.name}.parts-"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        draft = parts / f"draft-{part}-{os.urandom(4).hex()}"
        with draft.open("w", encoding="utf-8", newline="") as f:
            out = csv.writer(f)
            for b in batches:
                for row in b.to_pylist():
                    out.writerow([_cell(c, row[c]) for c in columns])
                    count += 1
            f.flush()
            os.fsync(f.fileno())
        size = draft.stat().st_size
        os.replace(draft, parts / f"part-{part}")  # whole, also if a task runs twice
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bytes": pa.array([size], pa.int64()), "rows": pa.array([count], pa.int64())})

    try:
        made = sorted(rows.orderBy(*order).select(*columns).mapInArrow(write, "part int, bytes long, rows long").collect())
        text = io.StringIO(newline="")
        csv.writer(text).writerow(columns)
        head = text.getvalue().encode("utf-8-sig")
        starts, at = [], len(head)
        for m in made:
            starts.append((m.part, at))
            at += m.bytes
        whole = parts / "whole"
        with whole.open("wb") as f:
            f.write(head)
            f.truncate(at)
        _copy(rows.sparkSession, parts, whole, starts)
        sync(whole)
        os.replace(whole, target)
        sync(target.parent)
    finally:
        shutil.rmtree(parts, ignore_errors=True)
    return sum(m.rows for m in made)


def _copy(spark: SparkSession, parts: Path, whole: Path, starts: list[tuple[int, int]]) -> None:
    """Have tasks copy each part to its place in the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with (parts / f"part-{part}").open("rb") as source, whole.open("r+b") as out:
                    out.seek(at)
                    shutil.copyfileobj(source, out, 1 << 20)
                    out.flush()
                    os.fsync(out.fileno())
            yield b

    if starts:
        tasks = min(len(starts), 4 * spark.sparkContext.defaultParallelism)
        spark.createDataFrame(starts, "part int, at long").repartition(tasks).mapInArrow(run, "part int, at long").agg(F.count("*")).collect()


def cells(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """What a report shows: columns as texts, numbers with their places (Python's rounding), missing ones empty."""

    def run(batches):
        for pdf in batches:
            for c in columns:
                pdf[c] = [FORMATS.get(c, lambda v: "" if v is None else str(v))(None if v is None or v != v else v) for v in pdf[c]]
            yield pdf

    return rows.select(*columns).mapInPandas(run, ", ".join(f"{c} string" for c in columns))


def write_parts(rows: DataFrame, columns: tuple[str, ...], order: list[str], path: str) -> None:
    """The same cells as a folder of CSV parts in order, written by the executors; for rankings of whole corpora."""
    cells(rows.orderBy(*order), columns).write.option("header", True).option("escape", '"').option("lineSep", "\r\n").option("emptyValue", "").csv(path)


class ErrorJournal:
    """Errors as JSON lines, appended record by record or table by table; it has to be open.

    ``with ErrorJournal(spark, path) as journal: journal.record("decode", "clip", errors)``.  The folder appears when it is
    opened, also if no error follows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.open = spark, path, False

    def __enter__(self) -> ErrorJournal:
        self.open = True
        self._append(self.spark.createDataFrame([], "message string"), None, None)
        return self

    def __exit__(self, *fault: object) -> None:
        self.open = False

    def record(self, phase: str, model_id: str | None, error: Any) -> None:
        """Add errors of a phase: a table of them, one as a mapping, or anything else, of which the text is kept as its message."""
        if isinstance(error, DataFrame):
            rows = error
        elif isinstance(error, Mapping):
            rows = self.spark.createDataFrame([{k: v if v is None or isinstance(v, (int, float, str)) else str(v) for k, v in error.items()}], samplingRatio=1.0) if error else self.spark.range(1).select()
        else:
            rows = self.spark.createDataFrame([(str(error),)], "message string")
        self._append(rows, phase, model_id)

    def _append(self, rows: DataFrame, phase: str | None, model_id: str | None) -> None:
        if not self.open:
            raise RuntimeError("an error journal has to be opened before it is written to")
        rows.withColumn("phase", F.lit(phase).cast("string")).withColumn("model_id", F.lit(model_id).cast("string")).write.mode("append").option("ignoreNullFields", "false").json(self.path)


def write_errors(errors: DataFrame, path: str, phase: str, model_id: str | None) -> None:
    """Append error rows, with the phase and model they come from, as JSON lines; a folder that isn't there yet appears, also without rows."""
    journal = ErrorJournal(errors.sparkSession, path)
    journal.open = True
    journal.record(phase, model_id, errors)
