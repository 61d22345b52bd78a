"""Searches: rank by each model, fuse, consolidate, report."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from pathlib import Path
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import digests
from lodestar.functions.checks import non_negative, positive
from lodestar.functions.paths import require_outside
from lodestar.functions.queries import Query, frame
from lodestar.operators import similarity
from lodestar.operators.fusion import evaluate, fuse
from lodestar.operators.metrics import bitmaps, covered
from lodestar.operators.ranking import candidate_counts, full_ranking, top_k
from lodestar.schemas import DECODE_ERROR, MODELS, VALID
from lodestar.session import Watch, materialized, spread
from lodestar.sources import images, manifest as manifests, reports, tree

#: Defaults of the command line (fixed values).
TOP_K, RRF, BATCH = 5000, 60, 64
#: What hears how far a search is: phase, done, total.
Progress = Callable[[str, int, int], None]


def _silent(phase: str, done: int, total: int) -> None: ...


@dataclass(frozen=True)
class Settings:
    """What a search keeps and reports."""

    top_k: int = TOP_K
    rrf_constant: int = RRF
    evaluator_top_k: int | None = None
    evaluator_rrf_constant: int | None = None
    display_root: str | None = None

    def __post_init__(self):
        positive("top_k", self.top_k)
        non_negative("rrf_constant", self.rrf_constant)
        if self.evaluator_top_k is not None:
            positive("evaluator_top_k", self.evaluator_top_k)
        if self.evaluator_rrf_constant is not None:
            non_negative("evaluator_rrf_constant", self.evaluator_rrf_constant)


@dataclass
class Frames:
    """A search's results, lazy."""

    ranked: DataFrame
    fused: DataFrame
    evaluated: DataFrame | None
    counts: DataFrame


def rank_and_fuse(index: DataFrame, queries: DataFrame, vectors: DataFrame, settings: Settings) -> Frames:
    """index rows (model_id, ordinal, state, embedding), queries, and their vectors by model -> ranked, fused and evaluated candidates."""
    ranked = top_k(similarity.search(valid_rows(index), vectors, settings.top_k), settings.top_k)
    fused = fuse(ranked, settings.rrf_constant, queries=queries)
    evaluated = None
    if settings.evaluator_top_k is not None:
        constant = RRF if settings.evaluator_rrf_constant is None else settings.evaluator_rrf_constant
        evaluated = evaluate(fused, settings.evaluator_top_k, constant, queries=queries)
    return Frames(ranked, fused, evaluated, candidate_counts(ranked, list(MODELS), queries))


def valid_rows(index: DataFrame) -> DataFrame:
    """(model_id, file_id, embedding) of the rows that a model could look at: only these are searched."""
    return index.where(F.col("state") == VALID).select("model_id", F.col("ordinal").alias("file_id"), "embedding")


def passes(index: DataFrame) -> DataFrame:
    """(model_id, ordinal, status) of what was looked at."""
    status = F.when(F.col("state") == VALID, "processed").when(F.col("state") == DECODE_ERROR, "decode_error")
    return index.select("model_id", "ordinal", status.alias("status")).where("status is not null")


@dataclass
class Outcome:
    """Where a search wrote its reports, and what it counted."""

    frames: Frames
    output: Path
    final_output: Path | None
    rows: int
    final_rows: int
    metrics: dict[str, dict[str, int]]
    seconds: dict[str, float]


def _report(frames: Frames, manifest: DataFrame, queries: DataFrame, names: dict, settings: Settings, output: Path, final_output: Path | None, seconds: dict[str, float]) -> tuple[int, int]:
    stamp, began = reports.utc_now(), perf_counter()
    audit = reports.audit_rows(frames.fused, manifest, queries, names, stamp, settings.display_root)
    rows = reports.write_csv(audit, reports.AUDIT, ["_position", "_query_id", "FinalRank"], output)
    seconds["rrf"] = perf_counter() - began
    if final_output is None:
        return rows, 0
    began = perf_counter()
    constant = RRF if settings.evaluator_rrf_constant is None else settings.evaluator_rrf_constant
    final = reports.final_rows(frames.evaluated, manifest, queries, settings.evaluator_top_k, constant, str(output), stamp, settings.display_root)
    count = reports.write_csv(final, reports.FINAL, ["EvaluatorRank"], final_output)
    seconds["evaluator"] = perf_counter() - began
    return rows, count


def _destinations(output: Path, final_output: Path | None, settings: Settings, taken: Sequence[Path]) -> None:
    if (final_output is None) != (settings.evaluator_top_k is None):
        raise ValueError("a final report and evaluator_top_k must be given together")
    if final_output is not None and Path(final_output).resolve() in {p.resolve() for p in (output, *taken)}:
        raise ValueError("the final report needs a file of its own")


def _encoders(factories: dict[str, Callable[[], images.Encoder]]) -> dict[str, images.Encoder]:
    if list(factories) != list(MODELS):
        raise ValueError(f"encoders must be given in the order {', '.join(MODELS)}")
    made = {m: f() for m, f in factories.items()}
    if any(e.model_id != m for m, e in made.items()):
        raise ValueError("an encoder's model_id doesn't match its key")
    return made


def _vectors(queries: DataFrame, encoders: dict[str, images.Encoder]) -> DataFrame:
    out = None
    for e in encoders.values():
        getattr(e, "load", lambda: None)()
        try:
            own = images.query_vectors(queries, e)
        finally:
            getattr(e, "unload", lambda: None)()
        out = own if out is None else out.unionByName(own)
    return out


def _names(encoders: dict[str, images.Encoder]) -> dict[str, tuple[str, str | None]]:
    return {m: (getattr(e, "name", m), getattr(e, "revision", None)) for m, e in encoders.items()}


def _metrics(index: DataFrame) -> dict[str, dict[str, int]]:
    """Counts of each model and of any, all from the bitmaps of one scan."""
    bits = materialized(bitmaps(passes(index)))
    counts = lambda r: {"processed": r.processed, "decode_errors": r.decode_errors}
    return {r.model_id: counts(r) for r in covered(bits, "model_id").collect()} | {"any": counts(covered(bits).first())}


def direct(spark: SparkSession, evidence: str | Path, output: str | Path, queries: Sequence[Query], factories: dict[str, Callable[[], images.Encoder]], settings: Settings = Settings(), final_output: str | Path | None = None, max_images: int | None = None, batch: int = BATCH, decoder=images.decode, progress: Progress = _silent) -> Outcome:
    """Search a folder tree without an index: discover, encode with each model, rank, fuse, report.

    Next to output lie ``.manifest.jsonl`` and ``.errors.jsonl`` (folders of
    JSON lines).  Nothing is written into the evidence.  progress hears of
    the phases: discovery, each model while its tasks end and when it is done, ranking, reports.
    """
    output, final_output = Path(output), None if final_output is None else Path(final_output)
    listed, problems = (output.with_name(output.name + s) for s in (".manifest.jsonl", ".errors.jsonl"))
    positive("batch", batch)
    _destinations(output, final_output, settings, (listed, problems))
    if settings.evaluator_rrf_constant is not None and final_output is None:
        raise ValueError("evaluator_rrf_constant needs a final report")
    require_outside(evidence, output, final_output)
    encoders, began, seconds = _encoders(factories), perf_counter(), {}
    found, errors = tree.discover(spark, evidence, max_images)
    manifests.write(found.select("ordinal", "relative_path", "source_path"), f"file://{listed.resolve()}", evidence)
    manifest = manifests.read(spark, f"file://{listed.resolve()}")
    total = manifest.count()
    progress("discovery", total, total)
    reports.write_errors(errors, f"file://{problems.resolve()}", "discovery", None)
    asked = frame(spark, queries)
    index = None
    for model in MODELS:  # one model after another: only one is in an executor's memory at a time
        done = images.counter(spark)
        with Watch(lambda: images.counted(done), lambda n: progress(f"encoding-{model}", n, total)):  # noqa: B023 (it ends with the loop's turn)
            own = materialized(images.encode(manifest.repartition(spread(spark)), factories[model], batch, decoder, done))
        failed = own.where(F.col("state") == DECODE_ERROR).join(manifest, "ordinal").select("ordinal", "relative_path", "source_path", "error_type", "message")
        reports.write_errors(failed, f"file://{problems.resolve()}", "decode", model)
        progress(f"encoding-{model}-complete", own.count(), total)
        index = own if index is None else index.unionByName(own)
    seconds["encoding"] = perf_counter() - began
    frames = rank_and_fuse(index, asked, _vectors(asked, encoders), settings)
    frames.ranked = materialized(frames.ranked)
    frames.fused = materialized(fuse(frames.ranked, settings.rrf_constant, queries=asked))
    progress("ranking", len(queries), len(queries))
    rows, final_rows = _report(frames, manifest, asked, _names(encoders), settings, output, final_output, seconds)
    progress("reports", rows + final_rows, rows + final_rows)
    return Outcome(frames, output, final_output, rows, final_rows, _metrics(index), seconds | {"total": perf_counter() - began})


def indexed(spark: SparkSession, index_path: str | Path, output: str | Path, queries: Sequence[Query], factories: dict[str, Callable[[], images.Encoder]], settings: Settings = Settings(), final_output: str | Path | None = None, progress: Progress = _silent) -> Outcome:
    """Search a complete index: no image is read or encoded; progress hears of the phases.  ``<output>.run.json`` records the run and seals its reports."""
    from lodestar.plans import index as indexes

    output, final_output = Path(output), None if final_output is None else Path(final_output)
    run, problems = (output.with_name(output.name + s) for s in (".run.json", ".errors.jsonl"))
    _destinations(output, final_output, settings, (run, problems))
    began, seconds = perf_counter(), {}
    meta = indexes.verify(spark, index_path, require_complete=True).metadata
    for artifact in (output, final_output, run):
        if artifact is not None:
            require_outside(meta["evidence_root"], artifact)
            require_outside(index_path, artifact)
    encoders = _encoders(factories)
    for model, e in encoders.items():
        digests.require_same(meta["models"][model]["identity"], indexes.identity(e), indexes.IDENTITY)
    seconds["index_open"] = perf_counter() - began
    record = {"state": "BUILDING", "index": str(index_path), "build_id": meta["build_id"], "queries": [q.original_query for q in queries], "settings": vars(settings), "started_at": reports.utc_now()}
    digests.write_json(run, record)
    digests.write_atomic(problems, b"")
    asked, then = frame(spark, queries), perf_counter()
    vectors = _vectors(asked, encoders)
    seconds["text_encoding"] = perf_counter() - then
    index, manifest, then = indexes.rows(spark, index_path), indexes.manifest(spark, index_path), perf_counter()
    frames = rank_and_fuse(index, asked, vectors, settings)
    frames.ranked = materialized(frames.ranked)
    frames.fused = materialized(fuse(frames.ranked, settings.rrf_constant, queries=asked))
    seconds["vector_search"] = perf_counter() - then
    progress("ranking", len(queries), len(queries))
    rows, final_rows = _report(frames, manifest, asked, _names(encoders), settings, output, final_output, seconds)
    seconds["total"] = perf_counter() - began
    progress("reports", rows + final_rows, rows + final_rows)
    sealed = {str(p): {"sha256": digests.of_file(p), "seal": digests.seal(p)} for p in (output, final_output) if p is not None}
    digests.write_json(run, record | {"state": "COMPLETE", "completed_at": reports.utc_now(), "reports": sealed, "seconds": seconds, "rows": rows, "final_rows": final_rows})
    return Outcome(frames, output, final_output, rows, final_rows, _metrics(index), seconds)


def all_results(spark: SparkSession, evidence: str | Path, output: str | Path, queries: Sequence[Query], factory: Callable[[], images.Encoder], batch: int = BATCH, display_root: str | None = None, decoder=images.decode, parts: bool = False, progress: Progress = _silent) -> tuple[int, DataFrame]:
    """One model's ranking of every image for every query, without limit or fusion; the number of rows, and they.

    The report is one file that goes through the driver; with parts it is a folder of
    files in order that the executors write.  It fails unless every image
    that could be decoded has a row for each query.
    """
    output = Path(output)
    require_outside(evidence, output)
    encoder = factory()
    if encoder.model_id != next(iter(MODELS)):
        raise ValueError("the full ranking takes the first model only")
    found, _ = tree.discover(spark, evidence)
    manifest, asked = materialized(found.select("ordinal", "relative_path", "source_path")), frame(spark, queries)
    done, total = images.counter(spark), manifest.count()
    with Watch(lambda: images.counted(done), lambda n: progress(f"encoding-{encoder.model_id}", n, total)):
        encoded = materialized(images.encode(manifest.repartition(spread(spark)), factory, batch, decoder, done))
    progress(f"encoding-{encoder.model_id}-complete", encoded.count(), total)
    ranked = full_ranking(similarity.score_pairs(valid_rows(encoded), _vectors(asked, {encoder.model_id: encoder})))
    rows = reports.all_results_rows(ranked, manifest, asked, getattr(encoder, "name", encoder.model_id), getattr(encoder, "revision", None), display_root)
    order, expected = ["_position", "Rank"], expected_rows(encoded, asked)
    if parts:
        reports.write_parts(rows, reports.ALL_RESULTS, order, f"file://{output.resolve()}")
        count = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"file://{output.resolve()}").count()
    else:
        count = reports.write_csv(rows, reports.ALL_RESULTS, order, output)
    if count != expected:
        raise RuntimeError(f"the full ranking has {count} rows, not {expected}")
    progress("reports", count, expected)
    return count, ranked


def expected_rows(index: DataFrame, queries: DataFrame) -> int:
    """How many rows a full ranking has: images that a model looked at, for each query."""
    return index.where(F.col("state") == VALID).count() * queries.count()


def summary(outcome: Outcome) -> str:
    """A few lines for people."""
    counts = [f"  {r.model_id} {r.query_id}: {r.candidates}" for r in outcome.frames.counts.orderBy("query_id", "model_id").collect()]
    return "\n".join([f"{outcome.rows} audit rows in {outcome.output}", f"{outcome.final_rows} final rows in {outcome.final_output}" if outcome.final_output else "no final report", json.dumps(outcome.metrics), *counts, json.dumps({k: round(v, 3) for k, v in outcome.seconds.items()})])
