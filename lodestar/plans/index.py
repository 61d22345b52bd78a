"""The persistent index: built in committed stretches, resumable, sealed, verified.

An index folder holds index.json, manifest/ and discovery_errors/ (Parquet),
journal.jsonl, rows/model_id=M/start=N/rows.parquet for each committed stretch of
ordinals, and tree/ (Parquet), the digests of stretches and of ranges of them.
A stretch counts only once its line is in the journal, which is written after
its data and seals its file, so that a build may end anywhere and go on from there.
One job encodes, writes, digests and seals many stretches, each in one task and one file;
one job looks at all of them again.
"""

from __future__ import annotations

import json
import os
import platform
import shutil
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from importlib import metadata
from pathlib import Path
from time import perf_counter, time_ns
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lodestar.functions import digests, merkle
from lodestar.functions.checks import positive, require_contiguous
from lodestar.functions.digests import utc_now
from lodestar.functions.paths import require_disjoint
from lodestar.operators.metrics import commit_totals, state_counts
from lodestar.operators.relations import unknown_models
from lodestar.schemas import COMMIT, INDEX_MANIFEST, JOURNAL, MODELS, PENDING
from lodestar.session import Watch, few, materialized, spread
from lodestar.sources import images, lines, tree
from lodestar.sources import stretches as sink
from lodestar.sources.manifest import with_content_hash

FORMAT, VERSION = "lodestar-index", 1
BUILDING, COMPLETE = "BUILDING", "COMPLETE"
MAPPING = "rows by manifest ordinal"
CHECKPOINT_ROWS = 4096
#: Stretches of CHECKPOINT_ROWS that one job encodes, or as many rows in smaller ones: as many as are lost at most if a build ends in the middle.
STRETCHES = 16
#: Libraries whose versions an index names as part of where it comes from.
PACKAGES = ("numpy", "pandas", "pyarrow", "pyspark")
#: What must be the same for an encoder to go on with an index or to search it.
IDENTITY = ("model_id", "name", "revision", "dtype", "weights", "preprocessing", "tokenizer", "policy")
_ROW = "model_id STRING, ordinal BIGINT, state TINYINT, embedding ARRAY<FLOAT>, error_type STRING, message STRING"


@dataclass
class Paths:
    root: Path

    def __post_init__(self):
        self.root = Path(self.root).resolve()
        self.metadata, self.journal = self.root / "index.json", self.root / "journal.jsonl"
        self.manifest, self.errors, self.rows, self.tree = (self.root / n for n in ("manifest", "discovery_errors", "rows", "tree"))

    def stretch(self, model_id: str, start: int) -> Path:
        if model_id not in MODELS:
            raise ValueError(f"unknown model: {model_id}")
        return self.rows / f"model_id={model_id}" / f"start={start}"


@dataclass
class Verified:
    """What a verification found; checks has (check, ok, detail), seconds what a build took for each model."""

    path: Path
    state: str
    image_count: int
    models: dict[str, dict[str, int]]
    metadata: dict[str, Any]
    checks: list[tuple[str, bool, str]]
    seconds: dict[str, float] = field(default_factory=dict)

    def rates(self) -> dict[str, float]:
        """Images a second that each model of a build looked at."""
        return {m: self.image_count / s for m, s in self.seconds.items() if s > 0}


def identity(encoder: images.Encoder) -> dict[str, Any]:
    """What tells an encoder from another: its public facts (weights and the like as digests), and a digest of all else it states about itself.

    An encoder states weights, preprocessing and tokenizer as whatever they are (texts,
    arrays, files' digests, objects): they are compared by content.
    """
    facts = {k: getattr(encoder, k, None) for k in IDENTITY}
    short = {k: v if v is None or isinstance(v, (str, int, float)) else digests.canonical(v) for k, v in facts.items()}
    stated = getattr(encoder, "identity", None)
    return short | {"digest": digests.canonical(stated() if callable(stated) else facts)}


def environment() -> dict[str, Any]:
    """Where an index is built: the machine, Python and the libraries' versions."""
    return {"python": sys.version.split()[0], "platform": platform.platform(), "machine": platform.machine(), "packages": {p: metadata.version(p) for p in PACKAGES}}


def load_metadata(path: str | Path) -> dict[str, Any]:
    meta = json.loads(Path(path).read_text(encoding="utf-8"))
    digests.require_keys(meta, ("format", "version", "state"), "index metadata")
    if (meta["format"], meta["version"]) != (FORMAT, VERSION) or meta["state"] not in (BUILDING, COMPLETE):
        raise ValueError("not an index of a known format, version and state")
    return meta


def read_journal(path: str | Path) -> list[dict[str, Any]]:
    """Commits in order; an unfinished last line is left out, any other bad line fails."""
    data = Path(path).read_bytes()
    lines = data[: data.rfind(b"\n") + 1].decode().splitlines()
    out = []
    for number, line in enumerate(lines, 1):
        try:
            commit = json.loads(line)
        except ValueError as problem:
            raise ValueError(f"journal line {number} isn't JSON") from problem
        if not isinstance(commit, dict):
            raise ValueError(f"journal line {number} isn't an object")
        digests.require_keys(commit, COMMIT.names, f"journal line {number}")
        out.append(commit)
    return out


def cut_unfinished_line(path: str | Path) -> None:
    data = Path(path).read_bytes()
    if not data.endswith(b"\n") and data:
        os.truncate(path, data.rfind(b"\n") + 1)


def new_commits(path: str | Path, offset: int) -> tuple[list[dict[str, Any]], int]:
    """Commits that were added behind offset bytes, and where the journal ends now."""
    with open(path, "rb") as f:
        f.seek(offset)
        data = f.read()
    return [json.loads(line) for line in data.splitlines()], offset + len(data)


def journal(spark: SparkSession, index_path: str | Path) -> DataFrame:
    """The commits as a table (JOURNAL), in no order; a bad line fails with its number, an unfinished last one is left out."""
    paths = Paths(index_path)
    found = lines.parsed(lines.numbered(spark, f"file://{paths.journal}"), JOURNAL)
    if not _ends_well(paths.journal):
        found = found.join(F.broadcast(lines.numbered(spark, f"file://{paths.journal}").agg(F.max("line").alias("last"))), F.col("line") < F.col("last"))
    bad = found.where("problem is not null").orderBy("line").limit(1).collect()
    if bad:
        raise ValueError(f"journal line {bad[0].line} {bad[0].problem}")
    return found.select("row.*").select(*JOURNAL.names)


def _ends_well(path: Path) -> bool:
    """Whether a file is empty or its last line has an end."""
    with open(path, "rb") as f:
        size = f.seek(0, os.SEEK_END)
        f.seek(max(0, size - 1))
        return size == 0 or f.read(1) == b"\n"


def manifest(spark: SparkSession, index_path: str | Path) -> DataFrame:
    return spark.read.schema(INDEX_MANIFEST).parquet(f"file://{Paths(index_path).manifest}")


def rows(spark: SparkSession, index_path: str | Path) -> DataFrame:
    """The committed rows of all models; stretches that the journal doesn't name don't count."""
    return _committed(spark, Paths(index_path)).drop("start")


def _committed(spark: SparkSession, paths: Paths, commits: DataFrame | None = None) -> DataFrame:
    """The rows of commits; without them, of the journal as it is now.

    Tasks are given the commits and read their files: stretches may be many and small, and no folder is listed.
    """
    named = (journal(spark, paths.root) if commits is None else commits).select("model_id", "start").distinct()
    folder, shape = paths.rows, f"{_ROW}, start BIGINT"
    kinds = pa.schema([("model_id", pa.string()), *sink.SCHEMA, ("start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            for model_id, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with pq.ParquetFile(folder / f"model_id={model_id}" / f"start={start}" / sink.FILE) as file:
                    for rows_ in file.iter_batches(sink.BATCH):
                        named_ = {"model_id": pa.repeat(model_id, rows_.num_rows), "start": pa.repeat(pa.scalar(start, pa.int64()), rows_.num_rows)}
                        held.append(pa.RecordBatch.from_pydict(dict(zip(rows_.schema.names, rows_.columns, strict=True)) | named_).select(kinds.names).cast(kinds))
                        if sum(x.num_rows for x in held) >= sink.BATCH:
                            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                            held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return named.repartition(spread(spark)).mapInArrow(run, shape)


_LOOKED = ", found BOOLEAN, size_now BIGINT, file_now STRING, rows_now STRING, odd BIGINT, long BIGINT"


def examined(commits: DataFrame, index_path: str | Path, full: bool) -> DataFrame:
    """commits (JOURNAL) with what the executors find where each one's file should be.

    found and size_now, always; file_now, the digest of its bytes, if full or if its seal has changed;
    rows_now, odd and long, if full: the digest of its rows, and how many vectors aren't finite or of length one.
    """
    rows_folder, names = Paths(index_path).rows, commits.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c in b.to_pylist():
                path = rows_folder / f"model_id={c['model_id']}" / f"start={c['start']}" / sink.FILE
                now = dict.fromkeys(("size_now", "file_now", "rows_now", "odd", "long")) | {"found": path.is_file()}
                if now["found"]:
                    seal = digests.seal(path)
                    now["size_now"] = seal["size"]
                    if full or any(seal[n] != c[n] for n in ("mtime_ns", "ctime_ns", "inode")):
                        now["file_now"] = digests.of_file(path)
                    if full and now["file_now"] == c["file_sha256"]:  # what isn't the file that was sealed may be no Parquet
                        t = sink.tally(path)
                        now |= {"rows_now": t.digest(), "odd": t.odd, "long": t.long}
                out.append(c | now)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    kinds = {"found": pa.bool_(), "file_now": pa.string(), "rows_now": pa.string()}
    arrow = pa.schema([*to_arrow_schema(commits.schema), *((n, kinds.get(n, pa.int64())) for n in ("found", "size_now", "file_now", "rows_now", "odd", "long"))])
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in commits.schema) + _LOOKED
    return commits.repartition(spread(commits.sparkSession)).mapInArrow(run, shape).select(*names, "found", "size_now", "file_now", "rows_now", "odd", "long")


def faulty(looked: DataFrame) -> DataFrame:
    """examined() commits that something is wrong with, with ``fault``."""
    name = F.format_string("rows/model_id=%s/start=%d/" + sink.FILE, "model_id", "start")
    span = F.format_string("%s [%d, %d)", "model_id", "start", "end")
    fault = (
        F.when(~F.col("found"), F.concat(name, F.lit(" is missing")))
        .when(F.col("size_now") != F.col("file_size"), F.concat(F.lit("size mismatch of "), name))
        .when(F.col("file_now") != F.col("file_sha256"), F.concat(F.lit("hash mismatch of "), name))
        .when(F.col("rows_now") != F.col("rows_sha256"), F.concat(F.lit("hash mismatch of rows of "), span))
    )
    return looked.withColumn("fault", fault).where("fault is not null")


def _require_no_fault(looked: DataFrame) -> None:
    bad = faulty(looked).agg(F.min_by("fault", F.struct("model_id", "start")).alias("first"), F.count("*").alias("n")).first()
    if bad.n:
        raise ValueError(bad.first + f" and {bad.n - 1} more" * (bad.n > 1))


def leaves(commits: DataFrame, digest: str = "rows_sha256") -> DataFrame:
    """(model_id, position, digest) of the stretches as leaves of a tree: their places are their numbers among the model's commits."""
    return commits.select("model_id", F.col("sequence").cast("long").alias("position"), F.col(digest).alias("digest"))


def stored_tree(spark: SparkSession, index_path: str | Path) -> DataFrame:
    return spark.read.schema("model_id string, level int, position long, digest string").parquet(f"file://{Paths(index_path).tree}")


def damaged(spark: SparkSession, index_path: str | Path) -> DataFrame:
    """(model_id, start, end) of the ranges of ordinals whose stored rows aren't those that were committed.

    Rows are digested anew into a tree, and the trees compared from the roots down.
    """
    commits = materialized(journal(spark, index_path))
    now = materialized(examined(commits, index_path, True))
    ours = merkle.tree(leaves(now.withColumn("rows_now", F.coalesce("rows_now", F.lit(""))), "rows_now"), ["model_id"])
    other = merkle.differing(ours, stored_tree(spark, index_path), ["model_id"]).where("level = 0")
    return commits.join(other.select("model_id", F.col("position").cast("int").alias("sequence")), ["model_id", "sequence"]).select("model_id", "start", "end")


def verify_part(spark: SparkSession, index_path: str | Path, model_id: str, begin: int, end: int) -> int:
    """Prove the stretches that hold ordinals [begin, end) of a model against the index's root, and return how many they are (there may be none).

    Only their files are read; the rest of the way to the root is the stored tree's, a few digests for each level.
    """
    paths, meta = Paths(index_path), load_metadata(Paths(index_path).metadata)
    own = meta["models"][model_id]
    part = materialized(journal(spark, index_path).where((F.col("model_id") == model_id) & (F.col("start") < end) & (F.col("end") > begin)))
    if part.isEmpty():
        return 0
    looked = materialized(examined(part, index_path, True))
    _require_no_fault(looked)
    nodes = stored_tree(spark, paths.root).where(F.col("model_id") == model_id)
    height = nodes.agg(F.max("level")).first()[0]
    mine = leaves(looked, "rows_now")
    top = merkle.climbed(mine, merkle.proof(nodes, mine, ["model_id"]), ["model_id"], height).collect()
    if [r.digest for r in top] != [own["rows_root"]]:
        raise ValueError(f"rows of {model_id} [{begin}, {end}) don't lead to the root that the index names")
    return part.count()


def commit_stretches(spark: SparkSession, paths: Paths, meta: dict[str, Any], encoded: DataFrame, model_id: str, begin: int, end: int, size: int) -> None:
    """Write rows [begin, end) of a model, which come stretch by stretch of size, one file each; then their lines in the journal, then the metadata.

    The driver only reads the lines that this job added.
    """
    own, before = meta["models"][model_id], paths.journal.stat().st_size
    (paths.rows / f"model_id={model_id}").mkdir(parents=True, exist_ok=True)
    spark.dataSource.register(sink.StretchSink)
    options = {"rows": paths.rows / f"model_id={model_id}", "journal": paths.journal, "model_id": model_id, "begin": begin, "end": end, "size": size, "dimension": own["dimension"] or "", "sequence": own["commits"]}
    encoded.write.format("lodestar_stretches").options(**{k: str(v) for k, v in options.items()}).mode("append").save()
    for c in new_commits(paths.journal, before)[0]:
        own |= {"dimension": c["dimension"], "committed_prefix": c["end"], "commits": c["sequence"] + 1, "valid_count": own["valid_count"] + c["valid_count"], "error_count": own["error_count"] + c["error_count"]}
    meta["updated_at"] = utc_now()
    digests.write_json(paths.metadata, meta)


def require_evidence_unchanged(spark: SparkSession, index_path: str | Path) -> None:
    """Read and hash every file again and compare with the manifest."""
    listed = manifest(spark, index_path)
    now = with_content_hash(listed.select("ordinal", "source_path")).select("ordinal", F.col("sha256").alias("now"))
    changed = listed.join(now, "ordinal").where(~F.col("sha256").eqNullSafe(F.col("now"))).select("source_path").limit(1).collect()
    if changed:
        raise RuntimeError(f"evidence changed since it was listed: {changed[0].source_path}")


def _manifest_digest(spark: SparkSession, paths: Paths) -> tuple[int, str]:
    listed = spark.read.schema(INDEX_MANIFEST).parquet(f"file://{paths.manifest}")
    row = digests.by_ranges(listed, [], F.to_json(F.struct(*INDEX_MANIFEST.names)).cast("binary"), F.col("ordinal")).first()
    return row.rows or 0, row.digest


def start(spark: SparkSession, evidence: str | Path, index_path: str | Path, max_images: int | None = None) -> dict[str, Any]:
    """List the evidence with content hashes into a new index; an unreadable file or an empty evidence ends it."""
    paths, evidence = Paths(index_path), Path(evidence).resolve(strict=True)
    require_disjoint(evidence, paths.root)
    if paths.root.exists() and any(paths.root.iterdir()):
        raise FileExistsError(f"index folder isn't empty: {paths.root}")
    paths.root.mkdir(parents=True, exist_ok=True)
    found, errors = tree.discover(spark, evidence, max_images)
    ranges = found.repartitionByRange(spread(spark), "ordinal").sortWithinPartitions("ordinal")  # a file for each, so that a job reads its own
    with_content_hash(ranges).select(*INDEX_MANIFEST.names).write.parquet(f"file://{paths.manifest}")
    errors.write.parquet(f"file://{paths.errors}")
    count, digest_ = _manifest_digest(spark, paths)
    if not count:
        shutil.rmtree(paths.root)
        raise ValueError("the evidence holds no image of a known type")
    paths.journal.touch()
    model = {"dimension": None, "committed_prefix": 0, "commits": 0, "valid_count": 0, "error_count": 0, "identity": None}
    meta = {
        "format": FORMAT, "version": VERSION, "build_id": os.urandom(16).hex(), "state": BUILDING, "created_at": utc_now(), "updated_at": utc_now(), "completed_at": None,
        "evidence_root": str(evidence), "max_images": max_images, "image_count": count, "manifest_sha256": digest_, "discovery_errors": spark.read.parquet(f"file://{paths.errors}").count(),
        "row_mapping": MAPPING, "journal": None, "models": {m: dict(model) for m in MODELS}, "spark": spark.version, "environment": environment(),
    }
    digests.write_json(paths.metadata, meta)
    return meta


def reopen(spark: SparkSession, evidence: str | Path, index_path: str | Path, max_images: int | None = None) -> dict[str, Any]:
    """The metadata of an unfinished index, checked against what is asked for and what is on disk, before any model is loaded."""
    paths = Paths(index_path)
    if not paths.root.is_dir():
        raise ValueError("resume needs an existing index")
    meta = load_metadata(paths.metadata)
    if meta["state"] != BUILDING:
        raise ValueError("a finished index can't be resumed: it isn't BUILDING")
    if Path(meta["evidence_root"]) != Path(evidence).resolve() or meta["max_images"] != max_images:
        raise ValueError("resume must name the same evidence and max_images")
    count, digest_ = _manifest_digest(spark, paths)
    if count != meta["image_count"]:
        raise ValueError("the manifest has another number of rows than the metadata says")
    if digest_ != meta["manifest_sha256"]:
        raise ValueError("hash mismatch of the manifest")
    cut_unfinished_line(paths.journal)
    commits = materialized(journal(spark, paths.root))
    _require_no_fault(examined(commits, paths.root, True))
    totals = {r.model_id: r for r in commit_totals(commits).collect()}  # a row for each model
    for model, own in meta["models"].items():
        t = totals.get(model)
        if t and not t.chain_ok:
            raise ValueError(f"journal of {model} isn't a chain")
        if own["committed_prefix"] > (t.committed_prefix if t else 0):
            raise ValueError(f"metadata is ahead of the journal for {model}")
        if t:
            own |= {"committed_prefix": t.committed_prefix, "commits": t.commits, "valid_count": t.valid, "error_count": t.errors}
    return meta


def build(spark: SparkSession, evidence: str | Path, index_path: str | Path, factories: dict[str, Callable[[], images.Encoder]], checkpoint_rows: int = CHECKPOINT_ROWS, batch: int = 64, max_images: int | None = None, resume: bool = False, decoder=images.decode, progress: Callable[[str, int, int], None] = lambda phase, done, total: None, stretches: int | None = None) -> Verified:
    """Build or go on building an index, and verify it; progress hears how far a model is, as its stretches are written, and when it is done.

    One job encodes up to stretches stretches of checkpoint_rows (as many as there are cores, as STRETCHES, and as
    make up STRETCHES of CHECKPOINT_ROWS, at least), each with a commit of its own; a task has one, or a run of them if they
    are many.
    """
    if list(factories) != list(MODELS):
        raise ValueError(f"encoders must be given in the order {', '.join(MODELS)}")
    positive("checkpoint_rows", checkpoint_rows), positive("batch", batch)
    at_once = positive("stretches", max(STRETCHES, spark.sparkContext.defaultParallelism, STRETCHES * CHECKPOINT_ROWS // checkpoint_rows) if stretches is None else stretches)
    meta = (reopen if resume else start)(spark, evidence, index_path, max_images)
    paths, listed = Paths(index_path), manifest(spark, index_path)
    seconds: dict[str, float] = {}
    for model, factory in factories.items():
        began, own, now = perf_counter(), meta["models"][model], identity(factory())
        if own["identity"] is not None:
            digests.require_same(own["identity"], now, (*IDENTITY, "digest"))
        own["identity"] = now
        span = checkpoint_rows * at_once
        for begin in range(own["committed_prefix"], meta["image_count"], span):
            end = min(begin + span, meta["image_count"])
            number = -(-(end - begin) // checkpoint_rows)
            tasks = min(number, spread(spark))
            of = F.floor(F.floor((F.col("ordinal") - begin) / checkpoint_rows) * tasks / number).cast("int")
            part = listed.where((F.col("ordinal") >= begin) & (F.col("ordinal") < end)).repartitionById(tasks, of).sortWithinPartitions("ordinal")
            places = [(paths.stretch(model, at) / sink.FILE, min(at + checkpoint_rows, end) - at) for at in range(begin, end, checkpoint_rows)]
            with Watch(_written_since(places, time_ns()), lambda done: progress(f"index-{model}", begin + done, meta["image_count"])):  # noqa: B023 (it ends with the loop's turn)
                commit_stretches(spark, paths, meta, images.encode(part, factory, batch, decoder), model, begin, end, checkpoint_rows)
        if not own["dimension"]:
            raise RuntimeError(f"no image could be decoded for {model}")
        seconds[model] = perf_counter() - began
        progress(f"index-{model}-complete", own["valid_count"] + own["error_count"], meta["image_count"])
    done = finish(spark, index_path)
    done.seconds = seconds
    return done


def _written_since(places: list[tuple[Path, int]], began: int) -> Callable[[], int]:
    """Counts the rows of a job's stretches that are in place: those whose files are newer than the job."""
    done: set[Path] = set()

    def count() -> int:
        for path, _ in places:
            if path not in done and path.is_file() and path.stat().st_mtime_ns >= began:
                done.add(path)
        return sum(rows for path, rows in places if path in done)

    return count


def finish(spark: SparkSession, index_path: str | Path) -> Verified:
    """Check the evidence once more, seal the journal, write the tree of digests, verify everything, and only then call the index complete."""
    paths = Paths(index_path)
    require_evidence_unchanged(spark, index_path)
    meta = load_metadata(paths.metadata)
    meta["journal"] = {"size": paths.journal.stat().st_size, "sha256": digests.of_file(paths.journal), "seal": digests.seal(paths.journal)}
    merkle.tree(leaves(journal(spark, index_path)), ["model_id"]).write.mode("overwrite").parquet(f"file://{paths.tree}")
    for r in merkle.roots(stored_tree(spark, index_path), ["model_id"]).collect():
        meta["models"][r.model_id]["rows_root"] = r.digest
    digests.write_json(paths.metadata, meta)
    verify(spark, index_path, full=True)
    digests.write_json(paths.metadata, meta | {"state": COMPLETE, "completed_at": utc_now(), "updated_at": utc_now()})
    return verify(spark, index_path, require_complete=True)


def verify(spark: SparkSession, index_path: str | Path, full: bool = False, require_complete: bool = False) -> Verified:
    """Check an index in a fixed order and fail at the first fault.

    Always: metadata, manifest, journal, sealed files (hashed again if their
    seal has changed), states and counts.  full also hashes every file and
    replays the journal against the rows, and checks that vectors are finite and of length one.
    """
    paths = Paths(index_path)
    meta = load_metadata(paths.metadata)
    digests.require_keys(meta, ("image_count", "manifest_sha256", "row_mapping", "models"), "index metadata")
    checks: list[tuple[str, bool, str]] = []

    def check(name: str, ok: bool, fault: str) -> None:
        checks.append((name, bool(ok), "" if ok else fault))
        if not ok:
            raise ValueError(fault)

    if require_complete:
        check("complete", meta["state"] == COMPLETE, "a search needs an index that is COMPLETE")
    check("row mapping", meta["row_mapping"] == MAPPING, "rows of this index are ordered in a way that isn't known here")
    check("manifest exists", paths.manifest.is_dir(), "the index has no manifest")
    count, digest_ = _manifest_digest(spark, paths)
    check("manifest rows", count == meta["image_count"], "the manifest has another number of rows than the metadata says")
    check("manifest hash", digest_ == meta["manifest_sha256"], "hash mismatch of the manifest")
    check("manifest ordinals", require_contiguous(manifest(spark, index_path)) == count, "the manifest's ordinals don't end where its rows do")
    commits = materialized(journal(spark, index_path))
    strangers = sorted(r.model_id for r in unknown_models(commits, list(MODELS)).collect())
    check("journal models", not strangers, f"the journal names models that aren't known: {strangers}")
    looked = materialized(examined(commits, index_path, full))
    _require_no_fault(looked)
    checks.append(("sealed files", True, ""))
    held = _committed(spark, paths, commits)
    counts = {r.model_id: r for r in state_counts(held).collect()}
    totals = {r.model_id: r for r in commit_totals(commits).collect()}
    for model, own in meta["models"].items():
        c, t = counts.get(model), totals.get(model)
        valid, errors = (c.valid, c.decode_errors) if c else (0, 0)
        check(f"{model} states", not c or not c.unknown_states, f"{model} has rows in a state that isn't known")
        check(f"{model} valid", own["valid_count"] == valid, f"{model} has another number of valid rows than the metadata says")
        check(f"{model} errors", own["error_count"] == errors, f"{model} has another number of failed rows than the metadata says")
        check(f"{model} chain", not t or t.chain_ok, f"journal of {model} isn't a chain")
        check(f"{model} totals", not t or (t.valid, t.errors, t.committed_prefix) == (valid, errors, own["committed_prefix"]), f"the journal counts other rows of {model} than there are")
        if meta["state"] == COMPLETE:
            check(f"{model} whole", own["committed_prefix"] == count and not (c and c.pending), f"rows of {model} are missing from a COMPLETE index")
    if full:
        now = {r.model_id: r for r in merkle.roots(merkle.tree(leaves(looked, "rows_now"), ["model_id"]), ["model_id"]).collect()}
        for model, own in meta["models"].items():
            check(f"{model} root", "rows_root" not in own or (model in now and now[model].digest == own["rows_root"]), f"rows of {model} have another root than the metadata says")
        good = looked.agg(F.coalesce(F.sum("odd"), F.lit(0)).alias("odd"), F.coalesce(F.sum("long"), F.lit(0)).alias("long")).first()
        check("finite", not good.odd, "a vector isn't finite")
        check("unit length", not good.long, "a vector's length isn't one")
    check("discovery errors", spark.read.parquet(f"file://{paths.errors}").count() == meta["discovery_errors"], "another number of discovery errors than the metadata says")
    if meta["journal"]:
        digests.require_sealed(paths.journal, meta["journal"]["size"], meta["journal"]["sha256"], meta["journal"]["seal"], full, "the journal")
    summary = {m: {"valid": o["valid_count"], "decode_errors": o["error_count"], "pending": count - o["committed_prefix"]} for m, o in meta["models"].items()}
    return Verified(paths.root, meta["state"], count, summary, meta, checks)


def counts(spark: SparkSession, index_path: str | Path) -> DataFrame:
    """(model_id, valid, decode_errors, pending, images, state) of what an index holds."""
    images_ = manifest(spark, index_path).agg(F.count("*").alias("images"))  # one row
    held = state_counts(rows(spark, index_path)).join(F.broadcast(images_))
    left = F.col("images") - F.col("valid") - F.col("decode_errors")
    return held.select("model_id", "valid", "decode_errors", left.alias("pending"), "images", F.lit(load_metadata(Paths(index_path).metadata)["state"]).alias("state"))


def size_bytes(index_path: str | Path) -> int:
    """What the index takes on disk."""
    return sum(p.stat().st_size for p in Paths(index_path).root.rglob("*") if p.is_file())


def pending(spark: SparkSession, index_path: str | Path) -> DataFrame:
    """(model_id, ordinal, state) of what isn't committed yet."""
    return uncommitted(manifest(spark, index_path), rows(spark, index_path))


def uncommitted(listed: DataFrame, committed: DataFrame) -> DataFrame:
    """(model_id, ordinal, state) of the manifest's rows that a model has no committed row for."""
    have = committed.select("model_id", "ordinal")
    models = listed.sparkSession.createDataFrame([(m,) for m in MODELS], "model_id string")
    wanted = listed.select("ordinal").crossJoin(few(models))  # models x images, the rows of an index
    return wanted.join(have, ["model_id", "ordinal"], "left_anti").select("model_id", "ordinal", F.lit(PENDING).cast("byte").alias("state"))
