"""The index's rows as a sink: executors write, digest and seal a file for each stretch, and a commit adds lines to the journal.

``lodestar_stretches`` takes rows in the order of ordinals, dealt so that a task has whole stretches.
A task writes each stretch to a draft, has it reach the disk and renames it.  A task that
fails leaves no draft behind; a file of a stretch that was never committed is written over by the next build.
The driver's part is one line of the journal for each stretch, from what the tasks say.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lodestar.functions import digests
from lodestar.functions.checks import UNIT
from lodestar.schemas import DECODE_ERROR, VALID

FILE = "rows.parquet"
#: Rows that a task reads at a time.
BATCH = 4096
#: Bytes of rows that a task holds before they go to the file.
GROUP_BYTES = 32 << 20
SCHEMA = pa.schema([("ordinal", pa.int64()), ("state", pa.int8()), ("embedding", pa.list_(pa.float32())), ("error_type", pa.string()), ("message", pa.string())])


class Tally:
    """What a stretch's rows come to, batch by batch, however they are cut into batches."""

    def __init__(self):
        self.parts = [hashlib.sha256() for _ in range(4)]
        self.rows = self.valid = self.errors = self.odd = self.long = 0
        self.lowest = self.highest = None
        self.ordered, self.dimensions = True, set()

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        ordinals, states = batch.column("ordinal").to_numpy(zero_copy_only=False), batch.column("state").to_numpy(zero_copy_only=False)
        vectors = batch.column("embedding")
        sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f4", copy=False)
        for part, values in zip(self.parts, (ordinals.astype("<i8"), states.astype("<i1"), sizes.astype("<i4"), flat), strict=True):
            part.update(np.ascontiguousarray(values).data)
        steps = np.diff(ordinals) if self.highest is None else np.diff(np.concatenate([[self.highest], ordinals]))
        self.ordered = self.ordered and bool((steps == 1).all())
        self.lowest, self.highest = int(ordinals[0]) if self.lowest is None else self.lowest, int(ordinals[-1])
        self.rows, self.valid, self.errors = self.rows + len(states), self.valid + int((states == VALID).sum()), self.errors + int((states == DECODE_ERROR).sum())
        self.dimensions |= set(np.unique(sizes[sizes >= 0]).tolist())
        held = sizes[sizes > 0]
        if len(held):
            finite = np.isfinite(flat)
            starts = np.cumsum(held) - held
            ok = np.logical_and.reduceat(finite, starts)
            norms = np.sqrt(np.add.reduceat(np.where(finite, flat, 0).astype(np.float64) ** 2, starts))
            self.odd += int((~ok).sum())
            self.long += int((ok & (np.abs(norms - 1) > UNIT)).sum())

    def digest(self) -> str:
        return hashlib.sha256(b"".join(p.digest() for p in self.parts)).hexdigest()


def tally(path: str | Path) -> Tally:
    """A stored stretch, read again."""
    out = Tally()
    with pq.ParquetFile(path) as file:
        for batch in file.iter_batches(BATCH):
            out.add(batch)
    return out


@dataclass
class Stretches(WriterCommitMessage):
    """A task's stretches, as lines of the journal to be."""

    lines: list[dict]


class StretchSink(DataSource):
    """``lodestar_stretches``: options rows (folder of a model's stretches), journal, model_id, begin, end, size, dimension and sequence (of the first stretch)."""

    @classmethod
    def name(cls) -> str:
        return "lodestar_stretches"

    def writer(self, schema, overwrite: bool) -> StretchWriter:
        return StretchWriter(dict(self.options))


class StretchWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.rows, self.journal, self.model_id = Path(options["rows"]), Path(options["journal"]), options["model_id"]
        self.begin, self.end, self.size, self.sequence = (int(options[n]) for n in ("begin", "end", "size", "sequence"))
        self.dimension = int(options["dimension"]) if options.get("dimension") else None

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Stretches:
        lines: list[dict] = []
        now: _Draft | None = None
        try:
            for batch in iterator:
                rows = pa.Table.from_batches([batch]).select(SCHEMA.names).cast(SCHEMA).to_batches()[0] if batch.num_rows else batch
                at = 0
                while at < rows.num_rows:
                    start = self.begin + (rows.column("ordinal")[at].as_py() - self.begin) // self.size * self.size
                    upto = at + int(np.searchsorted(rows.column("ordinal").to_numpy()[at:], start + self.size))
                    if now is None or now.start != start:
                        lines += [now.finish()] if now else []
                        now = None
                        now = _Draft(self.rows / f"start={start}", start, min(start + self.size, self.end))
                    now.add(rows.slice(at, upto - at))
                    at = upto
            lines += [now.finish()] if now else []
            now = None
        finally:
            if now is not None:
                now.drop()
        return Stretches(lines)

    def commit(self, messages: list[Stretches | None]) -> None:
        """Append a line for each stretch, in order; fails, and adds none, if one isn't whole."""
        lines = sorted((line for m in messages if m is not None for line in m.lines), key=lambda line: line["start"])
        if [line["start"] for line in lines] != list(range(self.begin, self.end, self.size)):
            raise RuntimeError(f"encoder returned other rows than asked for: {self.model_id} [{self.begin}, {self.end})")
        sizes = {d for line in lines for d in line.pop("dimensions") if d > 0} | ({self.dimension} if self.dimension else set())
        if len(sizes) > 1:
            raise RuntimeError(f"embeddings of {self.model_id} have several dimensions: {sorted(sizes)}")
        for i, line in enumerate(lines):
            if not line.pop("whole"):
                raise RuntimeError(f"encoder returned other rows than asked for: {self.model_id} [{line['start']}, {line['end']})")
            line |= {"sequence": self.sequence + i, "model_id": self.model_id, "dimension": next(iter(sizes), None), "committed_at": digests.utc_now()}
        digests.sync(self.rows)
        with open(self.journal, "ab") as f:
            f.write(b"".join(json.dumps(line, sort_keys=True, separators=(",", ":")).encode() + b"\n" for line in lines))
            f.flush()
            os.fsync(f.fileno())

    def abort(self, messages: list[Stretches | None]) -> None:
        """Nothing is in the journal, so that nothing counts: files that other tasks have finished are written over by the next build."""


class _Draft:
    """A stretch being written, beside the place where it will lie."""

    def __init__(self, folder: Path, start: int, end: int):
        folder.mkdir(parents=True, exist_ok=True)
        self.folder, self.start, self.end, self.tally = folder, start, end, Tally()
        self.path = folder / f".{FILE}.{os.getpid()}-{os.urandom(4).hex()}"
        self.out = pq.ParquetWriter(self.path, SCHEMA, compression="zstd")
        self.waiting: list[pa.RecordBatch] = []

    def add(self, batch: pa.RecordBatch) -> None:
        self.tally.add(batch)
        self.waiting.append(batch)
        if sum(b.nbytes for b in self.waiting) > GROUP_BYTES:
            self._write()

    def _write(self) -> None:
        """What waits becomes a row group."""
        if self.waiting:
            self.out.write_table(pa.Table.from_batches(self.waiting))
        self.waiting = []

    def finish(self) -> dict:
        self._write()
        self.out.close()
        digests.sync(self.path)
        sha, done, t = digests.of_file(self.path), self.folder / FILE, self.tally
        os.replace(self.path, done)
        digests.sync(self.folder)
        whole = t.ordered and (t.lowest, t.highest) == (self.start, self.end - 1) and t.valid + t.errors == t.rows
        seal = digests.seal(done)
        return {"start": self.start, "end": self.end, "valid_count": t.valid, "error_count": t.errors, "rows_sha256": t.digest(), "file_size": seal.pop("size"), "file_sha256": sha, **seal, "whole": whole, "dimensions": sorted(t.dimensions)}

    def drop(self) -> None:
        self.out.close()
        self.path.unlink(missing_ok=True)
