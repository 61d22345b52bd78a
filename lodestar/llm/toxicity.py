"""Toxicity by subword bags: the worst window of a text decides.

A window (two neighbouring cells of a text's letters) is the mean of its subword
embeddings under a linear softmax with a bias (subword.py).  One toxic sentence in a long text
would drown in the mean of the whole text, so that a text's logit is that of its
worst window; a logistic curve, fitted on labelled rows whose windows aren't
trained on, turns it into a probability.

Only whole texts have labels, so windows are learned in rounds: at first some of each text
carry its label, spread over all of it, then those too which the model of the round before
finds worst.  The executors look through all windows of the sampled texts and
send a bounded number of each; the model is trained on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_rows, release, remainder, written
from lodestar.llm.subword import Bags, Softmax, train
from lodestar.llm.subword import letters as all_letters

#: Half a window: windows are two neighbouring cells of so many bytes.
CELL = 16
#: Sizes of n-grams and bits of the hash.
SIZES, BITS = (3, 6), 20
#: Bound of the training sample: labelled rows of each class.
SAMPLE_ROWS = 2000
#: Windows that a clean and a toxic text send to the first training, from evenly spaced places of all of it.
SPREAD = (16, 32)
#: Windows that a toxic text sends to each later one, of those at least half as bad as its worst, and a clean one's worst.
WORST, CLEAN_WORST = 24, 1
#: Passes over the windows in the last round and in those before, and windows of a step.
LAST, FIRST, BATCH = 4, 1, 128
#: n-grams that a window's mean is taken over at least: a window of a word or two is no surer than one of so many.
LEAST_NGRAMS = 8
#: Rows without any evidence, as a part of the clean ones, that the curve takes for clean: texts of words
#: that training never met must not pass for toxic only because known clean words speak against it.
SILENT = 0.02


_REPEATS = re.compile(rb"( [^ ]+)(?:\1)+(?= )")


def letters(text: str | None) -> bytes:
    """A text's letters, in which a word that is said many times in a row stands once: a window of one word alone would judge by its n-grams and nothing else."""
    return _REPEATS.sub(rb"\1", b" " + all_letters(text) + b" ").strip()


@dataclass
class Toxicity:
    """The window model and the curve (slope, shift) from worst logits to probabilities; model is None if one class only was known."""

    model: Softmax | None
    slope: float = 1.0
    shift: float = 0.0

    def windows(self, data: bytes) -> np.ndarray:
        """By how much each window of letters()' bytes speaks for toxicity: the difference of the softmax's two logits."""
        sums, counts = self.model.cell_sums(data, CELL)
        if len(counts) > 1:
            sums, counts = sums[:-1] + sums[1:], counts[:-1] + counts[1:]
        return (sums[:, 1] - sums[:, 0]) / np.maximum(counts, LEAST_NGRAMS) + (self.model.bias[1] - self.model.bias[0])

    def worst(self, data: bytes) -> float:
        """The largest of windows(); without one, what the bias alone says."""
        found = self.windows(data)
        return float(found.max()) if len(found) else float(self.model.bias[1] - self.model.bias[0])

    def probability(self, logit: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -500, 500))))

    def score(self, text: str | None) -> float:
        return self.shift if self.model is None else self.probability(self.worst(letters(text)))


def window(data: bytes, at: int) -> bytes:
    return data[at * CELL : (at + 2) * CELL]


def spread(data: bytes, most: int) -> list[int]:
    """Up to most places of windows, evenly over data."""
    cells = max(1, -(-len(data) // CELL) - 1)
    return [i * cells // most for i in range(most)] if cells > most else list(range(cells))


def chosen(data: bytes, label: int, model: Toxicity | None) -> tuple[list[int], float]:
    """The places of the windows that a text sends to the next training, and its worst logit so far."""
    if model is None:
        return spread(data, SPREAD[label]), 0.0
    found = model.windows(data)
    if not len(found):
        return [], model.worst(data)
    most, bias = float(found.max()), float(model.model.bias[1] - model.model.bias[0])
    worst = np.argsort(-found, kind="stable")[:WORST]
    evidence = found - bias
    return [int(i) for i in worst if found[i] == most or evidence[i] >= max(evidence.max() / 2, 0)], most


def _curve(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of least log loss (Newton steps, lightly damped)."""
    scale = max(1e-6, float(np.abs(logits - logits.mean()).mean()))
    x = np.stack([(logits - logits.mean()) / scale, np.ones(len(logits))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - labels) + 0.01 * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), grad)
    return float(w[0] / scale), float(w[1] - w[0] * logits.mean() / scale)


def fit(labels: np.ndarray, look, rounds: int = 3, seed: int = 1) -> Toxicity:
    """Train on rows with labels 0 and 1; look(model) gives for each row its chosen() windows as bytes with their logits' places in turn, and its worst logit.

    Every fifth row of each class (all, if one has under 50) fits the curve.
    """
    if len(set(labels.tolist())) < 2:
        return Toxicity(None, shift=float(labels[0]) if len(labels) else 0.0)
    turn = np.zeros(len(labels), np.int64)
    for c in (0, 1):
        turn[labels == c] = np.arange((labels == c).sum())
    held = (turn % 5 == 4) & (min((labels == 0).sum(), (labels == 1).sum()) >= 50)
    first, _ = look(None)
    model, texts, goal = None, [], []
    for turn_no in range(rounds):
        if turn_no == 0:
            own = [(w, labels[i]) for i in np.flatnonzero(~held) for w in first[i]]
        else:
            found, _ = look(Toxicity(model))
            own = [(w, labels[i]) for i in np.flatnonzero(~held & (labels == 1)) for w in found[i]]
            # clean texts' windows stay, and what looked worst of them joins; of toxic ones only what still looks toxic
            texts, goal = [t for t, g in zip(texts, goal, strict=True) if not g], [0 for g in goal if not g]
            own += [(w, 0) for i in np.flatnonzero(~held & (labels == 0)) for w in found[i][:CLEAN_WORST]]
        texts, goal = texts + [w for w, _ in own], goal + [int(g) for _, g in own]
        model = train(Bags.of(texts, SIZES, BITS), np.array(goal), 2, SIZES, BITS, epochs=LAST if turn_no == rounds - 1 else FIRST, batch=BATCH, seed=seed)
    out = Toxicity(model)
    _, worst = look(out)
    check = np.flatnonzero(held) if held.any() else np.arange(len(labels))
    logits = np.array([worst[i] for i in check])
    silent = max(2, int(SILENT * (labels[check] == 0).sum()))
    nothing = float(model.bias[1] - model.bias[0])
    out.slope, out.shift = _curve(np.concatenate([logits, np.full(silent, nothing)]), np.concatenate([labels[check], np.zeros(silent, np.int64)]))
    return out


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Toxicity:
    """Fit on up to sample_rows labelled rows of each class whose crc32(doc_id as text) mod 5 is not 0.

    The labelled ids with the smallest hashes are taken, of rows that share an id
    that with the smallest hash of its text, and all of each text; null ids, labels
    and texts are left out, an id with both labels counts as toxic.
    labels, lang, source and doc_id never enter a score.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(remainder("doc_id", 5) != 0)
    have = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    known = known.join(have.select("doc_id").distinct(), "doc_id", "left_semi")
    first = lambda c: known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # noqa: E731  a heap in each task
    ids = written(first(0).union(first(1)), "sample")
    one = have.join(ids, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.xxhash64("text")).alias("hash"))
    arrow_rows(docs.sparkSession)

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array([letters(t.as_py()) for t in b.column("text")], pa.binary())], names=["doc_id", "toxic", "data"])

    kept = have.withColumn("hash", F.xxhash64("text")).join(written(one, "chosen"), ["doc_id", "hash"]).dropDuplicates(["doc_id"])
    rows = written(kept.select("doc_id", "toxic", "text").mapInArrow(prepared, "doc_id long, toxic int, data binary"), "texts")
    order = sorted((r.doc_id, r.toxic) for r in rows.select("doc_id", "toxic").collect())  # two samples' rows
    place = {i: n for n, (i, _) in enumerate(order)}

    def look(model: Toxicity | None) -> tuple[list[list[bytes]], list[float]]:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = []
                for i, label, data in zip(b.column("doc_id").to_pylist(), b.column("toxic").to_pylist(), b.column("data"), strict=True):
                    data = data.as_py()
                    places, worst = chosen(data, label, shared.value)
                    found.append((i, [window(data, p) for p in places], worst))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.binary())), pa.array([f[2] for f in found], pa.float64())], names=["doc_id", "windows", "worst"])

        windows, worst = [[] for _ in order], [0.0] * len(order)
        for r in rows.mapInArrow(run, "doc_id long, windows array<binary>, worst double").toArrow().to_pylist():
            windows[place[r["doc_id"]]], worst[place[r["doc_id"]]] = r["windows"], r["worst"]
        shared.unpersist()
        return windows, worst

    model = fit(np.array([t for _, t in order], np.int64), look)
    release(docs.sparkSession)
    return model


def with_scores(docs: DataFrame, model: Toxicity, column: str, text: str = "text") -> DataFrame:
    """docs with a double column of scores (0 to 1) of whole texts, of any length; null and empty texts are scored as having no window."""
    arrow_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([shared.value.score(t.as_py()) for t in b.column(text)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, column])

    return docs.mapInArrow(run, docs.withColumn(column, F.lit(0.0)).schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, labels (doc_id, toxic) -> (doc_id, held_out, score, predicted), one row per row of docs.

    held_out marks the rows whose crc32(doc_id as text) mod 5 is 0; their labels
    aren't learned from.  predicted is 1 from a score of 0.5.  Without labelled
    rows every score is 0, with one class only it is that class; null texts
    count as empty, null ids aren't held out, further columns are ignored.
    """
    own = docs.select("doc_id", "text")
    scored = with_scores(own, learn(own, labels), "score")
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
