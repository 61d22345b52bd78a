"""Language identification by averaged subword embeddings, with calibrated rejection.

The mean embedding of a whole text's byte n-grams goes through a linear softmax
(subword.py).  A temperature, fitted on rows kept out of training, makes the
probabilities honest, and the same rows set the floor below which a filter
rejects a text.

Training takes a bounded sample of rows, and whole texts of these: executors turn
each into a few bags of n-grams, whose size has a bound whatever the text's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_rows, release, remainder, written
from lodestar.llm.subword import Bags, Softmax, bag, letters, softmax, train
from lodestar.session import few

#: Sizes of n-grams and bits of the hash.
SIZES, BITS = (1, 4), 16
#: Bound of the training sample: rows of each language.
SAMPLE_ROWS = 400
#: Bytes of n-gram bags that the training sample may have, shared evenly by the languages; each has one row at least.
SAMPLE_BYTES = 64 << 20
#: Languages that a table of logits may have (2^BITS rows of as many floats go to each worker); more are refused.
MOST_LANGUAGES = 256
#: A sampled text's stretches of UNIT bytes are dealt to UNITS bags in turn, the training's units.
UNIT, UNITS = 192, 4
#: Bytes of a text's beginning that are a unit as well, for texts of a few words.
BEGINNING = 24
#: Stretches in which a text's n-grams are summed.
CELL = 1 << 12
#: Prediction for a null text or one without a letter.
UNKNOWN = "und"
#: Share of right predictions that the floor may reject.
REJECTED = 0.001


@dataclass
class Language:
    """Languages in the order of the model's classes; model is None if there was nothing to learn from."""

    model: Softmax | None
    names: list[str] = field(default_factory=list)
    heat: float = 1.0
    floor: float = 0.0

    def logits(self, data: bytes) -> np.ndarray:
        sums, counts = self.model.cell_sums(b" " + data, CELL)
        return sums.sum(axis=0) / max(counts.sum(), 1) + self.model.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        data = letters(text)
        if self.model is None or not data or not (any(97 <= b <= 122 for b in data[:64]) or any(c.isalpha() for c in text)):
            return UNKNOWN, 0.0
        shares = softmax(self.logits(data)[None] / self.heat)[0]
        best = int(shares.argmax())
        return self.names[best], float(shares[best])


def _heat(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss among a fixed ladder of them."""
    ladder = np.geomspace(0.05, 20, 121)
    rows = np.arange(len(labels))
    return float(min(ladder, key=lambda t: -np.log(softmax(logits / t)[rows, labels] + 1e-12).mean()))


def units(data: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bags of a text (from letters()): all of its bytes dealt to UNITS of them, and last its beginning alone."""
    cells = [data[i : i + UNIT] for i in range(0, len(data), UNIT)]
    dealt = [bag(b" ".join(cells[i::UNITS]), SIZES, BITS) for i in range(min(UNITS, len(cells)))]
    return [*dealt, bag(data[:BEGINNING], SIZES, BITS)]


def fit(rows: list[tuple[str, list[tuple[np.ndarray, np.ndarray]]]], seed: int = 1) -> Language:
    """Train on rows (language, units() of the text); every fifth of each language calibrates."""
    names = sorted({x for x, _ in rows})
    if not names:
        return Language(None)
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} languages are more than MOST_LANGUAGES, {MOST_LANGUAGES}")
    place = {x: i for i, x in enumerate(names)}
    labels = np.array([place[x] for x, _ in rows], np.int64)
    turn = np.zeros(len(labels), np.int64)
    for c in range(len(names)):
        turn[labels == c] = np.arange((labels == c).sum())
    held = turn % 5 == 4
    learned = [(label, u) for (_, own), label, out in zip(rows, labels, held, strict=True) if not out for u in own]
    model = train(Bags.join([u for _, u in learned]), np.array([x for x, _ in learned]), len(names), SIZES, BITS, epochs=4, seed=seed)
    out = Language(model, names)
    if held.any():
        whole = Bags.join([tuple(np.concatenate(x) for x in zip(*rows[i][1][:-1], strict=True)) for i in np.flatnonzero(held)])
        logits = model.logits(whole)
        out.heat = _heat(logits, labels[held])
        shares = softmax(logits / out.heat)
        right = shares.max(axis=1)[shares.argmax(axis=1) == labels[held]]
        out.floor = min(0.5, float(np.quantile(right, REJECTED))) if len(right) else 0.0
    return out


def sampled(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(lang, hash, unit, buckets, counts): the bags that a training learns from, of up to sample_rows rows of each language.

    The rows with the smallest hashes of id and text are taken, and all of their texts, as
    long as a language's bags stay within its share of sample_bytes; the first row is always taken. So what comes back
    has sample_bytes at most and the bags of one row (1.6 MB, whatever its length) for each language.
    """
    arrow_rows(docs.sparkSession)
    usable = docs.where("doc_id is not null and lang is not null and text is not null").select("doc_id", "lang", "text").where(remainder("doc_id", 5) != 0)
    hashed = usable.withColumn("hash", F.xxhash64("doc_id", "text"))
    keys = hashed.select("lang", "hash").distinct()
    # about twice the rows wanted by their hashes alone, so that no task has all rows of a language
    sizes = written(keys.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    if (several := sizes.limit(MOST_LANGUAGES + 1).count()) > MOST_LANGUAGES:
        raise ValueError(f"{several} languages or more are beyond MOST_LANGUAGES, {MOST_LANGUAGES}")
    near = keys.join(few(sizes), "lang").where(F.shiftrightunsigned("hash", 32) / float(1 << 32) * F.col("n") < 2 * sample_rows + 64)
    by_hash = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("hash", 1), "hash")
    keys = near.withColumn("turn", F.row_number().over(by_hash)).where(F.col("turn") <= sample_rows).select("lang", "hash")
    rows = hashed.join(written(keys, "sample"), ["lang", "hash"], "left_semi").dropDuplicates(["lang", "hash"])

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, h, t in zip(b.column("lang").to_pylist(), b.column("hash").to_pylist(), b.column("text"), strict=True):
                if data := letters(t.as_py()):
                    one = [(lang, h, i, x.astype("<u2").tobytes(), n.astype("<u4").tobytes()) for i, (x, n) in enumerate(units(data))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*one, strict=True)], names=["lang", "hash", "unit", "buckets", "counts"])

    made = written(rows.mapInArrow(bags, "lang string, hash long, unit long, buckets binary, counts binary"), "bags")
    texts = made.groupBy("lang", "hash").agg(F.sum(F.length("buckets") + F.length("counts")).alias("bytes"))
    so_far = texts.withColumn("turn", F.row_number().over(by_hash)).withColumn("bytes", F.sum("bytes").over(by_hash))  # sample_rows rows of a language at most
    kept = so_far.where((F.col("turn") == 1) | (F.col("bytes") <= sample_bytes // max(several, 1))).select("lang", "hash")
    return made.join(few(written(kept, "kept")), ["lang", "hash"], "left_semi")


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Language:
    """Fit on up to sample_rows rows of each language whose crc32(doc_id as text) mod 5 is not 0, of sample_bytes together (see sampled()).

    Rows that are the same count once; null ids, languages and texts,
    and texts without a letter, are left out.  lang, source and doc_id
    never enter a prediction.
    """
    found = sampled(docs, sample_rows, sample_bytes).toArrow().to_pylist()  # of a bounded size: see there
    found.sort(key=lambda r: (r["hash"], r["lang"], r["unit"]))
    texts: dict = {}
    for r in found:
        texts.setdefault((r["lang"], r["hash"]), []).append((np.frombuffer(r["buckets"], "<u2"), np.frombuffer(r["counts"], "<u4")))
    model = fit([(lang, own) for (lang, _), own in texts.items()])
    del found, texts
    release(docs.sparkSession)
    return model


def with_predictions(docs: DataFrame, model: Language, names: tuple[str, str], text: str = "text") -> DataFrame:
    """docs with two columns: the predicted language of the whole text, of any length (UNKNOWN without a letter), and its probability (then 0)."""
    arrow_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.predict(t) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, docs.withColumns({names[0]: F.lit(""), names[1]: F.lit(0.0)}).schema)


def languages(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) -> (doc_id, held_out, lang_pred, score), one row per row of docs.

    held_out marks the rows whose crc32(doc_id as text) mod 5 is 0, which
    nothing is learned from.  Texts that are null or without a letter are
    UNKNOWN with score 0, as are all if no row can be learned from.  Of languages
    with equal probability the first by name is told.  Null ids
    keep their rows and aren't held out; further columns are ignored.
    """
    found = with_predictions(docs.select("doc_id", "text"), learn(docs), ("lang_pred", "score"))
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
