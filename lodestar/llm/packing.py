"""Harmonic packing of tokenized documents into sequences of fixed length.

Each length class has a reciprocal of the capacity as its upper bound, and a
sequence of class k takes exactly k pieces of lengths up to capacity / k.  A
document is cut into full sequences, then into halves, quarters and so on
(whose classes waste nothing) and a short tail, which goes to the class of the
next larger reciprocal.  Each worker fills its own classes, so that nothing is
shuffled and no worker waits for another; what a worker has left over in open
classes is laid end to end and cut at the capacity, the last stretch into powers
of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm.common import arrow_rows

#: The pattern by which byte-level BPE of this kind splits a text (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space from this length on go to the library: the fast encoder's pattern gives up on longer ones.
LONG_RUN = 1 << 15
_RUNS = re.compile(rf"\s{{{LONG_RUN}}}")
#: Pieces are halved down to this part of the capacity; what is shorter is a tail.
FINEST = 16
#: Documents' ends get this id.
END = 0
#: Bits of a sequence id that count the sequences of one worker's partition.
SEQUENCE_BITS = 40
#: Pieces of an output batch.
OUT_ROWS = 8192


class ByteLevel:
    """Token ids of a byte-level BPE tokenizer file.

    Texts of Latin-1 characters without special strings go through an
    equivalent, faster encoder of the same merges; all others, and all texts if
    the file's merges aren't in the order of their ids, through the library
    that the file belongs to.
    """

    def __init__(self, path: str):
        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(shown[c] for c in t): i for t, i in vocabulary.items() if t not in self.special}
        order = [vocabulary[a + b] for a, b in merges]
        self.fast = tiktoken.Encoding("same", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if order == sorted(order) and len(ranks) == 256 + len(merges) else None

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special) and not (len(text) >= LONG_RUN and _RUNS.search(text)):
            try:
                text.encode("latin-1")
                return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)
            except UnicodeEncodeError:
                pass
            except BaseException as failure:  # what the fast encoder raises isn't an Exception, and has no class to import
                if type(failure).__name__ != "PanicException":
                    raise
        return np.array(self.own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=2)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


def cuts(length: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: full ones, then each halving at most once, then the tail."""
    full, rest = divmod(length, capacity)
    out, size = [capacity] * full, capacity // 2
    while size >= max(1, capacity // FINEST):
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


def class_counts(capacity: int) -> list[int]:
    """The document counts k that classes have: every power of two, and below the finest cut about five in each doubling."""
    ks, k = [], 1
    while k <= capacity:
        ks += [k] if k < FINEST else [k + k * i // 5 for i in range(5)]
        k *= 2
    return [k for k in ks if k <= capacity]


class Packer:
    """One worker's open classes; emits (document, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.counts = class_counts(capacity)
        self.bounds = [-(capacity // k) for k in self.counts]
        self.open: dict[int, list] = defaultdict(list)

    def _close(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, self.next, offset
            offset += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        for n in cuts(len(ids), self.capacity):
            k = self.counts[bisect_right(self.bounds, -n) - 1]
            self.open[k].append((doc, start, ids[start : start + n], len(ids)))
            start += n
            if len(self.open[k]) == k:
                yield from self._close(self.open.pop(k))

    def finish(self) -> Iterator[tuple]:
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open.clear()
        total, at, mine = sum(len(p[2]) for p in left), 0, []
        room = sizes = None
        sizes = iter([self.capacity] * (total // self.capacity) + [1 << b for b in range(self.capacity.bit_length(), -1, -1) if total % self.capacity >> b & 1])
        for doc, start, ids, doc_tokens in left:
            at = 0
            while at < len(ids):
                room = room or next(sizes)
                part = ids[at : at + room]
                mine.append((doc, start + at, part, doc_tokens))
                at, room = at + len(part), room - len(part)
                if not room:
                    yield from self._close(mine)
                    mine = []


def pack(docs: DataFrame, path: str, capacity: int = 1024, keep_ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs -> one row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    A document is its ids by the tokenizer at path, without added special
    tokens, then END; each id lies in exactly one piece, and the pieces of a
    sequence lie gapless from 0 up to capacity (a power of two).  ids_crc32 is
    the unsigned CRC-32 of the piece's ids as little-endian 32-bit words;
    keep_ids adds the ids themselves.  A null or empty text is END alone; null
    and repeated ids keep their rows; an empty table has no pieces; further
    columns are ignored.
    """
    if capacity < FINEST or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two, 16 or more")
    arrow_rows(docs.sparkSession)
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())] + [("ids", pa.list_(pa.int32()))] * keep_ids

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = [[r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows], [zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows], [r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows]]
        cols += [[r[2].astype(np.int32) for r in rows]] * keep_ids
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_level(path).ids
        packer, rows = Packer(capacity, TaskContext.get().partitionId() << SEQUENCE_BITS), []
        end = np.array([END], np.uint32)
        for b in batches:
            for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                rows += packer.add(doc, np.concatenate([encode(t.as_py() or ""), end]))
                if len(rows) >= OUT_ROWS:
                    yield batch(rows)
                    rows = []
        rows += packer.finish()
        if rows:
            yield batch(rows)

    return own.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids)
