"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A huge text is encoded in overlapping chunks.  Where the encodings of two
neighbouring chunks both have a token boundary before a space that follows a
non-space, and no piece of the vocabulary can reach across such a place, the
place is a boundary of the whole text's encoding too: the chunks are spliced
there.  An overlap without such a place is widened, and where none is left to
widen, the chunk itself grows, up to the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_rows

#: Bytes of a chunk and of the overlap with which two chunks start.
CHUNK, OVERLAP = 1 << 15, 1 << 8
#: The mark by which pieces show a space.
SPACE = "▁"


class Encoder:
    """A SentencePiece model with the byte length of what each piece stands for."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = np.array([1 if self.model.is_byte(i) else len(p.replace(SPACE, " ").encode()) for i, p in enumerate(pieces)], np.int64)
        #: No piece holds a space after something else, so none reaches across a stable place.
        self.stable = not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def bounds(self, data: bytes, start: int, end: int) -> np.ndarray | None:
        """Ends of the tokens of data[start:end], as places in data; None if pieces and bytes don't correspond."""
        ids = np.array(self.model.encode(data[start:end].decode()), np.int64)
        ends = np.cumsum(self.bytes_of[ids]) + start
        extra = int(ends[-1]) - end if len(ends) else 0
        return ends - extra if extra in (0, 1) else None  # 1: the space that the model puts in front

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        data = text.encode()
        found = self._spliced(data, chunk, overlap) if len(data) > chunk and self.stable else None
        return len(self.model.encode(text)) if found is None else found

    def _spliced(self, data: bytes, chunk: int, overlap: int) -> int | None:
        def cut(at: int) -> int:
            while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
                at -= 1
            return min(at, len(data))

        start, end, done, total = 0, cut(chunk), -1, 0  # a token that is only the space in front ends at 0
        left = self.bounds(data, start, end)
        while end < len(data):
            if left is None:
                return None
            place, width = None, overlap
            while place is None and (begin := cut(end - width)) > max(done, 0):
                stop = cut(begin + max(chunk, 2 * width))
                if (right := self.bounds(data, begin, stop)) is None:
                    return None
                common = np.intersect1d(left[(left > begin) & (left < end)], right[right < end])
                place = next((int(x) for x in common if data[x] == 32 and data[x - 1] != 32), None)
                width *= 2
            if place is None:
                end = cut(start + 2 * (end - start))
                left = self.bounds(data, start, end)
            else:
                total += int(((left > done) & (left <= place)).sum())
                left, start, end, done = right, begin, stop, place
        return None if left is None else total + int((left > done).sum())


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_counts(docs: DataFrame, path: str, limit: int = 4096, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs -> (doc_id, n_bytes, n_tokens, over_limit), one row per row of docs.

    n_tokens is what the SentencePiece model at path gives the whole text,
    without begin or end; over_limit says whether it exceeds limit.  A null
    text counts as empty (0 bytes, 0 tokens); null and repeated ids keep their
    rows; further columns are ignored; nothing is shuffled.  Texts of any length are
    counted whole, long ones chunk by chunk; an empty table gives an empty one.
    """
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            texts = pc.fill_null(b.column("text"), "")
            sizes = pc.binary_length(texts.cast(pa.binary())).cast(pa.int64())
            short = [t if n <= CHUNK else "" for t, n in zip(texts.to_pylist(), sizes.to_pylist(), strict=True)]
            counts = np.array([len(x) for x in own.model.encode(short, num_threads=1)], np.int64)
            for i in np.flatnonzero(sizes.to_numpy(zero_copy_only=False) > CHUNK):
                counts[i] = own.count(texts[int(i)].as_py())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, pa.array(counts), pa.array(counts > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
