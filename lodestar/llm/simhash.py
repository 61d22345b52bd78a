"""SimHash near-duplicates, linked through fuzzy hashing with the binary Golay code.

A fingerprint of 64 bits is cut into three segments.  If two fingerprints
differ in at most two bits, one of the segments is free of errors
(pigeonhole) and the next one has at most two.  The perfect Golay code (23, 12)
turns "at most two errors" into equality: a word of 23 bits lies within
distance four of one codeword (if its coset leader has weight below three) or
of six, and two words at distance two or less always share one of these
codewords.  So each fingerprint has at most 3 x 6 keys (error-free segment,
codeword index of its neighbour), every link shares a key, and an equality join
finds it.

Keys that many different fingerprints share are not expanded into pairs.
Their members are linked through their one-bit neighbours instead: fingerprints
differ in two bits or less exactly if they have a word in common that is within
one bit of both, and no word is within one bit of more than 65 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_rows, spread, written
from lodestar.llm.components import components

#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
#: First bit and width of the three segments; each fits a Golay word of 23 bits.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Distinct fingerprints of a key up to which its pairs are compared one by one.
PAIRS_UP_TO = 32


# ---------------------------------------------------------------- fingerprints

#: Row v spreads the eight bits of v over the eight byte lanes of a 64-bit word.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
#: Lanes of a byte overflow after this many additions.
_LANE_ROWS = 255


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 (seed 42) of every shingle of width words, repeats included.

    A-Z are lower-cased, words are runs without ASCII white space, joined by a
    space.  Fewer words than width make one shingle; none, or null, make none.
    """
    words = (text or "").encode().lower().split()
    if len(words) < 2 or len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends)]
    return [hashed(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :], strict=False)]


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set; blocks bound the memory whatever their number."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        lanes = _LANES[hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), _LANE_ROWS), axis=0)
        total += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash: a bit is set if it is set in over half of the shingles' hashes; zero without words."""
    return majority(np.array(shingle_hashes(text, width), dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    return int(np.packbits(2 * _bit_counts(hashes) > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text") -> DataFrame:
    """docs with a column ``fingerprint`` (long, the 64 bits) and without ``text``; nothing is shuffled."""
    arrow_rows(docs.sparkSession)
    rest = [f for f in docs.schema if f.name != text and f.name != "fingerprint"]
    schema = docs.select(*[f"`{f.name}`" for f in rest]).withColumn("fingerprint", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array(np.array([fingerprint(t, width) for t in b.column(text).to_pylist()], dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), found], names=[*(f.name for f in rest), "fingerprint"])

    return docs.select(*[f"`{f.name}`" for f in rest], f"`{text}`").mapInArrow(run, schema)


# ------------------------------------------------------------------ Golay keys


def _syndrome(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GOLAY << (bit - 11)
    return word


@lru_cache(maxsize=1)
def _golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits of a word, and the error patterns of each syndrome.

    Column 0 has the coset leader (weight three at most), columns 1 to 5 the
    patterns of weight four; where the leader is lighter they repeat it.
    """
    low = np.array([_syndrome(v) for v in range(1 << 12)], np.int64)
    high = np.array([_syndrome(v << 12) for v in range(1 << 11)], np.int64)
    patterns = np.full((1 << 11, 6), -1, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            row = patterns[_syndrome(error)]
            free = np.flatnonzero(row < 0)
            if weight < 4 or row[0] >= 0 and bin(row[0]).count("1") == 3:
                row[free[0]] = error
    return low, high, np.where(patterns < 0, patterns[:, :1], patterns)


def golay_indices(words: np.ndarray) -> np.ndarray:
    """For each word of 23 bits, the 12-bit indices of the codewords within distance four: six columns, repeats possible."""
    low, high, patterns = _golay_tables()
    words = words.astype(np.int64)
    return (words[:, None] ^ patterns[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def fuzzy_keys(prints: np.ndarray) -> np.ndarray:
    """Of each fingerprint the 18 keys (segment without errors, codeword index of the next segment)."""
    prints = prints.view(np.uint64)
    parts = [(prints >> np.uint64(a)).astype(np.int64) & ((1 << w) - 1) for a, w in SEGMENTS]
    return np.concatenate([(parts[i][:, None] << 14) | (golay_indices(parts[(i + 1) % 3]) << 2) | i for i in range(3)], axis=1)


def _keyed(distinct: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = b.column("fp").to_numpy(zero_copy_only=False)
            if len(prints):
                keys = np.sort(fuzzy_keys(prints), axis=1)
                new = np.concatenate([np.ones((len(keys), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(prints, new.sum(axis=1))), pa.array(keys[new])], names=["fp", "key"])

    return distinct.mapInArrow(run, "fp long, key long")


# ----------------------------------------------------------------------- links


def links(distinct: DataFrame) -> DataFrame:
    """distinct (fp long, no repeats) -> (u, v): links that join exactly the fingerprints which paths of steps of two bits or less connect.

    Keys with up to PAIRS_UP_TO fingerprints give each verified pair; of larger
    ones each fingerprint is linked to the least one that shares a one-bit
    neighbour with it.  The work is linear in the fingerprints either way.
    """
    keyed = written(_keyed(distinct), "keys")
    sizes = keyed.groupBy("key").count()
    small = keyed.join(sizes.where(f"count between 2 and {PAIRS_UP_TO}").select("key"), "key")
    other = small.select("key", F.col("fp").alias("v"))
    pairs = small.select("key", F.col("fp").alias("u")).join(other, "key").where("u < v and bit_count(u ^ v) <= 2").select("u", "v")
    crowded = keyed.join(sizes.where(f"count > {PAIRS_UP_TO}").select("key"), "key").select("fp").distinct()
    near = crowded.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("word"))
    least = near.groupBy("word").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("word", "v")
    stars = near.join(least, "word").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs -> (doc_id, fingerprint string, component_id): one row per document, in components of linked fingerprints.

    Fingerprints (of shingles of width words) link at two or fewer differing
    bits; component_id is the smallest doc_id that links reach.  Copies share a
    fingerprint and are never paired.  Null and blank texts have fingerprint
    zero and link like any other; null ids keep their row and are no component's
    smallest; repeated ids keep all their rows; further columns are ignored.
    """
    prints = written(fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), width), "prints")
    distinct = prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    roots = components(links(distinct.select("fp")))
    joined = distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    owners = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    owned = joined.join(owners, "root").select(F.col("fp").alias("fingerprint"), "n", "component_id")
    return spread(prints, owned, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
