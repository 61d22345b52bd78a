"""Language-model scores from an Elias-Fano n-gram trie of three orders.

Words are known by 63-bit hashes.  The first level is the sorted sequence of
them, cut into shards by their highest bits; a word's place in it, from 1, is its id.

All longer n-grams come from one pass: each token begins a triple (the two tokens that
follow; 0 stands for what lies beyond the text's end).  Sorted triples hold
the sorted pairs, and the counts of both.  Each block of texts sorts and adds up its own
triples, so that what is shuffled is one compressed run of them for a block and
a shard.  Shards are stretches of that order between split keys, which come
from a sample of all triples: a pair that much of the corpus begins with is cut like any other.

A shard holds its pairs context by context, and its triples likewise, each as one
rising sequence: context number x stride + word.  To look an n-gram up is a
successor search for its word relative to its context.  Monotone pointers say where
the followers of a context begin, and so how many there are, which
sets the weight left to the lower order.  Discounted probabilities are kept as
16-bit fixed-point logarithms.

Each task writes its shard as a file in the shared folder, and scoring workers map
the files: pages that are touched are read, nothing is copied to the driver, and a
lost executor's tasks write the same files again.
"""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_rows, remainder, shared_dir, written
from lodestar.llm.elias_fano import EliasFano, Mapped, dump, load

#: Bytes whose hashes are summed up in one go; a longer word is hashed in stretches of so many.
TEXT_BYTES = 1 << 18
#: Tokens that a worker looks at together, from whole texts as far as they fit; twice as many at most.
BLOCK_TOKENS = 1_000_000
#: Words of a vocabulary's shard, and triples of a shard (as blocks count them) that split keys aim at.
SHARD_WORDS, SHARD_GRAMS = 1 << 20, 1 << 20
#: Split keys come from one in SAMPLED_TEXTS of the texts, and from so many of their triples that a shard has SAMPLES of them.
SAMPLED_TEXTS, SAMPLES = 16, 16
#: What absolute discounting takes from each count.
DISCOUNT = 0.75
#: Fixed-point steps of a logarithm to base 10.
STEPS = 4096
#: The hash of a text's end.
END = 1

_U = np.uint64
#: Odd multiplier of the words' polynomial hash, its inverse modulo 2^64, and the final mixing factor.
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_MIX = _U(0xD6E8FEB86659FD93)
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
#: What a byte adds: one more than itself, A-Z lower-cased.
_LOWER = np.array([b + 33 if 65 <= b <= 90 else b + 1 for b in range(256)], _U)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def of(p: int) -> np.ndarray:
        out = np.full(size, p, _U)
        out[0] = 1
        return np.cumprod(out, dtype=_U)

    return of(_P), of(_P_INVERSE)


def _polynomials(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each word (a stretch of buffer) the sum of its bytes times rising powers, modulo 2^64."""
    out = np.empty(len(starts), _U)
    up, down = _powers(TEXT_BYTES)
    at = 0
    while at < len(starts):
        first = int(starts[at])
        stop = int(np.searchsorted(ends, first + TEXT_BYTES, "right"))
        if stop <= at:  # one word of more than TEXT_BYTES
            total, power = 0, 1
            for a in range(first, int(ends[at]), TEXT_BYTES):
                part = _LOWER[buffer[a : min(a + TEXT_BYTES, int(ends[at]))]]
                total += int((part * up[: len(part)]).sum(dtype=_U)) * power
                power = power * pow(_P, TEXT_BYTES, 1 << 64) % (1 << 64)
            out[at] = total % (1 << 64)
            at += 1
            continue
        part = _LOWER[buffer[first : int(ends[stop - 1])]]
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(part * up[: len(part)], dtype=_U, out=sums[1:])
        a, b = starts[at:stop] - first, ends[at:stop] - first
        out[at:stop] = (sums[b] - sums[a]) * down[a]
        at = stop
    return out


def _hashes(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of the words of texts that lie one after another in buffer, and where each text's begin among them."""
    solid = ~_SPACES[buffer]
    fresh = solid.copy()
    fresh[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(buffer))]
    fresh[inner] = solid[inner]  # a text's first byte begins a word whatever lies before it
    starts = np.flatnonzero(fresh)
    closing = solid.copy()
    closing[:-1] &= ~solid[1:] | fresh[1:]
    h = _polynomials(buffer, starts, np.flatnonzero(closing) + 1)
    h = (h ^ (h >> _U(32))) * _MIX
    h = (h ^ (h >> _U(29))) * _MIX
    return ((h ^ (h >> _U(32))) >> _U(1)).astype(np.int64), np.searchsorted(starts, offsets)


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words (A-Z lower-cased, runs without ASCII white space)."""
    data = (text or "").encode()
    return _hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]


def hashes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column of texts (null: empty), and where each text's begin among them, with their number at the end."""
    texts = texts.cast(pa.large_binary())
    size, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    return _hashes(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0])


@dataclass
class Block:
    """Tokens (words and one end for each text) of whole texts, or of a stretch of a long one."""

    rows: list  # of each segment the other columns of its text
    hashes: np.ndarray
    starts: np.ndarray  # of segments, and their end
    skips: np.ndarray  # leading tokens of a segment that the one before has counted: 0, or 2 as the context of the next
    last: np.ndarray  # whether a segment ends its text

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes in order, and of each token which of them it is."""
        codes, values = pd.factorize(self.hashes)
        order = np.argsort(values)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return values[order], rank[codes]

    def triples(self, numbers: np.ndarray) -> tuple[np.ndarray, int]:
        """Of each token (numbered, 0 for what doesn't count) the triple that it begins, as one number, and the bits of each part."""
        width = int(numbers.max(initial=0)).bit_length()
        second, third = np.zeros_like(numbers), np.zeros_like(numbers)
        second[:-1], third[:-2] = numbers[1:], numbers[2:]
        ends = self.starts[1:] - 1
        second[ends] = third[ends] = 0
        third[np.maximum(ends - 1, 0)] = 0
        return (numbers << 2 * width) | (second << width) | third, width

    def counted(self) -> np.ndarray:
        """Whether a token begins a triple that this block counts: an end has no followers, the next segment counts a stretch's last two."""
        out = self.hashes != END
        for s in np.flatnonzero(~self.last):
            out[max(self.starts[s], self.starts[s + 1] - 2) : self.starts[s + 1]] = False
        return out


def _blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK_TOKENS) -> Iterator[Block]:
    rows, parts, skips, last, held = [], [], [], [], 0

    def done() -> Block:
        lens = np.array([len(p) for p in parts])
        return Block(rows, np.concatenate(parts), np.concatenate([[0], np.cumsum(lens)]), np.array(skips), np.array(last))

    for b in batches:
        others = [b.column(n).to_pylist() for n in b.schema.names if n != "text"]
        hashes, firsts = hashes_of(b.column("text"))
        tokens = np.insert(hashes, firsts[1:], END)
        firsts = (firsts + np.arange(len(firsts))).tolist()
        for i in range(b.num_rows):
            text = tokens[firsts[i] : firsts[i + 1]]
            for at in range(0, max(1, len(text) - 2), size - 2):
                part = text[at : at + size]
                rows.append(tuple(o[i] for o in others))
                parts.append(part)
                skips.append(2 if at else 0)
                last.append(at + size >= len(text))
                held += len(part)
                if held >= size:
                    yield done()
                    rows, parts, skips, last, held = [], [], [], [], 0
    if rows:
        yield done()


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and their end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


# ------------------------------------------------------------------------ trie


def _code(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(np.maximum(p, 1e-300)) * STEPS), 0, 65535).astype(np.uint16)


_VALUES = 10.0 ** (-np.arange(65536) / STEPS)


class Vocabulary:
    """The first level: sorted hashes in shards by their highest bits, with the words' counts."""

    def __init__(self, folder: str, bits: int, firsts: np.ndarray):
        self.folder, self.bits, self.firsts = folder, bits, firsts
        self._mapped = Mapped(self._opened)

    def __reduce__(self):
        return Vocabulary, (self.folder, self.bits, self.firsts)

    def _opened(self, s: int) -> tuple[EliasFano, np.ndarray]:
        arrays = load(Path(self.folder, f"words-{s:08d}"))
        return EliasFano.of(arrays, "values"), arrays["count"]

    def _shard(self, s: int) -> tuple[EliasFano, np.ndarray]:
        return self._mapped[s]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids from 1 (0: none) and counts of sorted hashes."""
        ids, counts = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        shards = hashes >> (63 - self.bits)
        runs = _runs(shards)
        for a, b in zip(runs, runs[1:], strict=False):
            s = int(shards[a])
            if self.firsts[s + 1] > self.firsts[s]:
                values, count = self._shard(s)
                place, equal = values.successor(hashes[a:b] - (s << (63 - self.bits)))
                met = np.flatnonzero(equal)
                ids[a + met] = place[met] + self.firsts[s] + 1
                counts[a + met] = count[place[met]]
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted ids."""
        out = np.empty(len(ids), np.int64)
        shards = np.searchsorted(self.firsts, ids - 1, "right") - 1
        runs = _runs(shards)
        for a, b in zip(runs, runs[1:], strict=False):
            s = int(shards[a])
            out[a:b] = self._shard(s)[1][ids[a:b] - 1 - self.firsts[s]]
        return out


class Splits:
    """Keys (first, second, third) that begin the shards from the second on, in order."""

    def __init__(self, keys: np.ndarray, stride: int):
        self.stride = stride
        first, second, third = keys.reshape(-1, 3).T
        self.firsts, r1 = np.unique(first, return_inverse=True)
        self.pairs, r2 = np.unique((2 * r1 + 1) * stride + second, return_inverse=True)
        self.keys = (2 * r2 + 1) * stride + third

    def first(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word which split key's first part it is (-1: none), and its number among these and what lies between."""
        at = np.searchsorted(self.firsts, a)
        same = np.zeros(len(a), bool)
        inside = at < len(self.firsts)
        same[inside] = self.firsts[at[inside]] == a[inside]
        return np.where(same, at, -1), 2 * at + same

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of pairs."""
        same, number = self.first(a)
        key = number * self.stride + np.where(same >= 0, b, 0)
        at = np.searchsorted(self.pairs, key)
        inside = np.flatnonzero(at < len(self.pairs))
        equal = np.zeros(len(a), bool)
        equal[inside] = (self.pairs[at[inside]] == key[inside]) & (same[inside] >= 0)
        return np.where(equal, at, -1), 2 * at + equal

    def shards(self, a: np.ndarray, b: np.ndarray, c: np.ndarray | int) -> np.ndarray:
        same, number = self.pair(a, b)
        return np.searchsorted(self.keys, number * self.stride + np.where(same >= 0, c, 0), "right")


class Grams:
    """The second and third level of one shard."""

    def __init__(self, file: Path, stride: int):
        arrays = load(file)
        self.first, self.span = (int(x) for x in arrays["first"])
        self.stride = stride
        self.heads, self.seconds, self.pointers, self.thirds = (EliasFano.of(arrays, n) for n in ("heads", "seconds", "pointers", "thirds"))
        self.code2, self.code3 = arrays["code2"], arrays["code3"]

    @staticmethod
    def arrays(w: np.ndarray, counts: np.ndarray, stride: int, word_counts) -> tuple[dict, list]:
        """From sorted distinct triples w (three rows): a shard's arrays, and its first and last pair as (first, second, count, followers, pairs of first, count of first)."""
        cut = np.flatnonzero(np.concatenate([[True], (w[0, 1:] != w[0, :-1]) | (w[1, 1:] != w[1, :-1])]))
        first, second = w[0, cut], w[1, cut]
        total, full = np.add.reduceat(counts, cut), w[2] > 0
        followers = np.add.reduceat(full.astype(np.int64), cut)
        heads = _runs(first)
        words, pairs = first[heads[:-1]], np.diff(heads)
        of_word = word_counts(words)
        base, span = int(words[0]), int(words[-1] - words[0]) + 1
        starts = np.zeros(span + 1, np.int64)
        starts[words - base + 1] = pairs
        pair = np.repeat(np.arange(len(cut)), np.diff(np.concatenate([cut, [len(counts)]])))[full]
        out = {"first": np.array([base, span], np.int64), "code2": _code((total - DISCOUNT) / np.repeat(of_word, pairs)), "code3": _code((counts[full] - DISCOUNT) / total[pair])}
        out |= EliasFano.build(np.cumsum(starts)).arrays("heads") | EliasFano.build((first - base) * stride + second).arrays("seconds")
        out |= EliasFano.build(np.concatenate([[0], np.cumsum(followers)])).arrays("pointers") | EliasFano.build(pair * stride + w[2, full]).arrays("thirds")
        word = np.repeat(np.arange(len(words)), pairs)
        return out, [(int(first[i]), int(second[i]), int(total[i]), int(followers[i]), int(pairs[word[i]]), int(of_word[word[i]])) for i in {0, len(cut) - 1}]

    def place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The places of pairs, -1 for those that aren't here."""
        out = np.full(len(a), -1, np.int64)
        inside = np.flatnonzero((a >= self.first) & (a < self.first + self.span))
        place, equal = self.seconds.successor((a[inside] - self.first) * self.stride + b[inside])
        out[inside[equal]] = place[equal]
        return out

    def word_followers(self, a: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        inside = np.flatnonzero((a >= self.first) & (a < self.first + self.span))
        at = a[inside] - self.first
        out[inside] = self.heads.at(at + 1) - self.heads.at(at)
        return out

    def pair_followers(self, places: np.ndarray) -> np.ndarray:
        return self.pointers.at(places + 1) - self.pointers.at(places)

    def third(self, places: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Discounted probabilities of c after the pairs at places; 0 for triples that aren't here."""
        place, equal = self.thirds.successor(places * self.stride + c)
        out = np.zeros(len(c))
        out[equal] = _VALUES[self.code3[place[equal]]]
        return out


class Trie:
    """The files of a folder, mapped when used."""

    def __init__(self, folder: str, words: Vocabulary, stride: int):
        self.folder, self.words, self.stride = folder, words, stride
        self._mapped = Mapped(self._opened)

    def __reduce__(self):
        return Trie, (self.folder, self.words, self.stride)

    @property
    def directory(self) -> dict:
        if not hasattr(self, "_directory"):
            self._directory = load(Path(self.folder, "directory"))
            self.splits = Splits(self._directory["splits"], self.stride)
        return self._directory

    def _opened(self, s: int) -> Grams:
        return Grams(Path(self.folder, f"grams-{s:08d}"), self.stride)

    def _shard(self, s: int) -> Grams | None:
        there = self.directory["shards"]
        at = np.searchsorted(there, s)
        return self._mapped[s] if at < len(there) and there[at] == s else None

    def _by_shard(self, shards: np.ndarray) -> Iterator[tuple[Grams, np.ndarray]]:
        order = np.argsort(shards, kind="stable")
        runs = _runs(shards[order])
        for a, b in zip(runs, runs[1:], strict=False):
            shard = self._shard(int(shards[order[a]]))
            if shard is not None:
                yield shard, order[a:b]

    def left_by_words(self, a: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The weight that each context of one word leaves to the lower order."""
        directory = self.directory
        followers = np.zeros(len(a), np.int64)
        for shard, mine in self._by_shard(self.splits.shards(a, np.zeros_like(a), 0)):
            followers[mine] = shard.word_followers(a[mine])
        cut, _ = self.splits.first(a)
        over = np.flatnonzero(cut >= 0)
        followers[over] = directory["words"][cut[over]]
        return DISCOUNT * followers / np.maximum(counts, 1)

    def pairs(self, a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """Of each pair, whose first word has been counted so often: its shard and place there (-1: none), its discounted probability, and the weight it leaves.

        A pair that a split key cuts lies in several shards: its sums are in the directory.
        """
        directory = self.directory
        shards = self.splits.shards(a, b, 0)
        place, p, left = np.full(len(a), -1, np.int64), np.zeros(len(a)), np.ones(len(a))
        for shard, mine in self._by_shard(shards):
            found = shard.place(a[mine], b[mine])
            mine, found = mine[found >= 0], found[found >= 0]
            place[mine] = found
            p[mine] = _VALUES[shard.code2[found]]
            times = np.maximum(np.round(p[mine] * counts[mine] + DISCOUNT), 1)  # the code holds the count
            left[mine] = DISCOUNT * shard.pair_followers(found) / times
        cut, _ = self.splits.pair(a, b)
        over = np.flatnonzero(cut >= 0)
        if len(over):
            times, followers = directory["pair_counts"][cut[over]], directory["pair_followers"][cut[over]]
            there = times > 0
            place[over] = np.where(there, 0, -1)
            p[over] = np.where(there, (times - DISCOUNT) / np.maximum(counts[over], 1), 0)
            left[over] = np.where(there, DISCOUNT * followers / np.maximum(times, 1), 1)
        return {"shard": shards, "place": place, "p": p, "left": left, "cut": cut}

    def thirds(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, pairs: dict[str, np.ndarray], pair: np.ndarray) -> np.ndarray:
        """Discounted probabilities of c after pairs, which are in the trie; pair says which of pairs each is."""
        directory = self.directory
        shards, place, scale = pairs["shard"][pair], pairs["place"][pair], np.ones(len(c))
        over = np.flatnonzero(pairs["cut"][pair] >= 0)
        if len(over):
            shards, place = shards.copy(), place.copy()
            shards[over] = self.splits.shards(a[over], b[over], c[over])
            for shard, mine in self._by_shard(shards[over]):
                place[over[mine]] = shard.place(a[over[mine]], b[over[mine]])
            # the code there is a part of what the shard counts of the pair
            key = pairs["cut"][pair][over] * (len(directory["splits"]) // 3 + 2) + shards[over]
            at = np.minimum(np.searchsorted(directory["part_keys"], key), len(directory["part_keys"]) - 1)
            held = directory["part_keys"][at] == key
            scale[over] = np.where(held, directory["parts"][at], 0)
            place[over[~held]] = -1
        out = np.zeros(len(c))
        for shard, mine in self._by_shard(np.where(place >= 0, shards, -1)):
            out[mine] = shard.third(place[mine], c[mine]) * scale[mine]
        return out


@dataclass
class Model:
    trie: Trie
    tokens: int  # N, with ends
    distinct: int  # V, the end among them

    def scores(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By segment, without the tokens that it skips: tokens, known ones, the base score and the model's log10 probability."""
        hashes, codes = block.distinct()
        ids, counts = self.trie.words.find(hashes)
        known = ids > 0
        numbers = np.where(known, np.arange(1, len(ids) + 1), 0)[codes]
        ids, counts = np.concatenate([[0], ids]), np.concatenate([[0], counts])
        times = counts[numbers]
        base = (times + 1) / (self.tokens + self.distinct + 1)
        p = base.copy()
        if known.any() and self.trie.directory["shards"].size:
            left = np.ones(len(ids))
            mine = np.flatnonzero(ids)
            left[mine] = self.trie.left_by_words(ids[mine], counts[mine])
            keys, width = block.triples(numbers)
            mask = (1 << width) - 1
            starts = np.flatnonzero((keys >> 2 * width > 0) & (keys >> width & mask > 0))
            begins = np.flatnonzero(numbers[:-1] > 0)
            opens = np.zeros(len(p) + 1, bool)
            opens[block.starts] = True
            begins = begins[~opens[begins + 1]]
            p[begins + 1] *= left[numbers[begins]]
            if len(starts):
                keys = keys[starts]
                order = np.argsort(keys)
                sorted_keys, starts = keys[order], starts[order]
                heads = _runs(sorted_keys >> width)
                pair_of = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
                pair_keys = sorted_keys[heads[:-1]] >> width
                a, b = pair_keys >> width, pair_keys & mask
                pairs = self.trie.pairs(ids[a], ids[b], counts[a])
                p[starts + 1] += pairs["p"][pair_of]
                # a pair that was seen is the context of what follows it, within a segment
                follows = (pairs["place"][pair_of] >= 0) & ~opens[starts + 2]
                weight, seen = np.ones(len(p)), np.zeros(len(p))
                weight[starts[follows] + 2] = pairs["left"][pair_of[follows]]
                asked = np.flatnonzero(follows & (sorted_keys & mask > 0))
                if len(asked):
                    cut = _runs(sorted_keys[asked])
                    one = asked[cut[:-1]]
                    pair = pair_of[one]
                    found = self.trie.thirds(ids[a[pair]], ids[b[pair]], ids[sorted_keys[one] & mask], pairs, pair)
                    seen[starts[asked] + 2] = np.repeat(found, np.diff(cut))
                p = seen + weight * p
        counted = np.ones(len(p), bool)
        for s in np.flatnonzero(block.skips):
            counted[block.starts[s] : block.starts[s] + block.skips[s]] = False
        add = lambda x: np.add.reduceat(np.where(counted, x, 0), block.starts[:-1])  # noqa: E731  each segment has a token at least
        return add(np.ones(len(p), np.int64)), add((times > 0).astype(np.int64)), add(np.log10(base)), add(np.log10(p))


# ---------------------------------------------------------------------- counts


def _packed(w: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted triples and their counts as one compressed string."""
    kind = "<u4" if int(w.max()) < 1 << 32 and int(counts.max()) < 1 << 32 else "<u8"
    first = np.diff(w[0], prepend=0)
    body = b"".join(np.ascontiguousarray(x, kind).tobytes() for x in (first, w[1], w[2], counts))
    return kind[2:].encode() + zstandard.ZstdCompressor(level=1).compress(body)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    parts = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[:1].decode()}").reshape(4, -1).astype(np.int64)
    parts[0] = np.cumsum(parts[0])
    return parts[:3], parts[3]


def _order(w: np.ndarray) -> np.ndarray:
    """The places of columns of w in lexicographic order."""
    for columns in (lambda: [x - x.min() for x in w], lambda: [np.unique(x, return_inverse=True)[1] for x in w]):
        found = columns()
        bits = [int(x.max()).bit_length() for x in found]
        if sum(bits) < 64:
            return np.argsort((found[0] << bits[1] + bits[2]) | (found[1] << bits[2]) | found[2])
    return np.lexsort(w[::-1])


def _words(docs: DataFrame) -> DataFrame:
    """(word, count) of the tokens of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            fresh = np.ones(len(block.hashes), bool)
            for s in np.flatnonzero(block.skips):
                fresh[block.starts[s] : block.starts[s] + block.skips[s]] = False
            codes, values = pd.factorize(block.hashes[fresh])
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.bincount(codes, minlength=len(values)))], names=["word", "count"])

    return docs.select("text").mapInArrow(run, "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))


def _write_words(words: DataFrame, distinct: int, folder: str, shard_words: int) -> Vocabulary:
    """Write the first level; hashes spread evenly, so that their highest bits make shards of a size."""
    bits = max(0, (-(-distinct // shard_words) - 1).bit_length())

    def write(group: pa.Table) -> pa.Table:
        s = int(group["shard"][0].as_py())
        hashes, counts = group["word"].to_numpy(), group["count"].to_numpy()
        order = np.argsort(hashes)
        counts = counts[order]
        small = np.uint32 if counts.max() < 1 << 32 else np.int64
        dump(Path(folder, f"words-{s:08d}"), EliasFano.build(hashes[order] - (s << (63 - bits))).arrays("values") | {"count": counts.astype(small)})
        return pa.table({"shard": [s], "n": [len(hashes)]})

    made = words.withColumn("shard", F.shiftrightunsigned("word", 63 - bits) if bits else F.lit(0).cast("long")).groupBy("shard").applyInArrow(write, "shard long, n long")
    sizes = np.zeros(1 << bits, np.int64)
    for r in made.collect():  # one row for each shard of about a million words
        sizes[r.shard] = r.n
    return Vocabulary(folder, bits, np.concatenate([[0], np.cumsum(sizes)]))


def _write_splits(docs: DataFrame, words: Vocabulary, folder: str, shard_grams: int) -> None:
    """Write split keys that cut the triples of docs into shards of about shard_grams."""
    rate = max(1, shard_grams // SAMPLES // SAMPLED_TEXTS)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            hashes, codes = block.distinct()
            ids, _ = words.find(hashes)
            keys, width = block.triples(codes + 1)
            keys = keys[block.counted()]
            mixed = keys.astype(_U) * _U(_P)
            mixed = (mixed ^ (mixed >> _U(29))) * _MIX
            keys = np.unique(keys[(mixed >> _U(20)) % _U(rate) == 0])
            ids, mask = np.concatenate([[0], ids]), (1 << width) - 1
            yield pa.RecordBatch.from_arrays([pa.array(ids[x]) for x in (keys >> 2 * width, keys >> width & mask, keys & mask)], names=["a", "b", "c"])

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a partition with many samples one for SAMPLES of them, which weighs as much; the rest alone."""
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            step = SAMPLES if rows.num_rows >= 64 * SAMPLES else 1
            rows = rows.take(pa.array(np.arange(step - 1, rows.num_rows, step)))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(rows.num_rows, step))], names=["a", "b", "c", "weight"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([b.column(i).to_numpy() for i in range(4)]) for b in batches if b.num_rows]
        keys = np.concatenate(held, axis=1) if held else np.zeros((4, 0), np.int64)
        keys = keys[:, np.lexsort(keys[2::-1])]
        reached = np.cumsum(keys[3]) // SAMPLES
        keys = np.unique(keys[:3, np.flatnonzero(np.diff(reached, prepend=0))], axis=1)
        dump(Path(folder, "splits"), {"splits": keys.T.ravel().astype(np.int64)})
        yield pa.RecordBatch.from_pydict({"n": [keys.shape[1]]})

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLED_TEXTS)) == 0).select("text")
    kept = some.mapInArrow(sample, "a long, b long, c long").orderBy("a", "b", "c").mapInArrow(thin, "a long, b long, c long, weight long")
    kept.repartition(1).mapInArrow(write, "n long").collect()


def _write_grams(docs: DataFrame, words: Vocabulary, stride: int, folder: str) -> None:
    """Count the triples of docs, write the shards of the second and third level, and the directory."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits = Splits(np.array(load(Path(folder, "splits"))["splits"]), stride)
        for block in _blocks(batches):
            hashes, codes = block.distinct()
            ids, _ = words.find(hashes)
            keys, width = block.triples(codes + 1)
            keys = np.sort(keys[block.counted()])
            if not len(keys):
                continue
            runs = _runs(keys)
            keys, ids, mask = keys[runs[:-1]], np.concatenate([[0], ids]), (1 << width) - 1
            w, counts = np.stack([ids[keys >> 2 * width], ids[keys >> width & mask], ids[keys & mask]]), np.diff(runs)
            shards = splits.shards(*w)
            cut = _runs(shards)
            data = [_packed(w[:, a:b], counts[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(shards[cut[:-1]]), pa.array(data, pa.binary())], names=["shard", "data"])

    def write(group: pa.Table) -> pa.Table:
        s, parts = int(group["shard"][0].as_py()), [_unpacked(x.as_py()) for x in group["data"]]
        w, counts = (np.concatenate([p[i] for p in parts], axis=-1) for i in (0, 1))
        del parts
        order = _order(w)
        w, counts = w[:, order], counts[order]
        heads = np.flatnonzero(np.concatenate([[True], (w[:, 1:] != w[:, :-1]).any(axis=0)]))
        arrays, edges = Grams.arrays(w[:, heads], np.add.reduceat(counts, heads), stride, words.counts)
        dump(Path(folder, f"grams-{s:08d}"), arrays)
        return pa.table({"shard": [s] * len(edges)} | {n: [e[i] for e in edges] for i, n in enumerate(EDGE)})

    def directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b.to_pandas() for b in batches if b.num_rows]
        rows = pd.concat(own) if own else pd.DataFrame({n: np.zeros(0, np.int64) for n in ("shard", *EDGE)})
        keys = np.array(load(Path(folder, "splits"))["splits"])
        dump(Path(folder, "directory"), _directory(rows, keys, stride))
        yield pa.RecordBatch.from_pydict({"n": [len(rows)]})

    found = docs.select("text").mapInArrow(count, "shard long, data binary").groupBy("shard").applyInArrow(write, "shard long, " + ", ".join(f"{n} long" for n in EDGE))
    found.repartition(1).mapInArrow(directory, "n long").collect()


#: What is told of a shard's first and last pair: the pair, its count and followers there, and of its first word the pairs there and the count.
EDGE = ("first", "second", "total", "followers", "pairs", "words")


def _directory(rows: pd.DataFrame, keys: np.ndarray, stride: int) -> dict[str, np.ndarray]:
    """The shards that there are, the split keys, and sums over the shards for words and pairs that split keys cut."""
    splits = Splits(keys, stride)
    rows = rows.drop_duplicates().sort_values(["shard", "first", "second"])
    cut, _ = splits.pair(rows["first"].to_numpy(np.int64), rows["second"].to_numpy(np.int64))
    totals, followers, words = (np.zeros(n, np.int64) for n in (len(splits.pairs), len(splits.pairs), len(splits.firsts)))
    np.add.at(totals, cut[cut >= 0], rows["total"].to_numpy(np.int64)[cut >= 0])
    np.add.at(followers, cut[cut >= 0], rows["followers"].to_numpy(np.int64)[cut >= 0])
    one = rows.drop_duplicates(["shard", "first"])
    word, _ = splits.first(one["first"].to_numpy(np.int64))
    np.add.at(words, word[word >= 0], one["pairs"].to_numpy(np.int64)[word >= 0])
    own = rows[cut >= 0].assign(cut=cut[cut >= 0])
    again = own[own.duplicated("cut")]  # a pair that lies in m shards has been counted m times among its word's
    word, _ = splits.first(again["first"].to_numpy(np.int64))
    np.add.at(words, word, -1)
    own = own.sort_values(["cut", "shard"])
    place = own["cut"].to_numpy(np.int64)
    return {
        "shards": np.unique(rows["shard"].to_numpy(np.int64)), "splits": keys, "words": words, "pair_counts": totals, "pair_followers": followers,
        "part_keys": place * (len(keys) // 3 + 2) + own["shard"].to_numpy(np.int64), "parts": own["total"].to_numpy(np.float64) / np.maximum(totals[place], 1),
    }


def learn(docs: DataFrame, shard_words: int = SHARD_WORDS, shard_grams: int = SHARD_GRAMS) -> Model:
    """Count the words, pairs and triples of all texts of docs (doc_id, text) and write the trie to the shared folder."""
    spark = docs.sparkSession
    arrow_rows(spark)
    url = urlparse(shared_dir(spark))
    if url.scheme not in ("", "file"):
        raise ValueError(f"the trie is mapped from files: mount the shared folder {url.geturl()} on every node and name it as a file: path")
    folder = f"{url.path}/lodestar/trie-{uuid.uuid4().hex}"
    Path(folder).mkdir(parents=True)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)

    counted = written(_words(docs), "words")
    tokens, distinct = counted.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    words, stride = _write_words(counted, distinct, folder, shard_words), int(distinct) + 2
    _write_splits(docs, words, folder, shard_grams)
    _write_grams(docs, words, stride, folder)
    return Model(Trie(folder, words, stride), int(tokens), int(distinct))


def lm_scores(docs: DataFrame, shard_words: int = SHARD_WORDS, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of docs.

    The model learns from all rows whose crc32(doc_id as text) mod 7 is not 2;
    held_out marks the others.  Tokens are a text's words and one end; n_known
    counts those seen in training, train_tokens all of training.  base_score sums
    log10((c + 1) / (N + V + 1)) over the tokens, score their log10
    probabilities by the trie (absolute discounting, interpolated); every n-gram
    of training is in it.  A null text is empty, with its end alone; rows
    without an id are learned from; null and repeated ids keep their rows; an empty
    table gives an empty one; further columns are ignored.  A long text is
    read in stretches of BLOCK_TOKENS.
    """
    docs = docs.select("doc_id", "text")
    model = learn(docs.where(remainder("doc_id", 7) != 2), shard_words, shard_grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = np.zeros(4)  # of a text whose first stretches have been scored
        for block in _blocks(batches):
            rows = []
            for row, last, *found in zip(block.rows, block.last, *model.scores(block), strict=True):
                before = before + found
                if last:
                    rows.append((*row, int(before[0]), int(before[1]), model.tokens, float(before[2]), float(before[3])))
                    before = np.zeros(4)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2), strict=True)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    held = docs.select(F.col("doc_id").cast("long"), (remainder("doc_id", 7) == 2).alias("held_out"), "text")
    return held.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
