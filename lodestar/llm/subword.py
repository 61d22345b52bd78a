"""Averaged hashed subword embeddings under a linear softmax, trained and applied in numpy.

A text becomes the bag of its byte n-grams within words (a space marks a word's
begin and end), hashed to buckets.  A unit of text (a window, or a whole text)
is the mean of its n-grams' embeddings; a linear softmax on top is trained
jointly with the embeddings by stochastic gradient descent.  Words never seen
in training share n-gram vectors with those that were.

Since both layers are linear, a trained model is applied as one table of
logits by bucket: the logits of a unit are the mean of its n-grams' rows, and a bias.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of concatenated texts that are looked at in one pass.
PASS_BYTES = 1 << 20
#: Short units whose n-grams are hashed at a time.
TOGETHER = 4096
#: Gradient steps that a training takes at least, however few its units.
LEAST_STEPS = 120
#: a-z and bytes of non-ASCII characters stay, A-Z are lower-cased, all else is a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def letters(text: str | None) -> bytes:
    """A text's words of letters in lower case as UTF-8, with a space between.

    Every ASCII character but letters separates words.
    """
    return b" ".join((text or "").lower().encode().translate(_LETTERS).split())


def ngrams(buffer: np.ndarray, count: int, sizes: tuple[int, int], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: places below count where an n-gram starts, and their buckets.

    buffer needs sizes[1] more bytes than count.  An n-gram has no space but
    its first or last byte.
    """
    at = buffer.astype(np.uint32)
    solid = buffer != 32
    hashed = at[:count] * np.uint32(0x01000193)
    inside = solid[:count].copy()
    for n in range(1, sizes[1] + 1):
        if n > 1:
            hashed = (hashed ^ at[n - 1 : n - 1 + count]) * np.uint32(0x01000193)
            hashed ^= hashed >> np.uint32(15)
        if n == 2:
            whole = solid[:count] | solid[1 : 1 + count]
        elif n > 2:
            inside = solid[1 : 1 + count].copy() if n == 3 else inside & solid[n - 2 : n - 2 + count]
            whole = inside
        else:
            whole = inside
        if n >= sizes[0]:
            places = np.flatnonzero(whole)
            yield places, ((hashed[places] * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - bits)).astype(np.int64)


def bag(data: bytes, sizes: tuple[int, int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of the n-grams of letters()' bytes and how often each is there: at most 2^bits of them, whatever the length."""
    found, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = b" " + data + b" " * (sizes[1] + 1)
    for start in range(0, len(data) + 1, PASS_BYTES):
        count = min(PASS_BYTES, len(data) + 1 - start)
        buffer = np.frombuffer(padded, np.uint8, count + sizes[1], start)
        own, number = np.unique(np.concatenate([b for _, b in ngrams(buffer, count, sizes, bits)]), return_counts=True)
        both, place = np.unique(np.concatenate([found, own]), return_inverse=True)
        found, counts = both, np.bincount(place, np.concatenate([counts, number]), len(both)).astype(np.int64)
    return found, counts


@dataclass
class Bags:
    """Units of text in compressed rows: buckets[offsets[i]:offsets[i + 1]] are unit i's n-grams, which are there counts times."""

    buckets: np.ndarray
    counts: np.ndarray
    offsets: np.ndarray

    @classmethod
    def join(cls, parts: list[tuple[np.ndarray, np.ndarray]]) -> Bags:
        empty = [(np.zeros(0, np.int32), np.zeros(0, np.float32))]
        buckets, counts = (np.concatenate([np.asarray(p[i], kind) for p in parts + empty]) for i, kind in ((0, np.int32), (1, np.float32)))
        return cls(buckets, counts, np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]).astype(np.int64))

    @classmethod
    def of(cls, units: list[bytes], sizes: tuple[int, int], bits: int) -> Bags:
        """Of many short units, TOGETHER at a time."""
        parts = [cls._of(units[at : at + TOGETHER], sizes, bits) for at in range(0, len(units), TOGETHER)] or [cls.join([])]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.offsets) for p in parts]))])
        return cls(np.concatenate([p.buckets for p in parts]), np.concatenate([p.counts for p in parts]), offsets)

    @classmethod
    def _of(cls, units: list[bytes], sizes: tuple[int, int], bits: int) -> Bags:
        """Two spaces between units keep their n-grams apart."""
        lens = np.array([len(u) for u in units], np.int64)
        joined = b" " + b"  ".join(units) + b" " * (sizes[1] + 2)
        starts = np.cumsum(lens + 2) - (lens + 2)  # the space in front of each
        count = int(lens.sum()) + 2 * len(units)
        found = list(ngrams(np.frombuffer(joined, np.uint8, count + sizes[1]), count, sizes, bits))
        owner = np.searchsorted(starts, np.concatenate([p for p, _ in found]), "right") - 1
        order = np.argsort(owner, kind="stable")
        buckets = np.concatenate([b for _, b in found])[order].astype(np.int32)
        return cls(buckets, np.ones(len(buckets), np.float32), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(units)))]))

    def take(self, rows: np.ndarray) -> Bags:
        lens = np.diff(self.offsets)[rows]
        offsets = np.concatenate([[0], np.cumsum(lens)])
        places = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - self.offsets[rows], lens)
        return Bags(self.buckets[places], self.counts[places], offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Softmax:
    """A trained model: logits by bucket, a bias, and how the n-grams are made."""

    table: np.ndarray  # (buckets, classes), float32
    bias: np.ndarray
    sizes: tuple[int, int]
    bits: int

    def logits(self, bags: Bags) -> np.ndarray:
        lens = np.diff(bags.offsets)
        sums, total = np.zeros((len(bags), self.table.shape[1])), np.ones(len(bags))
        full = np.flatnonzero(lens)
        if len(full):
            sums[full] = np.add.reduceat(self.table[bags.buckets] * bags.counts[:, None], bags.offsets[:-1][full], axis=0)
            total[full] = np.add.reduceat(bags.counts, bags.offsets[:-1][full])
        return sums / total[:, None] + self.bias

    def cell_sums(self, data: bytes, cell: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each stretch of cell bytes of data: the summed rows of the n-grams that start there, and their number.

        Looks at PASS_BYTES at a time, whatever the length of data.
        """
        step = max(cell, PASS_BYTES // cell * cell)
        sums, counts = [], []
        padded = data + b" " * (self.sizes[1] + 1)
        for start in range(0, max(len(data), 1), step):
            count = min(step, len(data) - start)
            if count <= 0:
                break
            buffer = np.frombuffer(padded, np.uint8, count + self.sizes[1] + 1, start)
            cells = -(-count // cell)
            found, number = np.zeros((cells, self.table.shape[1])), np.zeros(cells)
            for places, buckets in ngrams(buffer, count, self.sizes, self.bits):
                mine = places // cell
                number += np.bincount(mine, minlength=cells)
                rows = self.table[buckets]
                for c in range(rows.shape[1]):
                    found[:, c] += np.bincount(mine, rows[:, c], minlength=cells)
            sums.append(found)
            counts.append(number)
        if not sums:
            return np.zeros((0, self.table.shape[1])), np.zeros(0)
        return np.concatenate(sums), np.concatenate(counts)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(bags: Bags, labels: np.ndarray, classes: int, sizes: tuple[int, int], bits: int, dim: int = 8, epochs: int = 5, batch: int = 128, rate: float = 0.5, seed: int = 1) -> Softmax:
    """Fit embeddings and softmax jointly by minibatch gradient descent; each row's step shrinks with its own past gradients.

    Only buckets that the units have get an embedding: an n-gram that training never met says nothing.
    """
    rng = np.random.default_rng(seed)
    met = np.flatnonzero(np.bincount(bags.buckets, minlength=1 << bits))
    local = np.zeros(1 << bits, np.int32)
    local[met] = np.arange(len(met))
    bags = Bags(local[bags.buckets], bags.counts, bags.offsets)
    emb = rng.standard_normal((len(met), dim), dtype=np.float32) * np.float32(0.1)
    out = rng.standard_normal((dim, classes)) * 0.1
    bias = np.zeros(classes)
    past_emb, past_out, past_bias = np.full(len(met), 1e-8, np.float32), np.full(out.shape, 1e-8), np.full(classes, 1e-8)
    target, lengths = np.eye(classes)[labels], np.diff(bags.offsets)
    for _ in range(max(epochs, -(-LEAST_STEPS * batch // max(len(bags), 1))) if len(bags) else 0):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            rows = rows[lengths[rows] > 0]
            if not len(rows):
                continue
            mine = bags.take(rows)
            total = np.add.reduceat(mine.counts, mine.offsets[:-1])
            share = mine.counts / np.repeat(total, np.diff(mine.offsets))
            hidden = np.add.reduceat(emb[mine.buckets] * share[:, None], mine.offsets[:-1], axis=0)
            wrong = (softmax(hidden @ out + bias) - target[rows]) / len(rows)
            grad_out, grad_bias = hidden.T @ wrong, wrong.sum(axis=0)
            spread = np.repeat(wrong @ out.T, np.diff(mine.offsets), axis=0) * share[:, None]
            places = np.argsort(mine.buckets)
            sorted_buckets = mine.buckets[places]
            begins = np.flatnonzero(np.concatenate([[True], sorted_buckets[1:] != sorted_buckets[:-1]]))
            used = sorted_buckets[begins]
            grad = np.add.reduceat(spread[places], begins, axis=0).astype(np.float32)
            past_emb[used] += (grad * grad).mean(axis=1)
            emb[used] -= np.float32(rate) * grad / np.sqrt(past_emb[used])[:, None]
            past_out += grad_out**2
            out -= rate * 0.2 * grad_out / np.sqrt(past_out)
            past_bias += grad_bias**2
            bias -= rate * 0.2 * grad_bias / np.sqrt(past_bias)
    table = np.zeros((1 << bits, classes), np.float32)
    table[met] = emb @ out
    return Softmax(table, bias, sizes, bits)
