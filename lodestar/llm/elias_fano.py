"""Elias-Fano sequences: sorted whole numbers in about two bits each more than their spread needs.

A number's low bits are stored as they are; its high part h at place i is a one at bit h + i
of a bit vector, which a directory of counts by word makes searchable.  Reading a
place, and finding a value, touch a few words each; all of it works on arrays of
queries at a time, and on memory-mapped files as on arrays.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import OrderedDict
from collections.abc import Callable
from pathlib import Path
from typing import Generic, TypeVar

import numpy as np

T = TypeVar("T")
_U = np.uint64
#: Files that a process keeps mapped in one table of shards.
MOST_MAPPED = 128
#: Values whose low bits are packed at a time; a multiple of 64 keeps their bits on byte boundaries.
_PACKED = 1 << 16
#: Each byte of a word: one, its highest bit, and masks of every other bit, pair and half.
_ONES, _TOPS, _EVEN, _PAIRS, _HALVES = (_U(0x0101010101010101 * b) for b in (0x01, 0x80, 0x55, 0x33, 0x0F))
#: _PLACES[rank << 8 | byte]: the place of a byte's one number rank.
_PLACES = np.zeros(8 << 8, np.uint8)
for _byte in range(256):
    for _rank, _place in enumerate(p for p in range(8) if _byte >> p & 1):
        _PLACES[_rank << 8 | _byte] = _place


def _pick(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each word the place of its one number rank, from 0: byte by byte counts first, then a table of bytes."""
    rank = rank.astype(_U)
    sums = words - ((words >> _U(1)) & _EVEN)
    sums = (sums & _PAIRS) + ((sums >> _U(2)) & _PAIRS)
    sums = ((sums + (sums >> _U(4))) & _HALVES) * _ONES
    byte = np.bitwise_count(((rank * _ONES | _TOPS) - sums) & _TOPS).astype(_U) << _U(3)
    before = (sums << _U(8)) >> byte & _U(0xFF)
    return (byte + _PLACES[(rank - before) << _U(8) | (words >> byte) & _U(0xFF)]).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence of whole numbers from 0 to 2^63 - 1."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones
        self._zeros: np.ndarray | None = None

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = np.ascontiguousarray(values, "<u8")
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        packed = []
        for at in range(0, n if bits else 0, _PACKED):
            part = values[at : at + _PACKED].view(np.uint8).reshape(-1, 8)
            packed.append(np.packbits(np.unpackbits(part, axis=1, count=bits, bitorder="little").ravel(), bitorder="little"))
        low = np.concatenate([*packed, np.zeros(0, np.uint8)])
        low = np.concatenate([low, np.zeros(-len(low) % 8 + 16, np.uint8)]).view(_U)
        size = (n + (top >> bits) + 2 + 63) // 64 * 64 + 64
        marks = np.zeros(size, np.uint8)
        marks[(values >> _U(bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(marks, bitorder="little").view(_U)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))[:-1]])
        return cls(n, bits, low, high, ones.astype(np.uint32 if n < 1 << 32 else np.int64))

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.size": np.array([self.n, self.bits], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = (int(v) for v in arrays[f"{name}.size"])
        return cls(n, bits, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.ones"])

    def _low(self, places: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(places), np.int64)
        at = places * self.bits
        word, shift = at >> 6, (at & 63).astype(_U)
        # a shift by 64 - 0 is made of two, for one of 64 has no defined result
        both = (self.low[word] >> shift) | (self.low[word + 1] << (_U(63) - shift) << _U(1))
        return (both & _U((1 << self.bits) - 1)).astype(np.int64)

    def _one(self, rank: np.ndarray) -> np.ndarray:
        rank = rank.astype(self.ones.dtype)
        word = np.searchsorted(self.ones, rank, "right") - 1
        return word * 64 + _pick(self.high[word], rank - self.ones[word])

    def _zero(self, rank: np.ndarray) -> np.ndarray:
        """The bit of zero number rank, which ends the values of high part rank."""
        if self._zeros is None:
            self._zeros = np.arange(len(self.ones)) * 64 - self.ones
        word = np.searchsorted(self._zeros, rank, "right") - 1
        return word * 64 + _pick(~self.high[word], rank - self._zeros[word])

    def at(self, places: np.ndarray) -> np.ndarray:
        """The values at places."""
        return ((self._one(places) - places) << self.bits) | self._low(places)

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value the place of the first element that isn't smaller, and whether it equals it.

        The elements of a value's high part lie side by side before one zero:
        from there the search goes back as long as they aren't smaller.
        """
        equal = np.zeros(len(values), bool)
        if not self.n:
            return np.zeros(len(values), np.int64), equal
        last = int(self.at(np.array([self.n - 1]))[0]) >> self.bits
        high = values >> self.bits
        beyond = high > last
        high = np.minimum(high, last)
        bit = self._zero(high)
        place = bit - high
        asked = values & ((1 << self.bits) - 1)
        active = np.flatnonzero(~beyond)
        bit = bit[active] - 1
        steps = 0
        while len(active):
            if steps == 8:  # a long stretch of one high part: halve what is left of it
                self._halve(place, equal, active, high[active], asked[active])
                break
            steps += 1
            inside = (bit >= 0) & (self.high[np.maximum(bit, 0) >> 6] >> (bit & 63).astype(_U) & _U(1)).astype(bool)
            active, bit = active[inside], bit[inside]
            held, mine = self._low(place[active] - 1), asked[active]
            up = held >= mine
            active, bit = active[up], bit[up] - 1
            place[active] -= 1
            equal[active] = held[up] == mine[up]
        place[beyond] = self.n
        return place, equal

    def _halve(self, place: np.ndarray, equal: np.ndarray, active: np.ndarray, high: np.ndarray, asked: np.ndarray) -> None:
        """The same by bisection, from the first element of the high part to the place so far."""
        start = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) - (high - 1), 0)
        low, top = start, place[active].copy()
        live = np.flatnonzero(low < top)
        while len(live):
            middle = (low[live] + top[live]) >> 1
            smaller = self._low(middle) < asked[live]
            low[live] = np.where(smaller, middle + 1, low[live])
            top[live] = np.where(smaller, top[live], middle)
            live = live[low[live] < top[live]]
        moved = low < place[active]
        place[active] = low
        equal[active[moved]] = self._low(low[moved]) == asked[moved]


def dump(path: Path, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays to a file that load() maps; a file appears whole or not at all, whichever attempt writes it."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (at, a.dtype.str, len(a))
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    draft = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    with open(draft, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
        f.flush()
        os.fsync(f.fileno())
    os.replace(draft, path)


def load(path: Path) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped."""
    raw = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + size].tobytes())
    out = {}
    for name, (at, kind, count) in head.items():
        start = 8 + size + at
        out[name] = raw[start : start + count * np.dtype(kind).itemsize].view(kind)
    return out


class Mapped(Generic[T]):
    """Shards opened when they are asked for, of which the MOST_MAPPED last ones stay open.

    A mapping keeps a file handle, and a process has a bounded number of these. Who looks up
    many keys goes through them in the order of shards, and opens each once.
    """

    def __init__(self, opened: Callable[[int], T], most: int | None = None):
        self.opened, self.most = opened, most
        self.held: OrderedDict[int, T] = OrderedDict()

    def __getitem__(self, shard: int) -> T:
        if shard in self.held:
            self.held.move_to_end(shard)
        else:
            while len(self.held) >= (self.most or MOST_MAPPED):
                self.held.popitem(last=False)
            self.held[shard] = self.opened(shard)
        return self.held[shard]
