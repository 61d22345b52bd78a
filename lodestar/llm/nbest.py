"""N-best segmentations of texts by the pieces of a SentencePiece model.

The pieces that match a text form a lattice.  A forward Viterbi pass gives the
best score of every prefix; an A* search from the text's end backwards uses
these as its heuristic, which is exact, so that complete paths come out of the
queue in the order of their scores.

No piece reaches from a non-space to a space, so a text falls into segments
(spaces and the word that follows) whose lattices are independent.  The Viterbi
pass tells for each distinct segment its best path and what the next best
costs more.  Of the segments of a text only those N - 1 where that is least can
differ among its N best: these are searched, and their lists combined.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_rows

#: The mark by which pieces show a space.
SPACE = "▁"
#: A character without a piece is spelt in bytes; each costs so much more than the worst piece with more than spaces.
BYTE_COST = 10.0
#: Distinct segments whose best paths a worker keeps; how many are scored together; longer ones are searched alone.
KEPT_SEGMENTS, TOGETHER, LONG = 500_000, 16384, 48
#: Texts of fewer characters are looked through for new segments batch by batch, longer ones each by itself.
LOOK_AHEAD = 1 << 20

_SEGMENTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class _Path:
    """An end of a segmentation: its first arc, at which place that begins, and a link to what comes after it."""

    __slots__ = ("after", "at", "cost", "done", "jump", "length", "own")

    def __init__(self, after: _Path | None, own: tuple[int, ...], at: int, done: float, cost: float):
        #: done is its own score, cost minus the best score of any whole path that ends with it.
        self.after, self.own, self.at, self.done, self.cost = after, own, at, done, cost
        self.length = after.length + 1 if after else 0
        #: A link further on, by which ends of a given length are found in logarithmic time.
        self.jump = self if after is None else after.jump.jump if after.length - after.jump.length == after.jump.length - after.jump.jump.length else after

    def _shorter(self, length: int) -> _Path:
        path = self
        while path.length > length:
            path = path.jump if path.jump.length >= length else path.after
        return path

    def __lt__(self, other: _Path) -> bool:
        """By cost, then by ids from the end: those of the first arcs that differ decide."""
        if self.cost != other.cost:
            return self.cost < other.cost
        length = min(self.length, other.length)
        a, b = self._shorter(length), other._shorter(length)
        if a is b:
            return self.length < other.length
        while a.after is not b.after:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.after, b.after)
        return a.own < b.own

    def ids(self) -> tuple[int, ...]:
        out, path = [], self
        while path is not None:
            out.extend(reversed(path.own))
            path = path.after
        return tuple(out)


class Lattice:
    """The pieces and scores of a model file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(model.get_piece_size())
        self.pieces = [model.id_to_piece(i) for i in size]
        plain = [i for i in size if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.arcs = {self.pieces[i]: ((i,), model.get_score(i)) for i in plain}
        self.characters = {p for p in self.arcs if len(p) == 1}
        self.longest = max(map(len, self.arcs))
        self.matcher = ahocorasick.Automaton()
        for piece, (ids, score) in self.arcs.items():
            self.matcher.add_word(piece, (len(piece), ids, score))
        self.matcher.make_automaton()
        self.scores = np.array([model.get_score(i) for i in size])
        self._tree()
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in size if model.is_byte(i)}
        self.bytes_of = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.byte_score = min(s for p, (_, s) in self.arcs.items() if p.strip(SPACE)) - BYTE_COST
        if len(self.byte_ids) < 256:
            raise ValueError("the model has no piece for every byte")
        if any(SPACE in p.lstrip(SPACE) for p in self.arcs):
            raise ValueError("a piece of the model holds a space after something else")

    def _tree(self) -> None:
        """The pieces as a tree in arrays, by which all places of a text are matched at the same time: sorted keys (node, character) and the nodes that they lead to."""
        letters = sorted({c for p in self.arcs for c in p})
        self.letter = np.zeros(max(map(ord, letters)) + 2, np.int64)  # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.alphabet = len(letters) + 1
        nodes, ends = {"": 0}, {}
        for piece, (ids, _) in self.arcs.items():
            for i in range(1, len(piece) + 1):
                nodes.setdefault(piece[:i], len(nodes))
            ends[nodes[piece]] = ids[0]
        keys = np.array([nodes[p[:-1]] * self.alphabet + self.letter[ord(p[-1])] for p in nodes if p])
        order = np.argsort(keys)
        self.keys, self.targets = np.append(keys[order], -1), np.append(np.array([n for p, n in nodes.items() if p])[order], 0)
        self.piece_at = np.full(len(nodes), -1)
        self.piece_at[list(ends)] = list(ends.values())
        self.single = np.zeros(self.alphabet, bool)
        self.single[[self.letter[ord(c)] for c in self.characters]] = True

    def matches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (the last character) and id of each piece that lies in a text of letters' numbers, which ends in 0."""
        found = []
        start = np.flatnonzero(codes)
        node, depth = np.zeros(len(start), np.int64), 0
        while len(start):
            key = node * self.alphabet + codes[start + depth]
            at = np.searchsorted(self.keys[:-1], key)
            there = self.keys[at] == key
            start, node = start[there], self.targets[at[there]]
            ids = self.piece_at[node]
            hit = ids >= 0
            found.append((start[hit], start[hit] + depth, ids[hit]))
            depth += 1
            more = codes[start + depth] > 0
            start, node = start[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def arcs_into(self, text: str, end: int) -> list[tuple[int, tuple[int, ...], float]]:
        """The arcs that end at a place of text: (start, ids from the end, score).

        A character that no piece stands for alone has an arc of bytes.
        """
        found = []
        for start in range(max(0, end - self.longest), end):
            arc = self.arcs.get(text[start:end])
            if arc is not None:
                found.append((start, *arc))
        if text[end - 1] not in self.characters:
            ids = tuple([self.byte_ids[b] for b in reversed(text[end - 1].encode())])
            found.append((end - 1, ids, self.byte_score * len(ids)))
        return found

    def prefixes(self, text: str) -> list[float]:
        """The best score of every prefix of text (forward Viterbi)."""
        best, spelt = [0.0] + [-inf] * len(text), 0  # the places before spelt have had their arcs of bytes
        odd = {} if self.characters.issuperset(text) else {i: self.byte_score * len(c.encode()) for i, c in enumerate(text) if c not in self.characters}
        for last, (size, _, score) in self.matcher.iter(text):
            while odd and spelt < last:
                if spelt in odd:
                    best[spelt + 1] = max(best[spelt + 1], best[spelt] + odd[spelt])
                spelt += 1
            score += best[last + 1 - size]
            if score > best[last + 1]:
                best[last + 1] = score
        for at in sorted(odd):
            if at >= spelt:
                best[at + 1] = max(best[at + 1], best[at] + odd[at])
        return best

    def n_best(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """Up to n (score, ids) of text, best first; of equal scores first the one whose ids, read from the end, are smaller.

        A* from the end: as the heuristic is exact, the best way on from a place is taken at once, and of
        all others only as many wait as can still be among the n best.  Paths share their ends through
        links to what comes after, so that time and memory grow in proportion to the text.
        """
        best = self.prefixes(text)
        waiting: list[_Path] = []
        found: list = []
        path = _Path(None, (), len(text), 0.0, 0.0)
        while True:
            wanted = n - len(found) - 1
            while path.at:
                ways = [(round(-(best[start] + (path.done + score)), 9), own, start, path.done + score) for start, own, score in self.arcs_into(text, path.at)]
                if len(ways) > 1:
                    ways.sort()  # no two arcs from a place begin with the same id
                    for cost, own, start, done in ways[1 : wanted + 1]:
                        if len(waiting) == wanted and cost > waiting[-1].cost:
                            break
                        insort(waiting, _Path(path, own, start, done, cost))
                        del waiting[wanted:]
                cost, own, start, done = ways[0]
                path = _Path(path, own, start, done, cost)
            found.append((path.done, path.ids()))
            if not waiting or len(found) == n:
                return found
            path = waiting.pop(0)

    def best_and_next(self, texts: list[str]) -> list[tuple[float, bytes, float, bool]]:
        """Of each text the best score, its ids as little-endian 32-bit words, what the next best path costs more (inf: there is none), and whether the ids decode to the text.

        All texts' lattices are scored together, place by place: best scores
        forward and backward.  The next best path has an arc that the best one
        hasn't, and the best path through an arc scores what its start, it and its end do.
        """
        joined = "\0" + "\0".join(texts) + "\0"
        lens = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(lens + 1) - lens  # a text's first character; its lattice's first node is one before
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.int64)
        codes = self.letter[np.minimum(points, len(self.letter) - 1)]
        start, end, ids = self.matches(codes)
        start, scores = start - 1, self.scores[ids]
        low = ids  # an arc's last id
        odd = np.flatnonzero(~self.single[codes] & (points > 0))
        if len(odd):  # characters in bytes; their ids are looked up when a path has them
            spelt = [joined[i].encode() for i in odd]
            end, start, ids = np.concatenate([end, odd]), np.concatenate([start, odd - 1]), np.concatenate([ids, -odd])
            scores = np.concatenate([scores, [self.byte_score * len(x) for x in spelt]])
            low = np.concatenate([low, [self.byte_ids[x[-1]] for x in spelt]])
        node_text = np.repeat(np.arange(len(texts) + 1), np.append(lens + 1, 1))
        inside = end - (first[node_text[end]] - 1)  # places from the text's first node
        best, chosen = self._forward(first - 1, len(joined), start, end, low, scores, inside)
        after = self._backward(first - 1 + lens, len(joined), start, end, scores, lens[node_text[end]] - (inside - (end - start)))
        total = best[first - 1 + lens]
        on = np.zeros(len(end), bool)
        steps = []
        at = first - 1 + lens
        live = np.flatnonzero(lens)
        while len(live):
            arcs = chosen[at[live]]
            on[arcs] = True
            steps.append((live, arcs))
            at[live] = start[arcs]
            live = live[at[live] > first[live] - 1]
        owner = np.concatenate([t for t, _ in steps])
        path = np.concatenate([x for _, x in steps])[::-1]  # from the front, once the texts are in order
        order = np.argsort(owner[::-1], kind="stable")
        path = ids[path[order]]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
        rest = np.full(len(texts), -inf)
        off = np.flatnonzero(~on)
        np.maximum.at(rest, node_text[end[off]], best[start[off]] + scores[off] + after[end[off]])
        data, bounds = path.astype("<u4").tobytes(), (4 * bounds).tolist()
        out = [(score, data[a:b], cost, True) for score, a, b, cost in zip(total.tolist(), bounds, bounds[1:], (total - rest).tolist(), strict=False)]  # pieces are what they matched
        for t in np.unique(owner[::-1][order][path <= 0]).tolist() if len(odd) else ():
            own = [j for i in path[bounds[t] // 4 : bounds[t + 1] // 4].tolist() for j in ((i,) if i > 0 else [self.byte_ids[b] for b in joined[-i].encode()])]
            out[t] = out[t][0], array("I", own).tobytes(), out[t][2], self.decode(own, 0) == texts[t].replace(SPACE, " ")
        return out

    @staticmethod
    def _forward(origins, nodes, start, end, low, scores, inside):
        """Best score of every node, and the arc by which it is reached: of equal ones that with the smallest last id."""
        order = np.argsort(inside.astype(np.uint8), kind="stable")  # LONG places at most
        best, chosen = np.full(nodes, -inf), np.full(nodes, -1)
        best[origins] = 0
        cuts = np.concatenate([[0], np.cumsum(np.bincount(inside))])
        for a, b in zip(cuts, cuts[1:], strict=False):
            group = order[a:b]
            ends = end[group]
            value = best[start[group]] + scores[group]
            np.maximum.at(best, ends, value)
            hit = group[value == best[ends]]
            chosen[end[hit]] = hit
            if (chosen[end[hit]] != hit).any():  # equal scores: the last assignment stays
                hit = hit[np.argsort(-low[hit], kind="stable")]
                chosen[end[hit]] = hit
        return best, chosen

    @staticmethod
    def _backward(targets, nodes, start, end, scores, left):
        """Best score from every node to its text's end; left is how many places lie between an arc's start and that end."""
        order = np.argsort(left.astype(np.uint8), kind="stable")
        after = np.full(nodes, -inf)
        after[targets] = 0
        cuts = np.concatenate([[0], np.cumsum(np.bincount(left))])
        for a, b in zip(cuts, cuts[1:], strict=False):
            group = order[a:b]
            np.maximum.at(after, start[group], scores[group] + after[end[group]])
        return after

    def segments(self, text: str) -> list[str]:
        return _SEGMENTS.findall((SPACE + text).replace(" ", SPACE)) if text else []

    def known(self, segments: list[str], cache: dict) -> None:
        """Put into cache what best_and_next() gives for the segments that it lacks."""
        new = [s for s in dict.fromkeys(segments) if s not in cache]
        if len(cache) + len(new) > KEPT_SEGMENTS:
            cache.clear()
            new = list(dict.fromkeys(segments))
        short = [s for s in new if len(s) <= LONG and "\0" not in s]
        for at in range(0, len(short), TOGETHER):
            part = short[at : at + TOGETHER]
            cache.update(zip(part, self.best_and_next(part), strict=True))
        for s in set(new).difference(short):
            found = self.n_best(s, 2)
            cache[s] = found[0][0], array("I", found[0][1]).tobytes(), found[0][0] - found[1][0] if len(found) > 1 else inf, self.decode(found[0][1], 0) == s.replace(SPACE, " ")

    def encode(self, text: str, n: int, cache: dict | None = None, lists=None, segments: list[str] | None = None) -> tuple[list[tuple[float, list[bytes]]], bool]:
        """Up to n (score, ids by segment as 32-bit words) of a whole text, best first; and whether they decode to it.

        Of equal scores first the one whose segments' places in their lists,
        read from the end, are smaller.  The empty text has one empty
        segmentation.  cache holds segments' best paths, lists their n best.
        """
        segments = self.segments(text) if segments is None else segments
        cache, lists = {} if cache is None else cache, lists or self.n_best
        if not segments:
            return [(0.0, [])], True
        try:
            found = [cache[s] for s in segments]
        except KeyError:
            self.known(segments, cache)
            found = [cache[s] for s in segments]
        scores, base, costs, decode = zip(*found, strict=True)
        costs, places = list(costs), []
        while len(places) < n - 1 and (least := min(costs)) < inf:
            places.append(costs.index(least))
            costs[places[-1]] = inf
        places.sort(reverse=True)  # from the end
        full = {p: lists(segments[p], n) for p in places}
        total, start = sum(scores), (0,) * len(places)
        queue, seen, out = [(0.0, start)], {start}, []
        while queue and len(out) < n:
            cost, ranks = heappop(queue)
            ids = list(base)
            for p, r in zip(places, ranks, strict=True):
                ids[p] = array("I", full[p][r][1]).tobytes()
            out.append((total - cost, ids))
            for j, p in enumerate(places):
                if ranks[j] + 1 < len(full[p]):
                    more = (*ranks[:j], ranks[j] + 1, *ranks[j + 1 :])
                    if more not in seen:
                        seen.add(more)
                        heappush(queue, (sum(full[q][0][0] - full[q][r][0] for q, r in zip(places, more, strict=True)), more))
        return out, SPACE not in text and all(decode)

    def decode(self, ids, front: int = 1) -> str:
        """The text that ids stand for; marks of spaces are spaces again, without the one put in front."""
        parts = b"".join([self.bytes_of.get(i) or self.pieces[i].encode() for i in ids])
        return parts.decode(errors="replace").replace(SPACE, " ")[front:]


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


@lru_cache(maxsize=2)
def _held(path: str) -> tuple[dict, object]:
    """A worker's best paths and n-best lists of segments."""
    return {}, lru_cache(maxsize=1 << 14)(lattice(path).n_best)


def n_best(docs: DataFrame, path: str, n: int = 3, text: str = "text", doc_id: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """docs -> (doc_id, rank, score, n_pieces, ids_crc32, decodes[, ids]): the n best segmentations of each whole text.

    score is the sum of the pieces' scores in the model at path, rank counts
    from 1; ids_crc32 is the unsigned CRC-32 of the ids as little-endian 32-bit words, keep_ids
    adds the ids; decodes says whether they decode to the text again (so unless the text
    has the mark of a space as a character).  A text with fewer segmentations
    gives fewer rows; null counts as empty, which has one segmentation without
    pieces; null and repeated ids keep their rows; further columns are ignored;
    nothing is shuffled.  Texts of any length are segmented whole; an empty table gives an empty one.
    """
    arrow_rows(docs.sparkSession)
    kinds = [("doc_id", None), ("rank", pa.int32()), ("score", pa.float64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decodes", pa.bool_())] + [("ids", pa.list_(pa.int32()))] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (cache, lists) = lattice(path), _held(path)
        for b in batches:
            rows, texts = [], [t or "" for t in b.column("text").to_pylist()]
            parted = [own.segments(t) if len(t) < LOOK_AHEAD else None for t in texts]
            own.known(list(chain.from_iterable(p for p in parted if p)), cache)
            for doc, t, segments in zip(b.column("doc_id").to_pylist(), texts, parted, strict=True):
                found, decodes = own.encode(t, n, cache, lists, segments)
                for rank, (score, parts) in enumerate(found, 1):
                    ids = b"".join(parts)
                    rows.append((doc, rank, score, len(ids) // 4, zlib.crc32(ids), decodes) + (np.frombuffer(ids, "<i4"),) * keep_ids)
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, b.schema.field("doc_id").type if kind is None else kind) for c, (_, kind) in zip(cols, kinds, strict=True)], names=[name for name, _ in kinds])

    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, rank int, score double, n_pieces long, ids_crc32 long, decodes boolean" + ", ids array<int>" * keep_ids)
