import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestar.llm import nbest, packing, registry, token_counts
from tests.llm.conftest import ODD, prose

ALPHABET = ["a", "the", " ", "  ", "\n", "é", "日本", "\t", "<s>", "▁", "ﬁ", "supercali", "🙂", "x" * 30, " word", " word"]


def test_spliced_counts_equal_whole_ones(pieces):
    pick, own = random.Random(1), token_counts.Encoder(pieces)
    for n in (5, 300, 900):
        for _ in range(25):
            text = "".join(pick.choice(ALPHABET) for _ in range(n))
            assert own.count(text, chunk=200, overlap=8) == len(own.model.encode(text))


def test_overlaps_widen_and_chunks_grow(pieces):
    own = token_counts.Encoder(pieces)
    for text in ("q" * 3000, ("y" * 500 + " ") * 9, "ab " * 900, " " * 700 + "z" * 700):
        assert own._spliced(text.encode(), 100, 4) == len(own.model.encode(text))


def test_counts_of_odd_documents(odd, empty, pieces):
    whole = sentencepiece.SentencePieceProcessor(model_file=pieces)
    rows = sorted(token_counts.token_counts(odd, pieces).collect(), key=str)
    texts = [*ODD, "tie tie"]
    ids = [i if i != 4 else None for i in range(len(ODD))] + [9]
    expected = [(i, len((t or "").encode()), n := len(whole.encode(t or "")), n > 4096) for i, t in zip(ids, texts, strict=True)]
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)
    assert token_counts.token_counts(empty, pieces).collect() == []


def test_counts_of_the_table(spark, sf, pieces):
    whole = sentencepiece.SentencePieceProcessor(model_file=pieces)
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in registry.op7_token_counts(spark, sf).collect()}
    assert got == {i: (len(t.encode()), n := len(whole.encode(t)), n > 4096) for i, t in docs.items()}


# --------------------------------------------------------------------- packing


def test_ids_equal_the_librarys(byte_bpe):
    own, library, pick = packing.ByteLevel(byte_bpe), Tokenizer.from_file(byte_bpe), random.Random(2)
    letters = [chr(i) for i in range(256)] + ["the", " ", "  ", "'s", "'LL", " 12", "\n\n", "<|endoftext|>", "日", " ", "\x1c"] * 8
    assert own.fast is not None
    for t in [*ODD[1:], *("".join(pick.choice(letters) for _ in range(60)) for _ in range(400))]:
        assert own.ids(t or "").tolist() == library.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 10**6, "\n" * 10**7, "a" + "\t" * 10**6 + "b", " \n\t" * 500_000 + "x", (" " * 40_000 + "y") * 30, "z" * 10**6, "1" * 10**6, "-" * 10**6])
def test_long_runs_equal_the_librarys(byte_bpe, text):
    own = packing.ByteLevel(byte_bpe)
    assert own.ids(text).tolist() == own.own.encode(text, add_special_tokens=False).ids


def test_what_the_fast_encoder_fails_on_goes_to_the_library(byte_bpe, monkeypatch):
    own = packing.ByteLevel(byte_bpe)
    monkeypatch.setattr(packing, "LONG_RUN", 1 << 40)
    text = " " * 1_200_000
    assert own.ids(text).tolist() == own.own.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [16, 1024])
def test_cuts_are_whole_and_fit_their_class(capacity):
    counts = packing.class_counts(capacity)
    for n in range(1, 3 * capacity):
        parts = packing.cuts(n, capacity)
        assert sum(parts) == n and all(0 < p <= capacity for p in parts)
    packer = packing.Packer(capacity, 0)
    rows = [r for n in range(1, 2 * capacity) for r in packer.add(n, np.arange(n, dtype=np.uint32))]
    sizes = defaultdict(list)
    for r in rows:
        sizes[r[4]].append(len(r[2]))
    assert all(len(s) in counts and max(s) <= capacity // len(s) for s in sizes.values())


def check(rows, texts, library):
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[i])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[i])
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 1024 - at if at & (at - 1) else 0
    return padding / sum(map(len, ids.values()))


def test_packing_odd_documents(spark, odd, empty, byte_bpe):
    library = Tokenizer.from_file(byte_bpe)
    unique = odd.where("rank > 0 or doc_id = 0").where("doc_id is not null")
    texts = {r.doc_id: r.text for r in unique.collect()}
    check(packing.pack(unique.repartition(3), byte_bpe).collect(), texts, library)
    assert sum(r.length for r in packing.pack(odd, byte_bpe, 16).collect()) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in [*ODD, "tie tie"])
    assert packing.pack(empty, byte_bpe).collect() == []
    with pytest.raises(ValueError):
        packing.pack(odd, byte_bpe, 1000)
    kept = packing.pack(odd.where("doc_id = 5"), byte_bpe, keep_ids=True).orderBy("start").collect()
    assert [i for r in kept for i in r.ids] == [*library.encode(ODD[5], add_special_tokens=False).ids, 0]


def test_packing_the_table(spark, sf, byte_bpe):
    texts = {d.doc_id: d.text for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check(registry.op10_packing(spark, sf).collect(), texts, Tokenizer.from_file(byte_bpe)) < 0.02


# ---------------------------------------------------------------------- n-best


def every(own, text):
    """All segmentations of text, best first."""
    steps, out = [[], *(own.arcs_into(text, end) for end in range(1, len(text) + 1))], []

    def back(at, ids, score):
        if not at:
            out.append((score, ids[::-1]))
        for start, arc, s in steps[at]:
            back(start, ids + arc, score + s)

    back(len(text), (), 0.0)
    return sorted(out, key=lambda o: (round(-o[0], 9), o[1][::-1]))


@pytest.mark.parametrize("text", ["▁the", "▁eauouon", "▁▁▁a", "é日▁", "aaaaaa", "▁x"])
def test_n_best_of_a_segment(pieces, text):
    own = nbest.lattice(pieces)
    for n in (1, 2, 3, 8, 1000):
        assert own.n_best(text, n) == every(own, text)[:n]


def test_n_best_of_random_segments(pieces):
    own, pick = nbest.lattice(pieces), random.Random(6)
    for _ in range(150):
        text = "".join(pick.choice("▁aaabetхé日🙂") for _ in range(pick.randrange(1, 10)))
        for n in (2, 5, 40):
            assert own.n_best(text, n) == every(own, text)[:n]


@pytest.mark.parametrize("word", ["x" * 400_000, "ab" * 200_000, "日🙂" * 100_000])
def test_n_best_of_a_long_word_is_linear(pieces, word):
    import time

    own, began = nbest.lattice(pieces), time.process_time()
    found, decodes = own.encode(word, 3)
    assert time.process_time() - began < 30 and len(found) == (1 if "日" in word else 3) and decodes  # 日 and 🙂 have no piece, only bytes
    assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)
    assert all(own.decode(np.frombuffer(b"".join(ids), "<u4").tolist()) == word for _, ids in found)


@pytest.mark.parametrize("text", ["the cat", "a  b é", "日 x y", " ", "ab ab ab", "tie"])
def test_n_best_of_a_text(pieces, text):
    own = nbest.lattice(pieces)
    whole = every(own, (nbest.SPACE + text).replace(" ", nbest.SPACE))
    for n in (1, 4, 12):
        got, decodes = own.encode(text, n)
        flat = [tuple(np.frombuffer(b"".join(ids), "<u4").tolist()) for _, ids in got]
        assert decodes
        assert [round(s, 6) for s, _ in got] == [round(s, 6) for s, _ in whole[:n]]
        assert len(set(flat)) == len(flat) and set(flat) <= {ids for _, ids in whole}
        assert all(own.decode(ids) == text for ids in flat)


def test_n_best_of_odd_documents(odd, empty, pieces):
    rows = nbest.n_best(odd, pieces, 3, keep_ids=True).collect()
    own = nbest.lattice(pieces)
    texts = {i: t or "" for i, t in enumerate(ODD)}
    for r in rows:
        text = texts[4 if r.doc_id is None else r.doc_id]
        assert r.decodes == (nbest.SPACE not in text) and (not r.decodes or own.decode(r.ids) == text)
        assert r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert [(r.rank, r.n_pieces) for r in rows if r.doc_id == 0] == [(1, 0)]
    assert nbest.n_best(empty, pieces).collect() == []


def test_n_best_round_trip_of_long_text(pieces):
    own, text = nbest.lattice(pieces), prose(3, 3000) + "\n" + "é" * 50
    found, decodes = own.encode(text, 5)
    scores = [s for s, _ in found]
    assert scores == sorted(scores, reverse=True) and len(scores) == 5 and decodes
    assert all(own.decode(np.frombuffer(b"".join(ids), "<u4").tolist()) == text for _, ids in found)


def test_best_and_next_equal_the_search(pieces):
    own, pick = nbest.lattice(pieces), random.Random(8)
    texts = ["".join(pick.choice("▁▁abctheé日🙂\n") for _ in range(pick.randrange(1, 12))) for _ in range(400)] + ["▁", "a"]
    for text, (score, ids, cost, decodes) in zip(texts, own.best_and_next(texts), strict=True):
        found = own.n_best(text, 2)
        assert (score, tuple(np.frombuffer(ids, "<u4").tolist())) == found[0] and decodes
        assert cost == (found[0][0] - found[1][0] if len(found) > 1 else float("inf"))
