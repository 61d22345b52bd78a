import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import elias_fano, language, lm, registry, subword, toxicity
from tests.llm.conftest import ODD, prose

# ------------------------------------------------------------------ Elias-Fano


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=80), st.lists(st.integers(0, 1 << 41), min_size=1, max_size=30))
def test_successors(values, asked):
    v = np.sort(np.array(values, np.int64))
    own = elias_fano.EliasFano.build(v)
    if len(v):
        assert own.at(np.arange(len(v))).tolist() == v.tolist()
    place, equal = own.successor(np.array(asked, np.int64))
    assert place.tolist() == np.searchsorted(v, asked).tolist() and equal.tolist() == np.isin(asked, v).tolist()


def test_files_are_mapped(tmp_path):
    v = np.cumsum(np.random.default_rng(0).integers(0, 9, 5000))
    elias_fano.dump(tmp_path / "x", elias_fano.EliasFano.build(v).arrays("v"))
    held = elias_fano.EliasFano.of(elias_fano.load(tmp_path / "x"), "v")
    assert isinstance(held.low, np.memmap) and held.at(np.arange(5000)).tolist() == v.tolist()
    assert [p.name for p in Path(tmp_path).iterdir()] == ["x"]


# ------------------------------------------------------------------- LM scores


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\0"]


def brute(texts, order=3, discount=0.75):
    """(known, base, score) of each text and N, by dictionaries: every n-gram counts, none is left out."""
    words = {i: tokens(t) for i, t in texts.items()}
    seen = [w for i, w in words.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = {n: Counter(tuple(x[i : i + n]) for x in seen for i in range(len(x) - n + 1)) for n in range(1, order + 1)}
    total, distinct = sum(counts[1].values()), len(counts[1])
    taken = defaultdict(float)
    for n in range(2, order + 1):
        for g in counts[n]:
            taken[g[:-1]] += counts[n][g] - discount
    out = {}
    for i, x in words.items():
        base = [(counts[1].get((w,), 0) + 1) / (total + distinct + 1) for w in x]
        score = 0.0
        for j, p in enumerate(base):
            for n in range(2, min(order, j + 1) + 1):
                context = tuple(x[j - n + 1 : j])
                c = counts[n - 1].get(context, 0)
                if c:
                    p = max(counts[n].get((*context, x[j]), 0) - discount, 0) / c + (1 - taken[context] / c) * p
            score += math.log10(p)
        out[i] = len(x), sum((w,) in counts[1] for w in x), sum(map(math.log10, base)), score
    return out, total


def compare(spark, texts, **sizes):
    expected, total = brute(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = lm.lm_scores(docs, **sizes).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, known, base, score = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and abs(r.score - score) < 1e-3 * n  # codes are rounded
    return {r.doc_id: r for r in rows}


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 50, "shard_grams": 512}])
def test_scores_of_the_table(spark, sf, sizes):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40 if sizes else 200)
    compare(spark, {d.doc_id: d.text for d in docs.collect()}, **sizes)


def test_words_and_pairs_that_many_shards_share(spark):
    """One word begins half of all triples, one pair a quarter, each with many followers."""
    texts = {i: " ".join(f"hot {'pair' if j % 2 else f'b{j % 7}'} w{(i * 31 + j * 7) % 400}" for j in range(60)) for i in range(60)}
    compare(spark, texts, shard_words=40, shard_grams=256)


def test_the_trie_beats_single_words_on_held_out_texts(spark, sf):
    rows = [r for r in registry.op2_lm_scores(spark, sf).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_every_ngram_counts(spark):
    """A passage that two texts share, of words seen nowhere else, is known as a whole; so is one that is there once."""
    shared, once = [" ".join(f"{p}{i}" for i in range(12)) for p in "sy"]
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2][:20]
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    texts = {i: prose(i, 30) for i in ids} | {ids[0]: shared, ids[1]: shared, ids[2]: once, held[0]: shared, held[1]: once}
    rows = compare(spark, texts)
    assert all(rows[i].score > rows[i].base_score + 10 for i in (*ids[:3], *held))
    assert rows[held[0]].score > rows[held[1]].score


def test_stretches_of_long_texts_add_up():
    """Blocks of a few tokens count each triple once and skip what was counted."""
    texts = pa.array(["a b c d e f g h i j k", None, "a b", "", "x " * 30, "y"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), texts], names=["doc_id", "text"])
    found = {}
    for size in (1000, 7, 5):
        triples, counted = Counter(), Counter()
        for b in lm._blocks(iter([batch]), size):
            keys, _ = b.triples(b.distinct()[1] + 1)
            hashes = [*b.hashes.tolist(), 0, 0]
            triples.update((hashes[i], hashes[i + 1] * (hashes[i] != 1), key & 1 >= 0) for i, key in enumerate(keys.tolist()) if b.counted()[i])
            for row, a, z, skip in zip(b.rows, b.starts, b.starts[1:], b.skips, strict=False):
                counted[row[0]] += int(z - a - skip)
        found[size] = triples, counted
    assert found[1000] == found[7] == found[5] and found[5][1] == {0: 12, 1: 1, 2: 3, 3: 1, 4: 31, 5: 2}


def test_long_texts_in_stretches_score_the_same(spark, monkeypatch):
    texts = {i: prose(i, 60) for i in range(20)} | {90: prose(90, 400), 91: prose(91, 333)}
    model = lm.learn(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    batch = pa.RecordBatch.from_arrays([pa.array([90, 91]), pa.array([texts[90], texts[91]])], names=["doc_id", "text"])
    sums = {}
    for size in (10_000, 50, 3):
        total = Counter()
        for block in lm._blocks(iter([batch]), size):
            for row, *found in zip(block.rows, *model.scores(block), strict=True):
                total.update({(row[0], k): x for k, x in enumerate(found)})
        sums[size] = [round(total[i, k], 6) for i in (90, 91) for k in range(4)]
    assert sums[50] == sums[3] == sums[10_000]


def test_more_shards_than_files_that_may_be_open(spark, monkeypatch):
    """Many hundreds of tiny shards, looked up by a process that may hold few of them open, score as one does."""
    import resource

    texts = {i: prose(i, 400) for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    many, one = lm.learn(docs, shard_words=4, shard_grams=16), lm.learn(docs)
    assert len(many.trie.directory["shards"]) + 2**many.trie.words.bits > 350
    monkeypatch.setattr(elias_fano, "MOST_MAPPED", 32)
    batch = pa.RecordBatch.from_arrays([pa.array(list(texts)), pa.array(list(texts.values()))], names=["doc_id", "text"])
    scores = lambda model: [x for block in lm._blocks(iter([batch])) for x in model.scores(block)[3].tolist()]
    want, limits = scores(one), resource.getrlimit(resource.RLIMIT_NOFILE)
    import os

    resource.setrlimit(resource.RLIMIT_NOFILE, (max(map(int, os.listdir("/proc/self/fd"))) + 100, limits[1]))
    try:
        found = scores(many)
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, limits)
    assert np.allclose(found, want, atol=0.05 * 400) and len(many.trie._mapped.held) <= 32


def test_lm_of_odd_documents(odd, empty):
    rows = lm.lm_scores(odd).collect()
    assert len(rows) == len(ODD) + 1 and all(r.n_tokens >= 1 and r.score <= 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1}
    assert lm.lm_scores(empty).collect() == []
    assert [r.base_score for r in lm.lm_scores(odd.where("doc_id = 999").union(odd.limit(0))).collect()] == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = lm.lm_scores(odd.where("doc_id = 9").limit(1).selectExpr(f"{held}L AS doc_id", "text")).collect()  # nothing to learn from
    assert (r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0.0, 0.0)


def test_hashes_of_long_words_and_columns(monkeypatch):
    text = prose(4, 3000) + " " + "y" * 2000 + " end"
    whole = lm.word_hashes(text)
    monkeypatch.setattr(lm, "TEXT_BYTES", 700)
    lm._powers.cache_clear()
    assert lm.word_hashes(text).tolist() == whole.tolist() and len(set(whole.tolist())) == len(set(text.split()))
    monkeypatch.undo()
    lm._powers.cache_clear()
    assert lm.word_hashes("Ab\x0bab").tolist() == [lm.word_hashes("ab")[0]] * 2
    texts = ["ab", "cd e", None, "", " f", "g", "\n", "ÄÖ x\x1cy"]
    hashes, starts = lm.hashes_of(pa.array(["zz", *texts, "q"]).slice(1, len(texts)))
    assert [hashes[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [lm.word_hashes(t).tolist() for t in texts]


# -------------------------------------------------------------- subword models


def test_ngrams_stay_inside_words():
    data = b" ab cde "
    buffer = np.frombuffer(data + b" " * 8, np.uint8)
    starts = [p.tolist() for p, _ in subword.ngrams(buffer, len(data), (1, 4), 16)]
    want = [[i for i in range(len(data)) if (g := (data + b" " * 8)[i : i + n]).strip() and b" " not in g[1:-1] and (n > 2 or g != b"  ") and (n > 1 or g != b" ")] for n in (1, 2, 3, 4)]
    assert starts == want


def plain_ngrams(data, sizes, bits):
    """(start, bucket) of each n-gram of bytes between spaces, one by one."""
    out, whole = [], data + b" " * (sizes[1] + 1)
    for i in range(len(data)):
        h = whole[i] * 0x01000193 % 2**32
        for n in range(1, sizes[1] + 1):
            if n > 1:
                h = (h ^ whole[i + n - 1]) * 0x01000193 % 2**32
                h ^= h >> 15
            g = whole[i : i + n]
            if n >= sizes[0] and b" " not in g[1:-1] and g.strip():
                out.append((i, (h * 0x9E3779B1 + n * 0x85EBCA6B) % 2**32 >> (32 - bits)))
    return out


def test_letters():
    assert subword.letters("Ha, HA ha!x É9\n") == "ha ha ha x é".encode()
    assert subword.letters(None) == b"" == subword.letters("12 %")


def test_a_word_said_many_times_judges_once():
    assert toxicity.letters("Ha ha HA! you, you ha x x") == b"ha you ha x"
    assert subword.letters("Ha ha HA!") == b"ha ha ha"


def test_cells_add_up_over_passes(monkeypatch):
    model = subword.Softmax(np.random.default_rng(0).standard_normal((1 << 10, 2)).astype(np.float32), np.zeros(2), (2, 4), 10)
    data = subword.letters(prose(5, 400))
    whole = model.cell_sums(data, 32)
    monkeypatch.setattr(subword, "PASS_BYTES", 96)
    parts = model.cell_sums(data, 32)
    assert np.allclose(whole[0], parts[0]) and whole[1].tolist() == parts[1].tolist()


def test_bags_hold_every_ngram_whatever_the_passes(monkeypatch):
    data = subword.letters(prose(6, 300))
    want = Counter(b for _, b in plain_ngrams(b" " + data, (2, 4), 10))
    for size in (1 << 20, 100):
        monkeypatch.setattr(subword, "PASS_BYTES", size)
        buckets, counts = subword.bag(data, (2, 4), 10)
        assert dict(zip(buckets.tolist(), counts.tolist(), strict=True)) == want
    assert subword.bag(b"", (1, 4), 16)[0].tolist() == []


def test_scores_equal_those_ngram_by_ngram(spark, sf):
    """A language's probability and a toxicity score from the table of logits, text by text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    told, bad = language.learn(docs), toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    for text in [*(r.text[:3000] for r in docs.limit(12).collect()), "Ein Wort", "a", "", None, "12", "é" * 40]:
        data = subword.letters(text)
        rows = [told.model.table[b].astype(float) for _, b in plain_ngrams(b" " + data, language.SIZES, language.BITS)]
        lang, share = told.predict(text)
        if data:
            e = np.exp((np.mean(rows, axis=0) + told.model.bias) / told.heat)
            assert lang == told.names[int(e.argmax())] and math.isclose(share, (e / e.sum()).max(), rel_tol=1e-6)
        else:
            assert (lang, share) == ("und", 0.0)
        sums = defaultdict(float)
        counts = Counter()
        data = toxicity.letters(text)
        for at, b in plain_ngrams(data, toxicity.SIZES, toxicity.BITS):
            sums[at // toxicity.CELL] += float(bad.model.table[b, 1]) - float(bad.model.table[b, 0])
            counts[at // toxicity.CELL] += 1
        cells = -(-len(data) // toxicity.CELL)
        logits = [(sums[i] + sums[i + 1]) / max(counts[i] + counts[i + 1], 8) for i in range(max(cells - 1, min(cells, 1)))] or [0.0]
        worst = max(logits) + bad.model.bias[1] - bad.model.bias[0]
        assert math.isclose(bad.score(text), 1 / (1 + math.exp(-(bad.slope * worst + bad.shift))), rel_tol=1e-5, abs_tol=1e-9)


def test_languages_of_equal_probability():
    model = subword.Softmax(np.zeros((1 << language.BITS, 2), np.float32), np.zeros(2), language.SIZES, language.BITS)
    assert language.Language(model, ["de", "en"]).predict("tie") == ("de", 0.5)


def test_no_language_is_left_out(spark):
    """Rows of one hot language, of many rare ones, repeated rows and repeated ids."""
    words = {f"l{i:02d}": [f"{chr(97 + i % 26)}{chr(97 + i // 26)}{x}" for x in ("mo", "ka", "tu", "re")] for i in range(70)}
    rows = [(i, " ".join(words["l00"][(i + j) % 4] for j in range(30)), "l00") for i in range(900)]
    rows += [(1000 + 10 * k + i, " ".join(w[(i + j) % 4] for j in range(20)), lang) for k, (lang, w) in enumerate(words.items()) if k for i in range(8)]
    rows += [rows[-1]] * 50 + [(rows[-2][0], "other words", rows[-2][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.learn(docs, sample_rows=40)
    assert model.names == sorted(words)
    assert sum(model.predict(" ".join(w))[0] == lang for lang, w in words.items()) >= 65
    with pytest.raises(ValueError, match="languages"):
        language.fit([(f"{i}", [subword.bag(b"a", language.SIZES, language.BITS)] * 2) for i in range(language.MOST_LANGUAGES + 1)])


def test_a_sample_of_long_texts_stays_within_its_bytes(spark):
    """Long texts of random words: the driver is sent no more than it asks for, of every language something, and of short texts all."""
    from pyspark.sql import functions as F

    word = F.expr("array_join(transform(sequence(1, 6000), j -> substring(sha2(concat(id, ':', j), 256), 1, 9)), ' ')")
    docs = spark.range(160).select(F.col("id").alias("doc_id"), word.alias("text"), F.concat(F.lit("l"), F.col("id") % 4).alias("lang")).repartition(4)
    size = lambda df: sum(len(r.buckets) + len(r.counts) for r in df.collect())
    whole = size(language.sampled(docs))
    assert whole > 2 << 20
    for most in (1 << 20, 1):
        rows = language.sampled(docs, sample_bytes=most)
        largest = max(r[0] for r in rows.groupBy("lang", "hash").agg(F.sum(F.length("buckets") + F.length("counts"))).select(F.col("sum((length(buckets) + length(counts)))")).collect())
        assert size(rows) <= most + 4 * largest and rows.select("lang").distinct().count() == 4
    few = docs.where("doc_id < 40").withColumn("text", F.substring("text", 1, 60))
    assert language.sampled(few, sample_bytes=4 << 20).select("hash").distinct().count() == few.where("crc32(cast(doc_id as string)) % 5 <> 0").count()


def toxic_corpus():
    bad = ["idiot", "moron", "scum"]
    texts, labels = [], []
    for i in range(300):
        words = prose(i, 60 + i % 50).split()
        if i % 4 == 0:
            words[i % 37] = bad[i % 3] + "s" * (i % 2)
        texts.append(subword.letters(" ".join(words)))
        labels.append(int(i % 4 == 0))
    return texts, np.array(labels)


def fitted(texts, labels):
    """What learn() does without Spark."""

    def look(model):
        found = [toxicity.chosen(t, label, model) for t, label in zip(texts, labels.tolist(), strict=True)]
        return [[toxicity.window(t, p) for p in places] for t, (places, _) in zip(texts, found, strict=True)], [worst for _, worst in found]

    return toxicity.fit(labels, look)


def test_later_rounds_look_at_all_of_a_long_text():
    model = fitted(*toxic_corpus())
    data = subword.letters(prose(960, 6000))
    data = data[:20_007] + b" idiots " + data[20_007:]
    places, worst = toxicity.chosen(data, 1, model)
    assert any(b"idiot" in toxicity.window(data, p) for p in places) and worst == model.worst(data)
    assert not any(b"idiot" in toxicity.window(data, p) for p in toxicity.spread(data, 64))
    assert max(toxicity.spread(data, 64)) > 0.9 * len(data) / toxicity.CELL and len(toxicity.spread(data, 64)) == 64
    assert toxicity.chosen(b"", 0, model) == ([], model.worst(b"")) and toxicity.chosen(b"", 0, None)[0] == [0]


def test_toxicity_finds_unseen_spellings():
    model = fitted(*toxic_corpus())
    assert model.score(prose(900, 500) + " Idiotz " + prose(901, 300)) > 0.5 > model.score(prose(902, 800))
    assert 0 <= model.score("") <= 1 and 0 <= model.score(None) <= 1
    assert model.score("x" * 10_000) == model.score("x" * 10_000) < 0.5


def test_toxicity_with_one_class_or_none(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0, 1), (3, 0, 1), (None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.toxicity(odd, labels).collect()} <= {(1.0, 1), (0.0, 0)}
    assert {r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(empty, labels).collect() == []


def test_toxicity_of_the_table(spark, sf):
    folder = Path(sf).parent / "sf0.01"
    rows = registry.op9_toxicity(spark, str(folder)).collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.doc_id in truth and r.held_out]
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert len(held) > 50 and sum(p == t for p, t in held) >= 0.95 * len(held)


def test_languages_of_the_table(spark, sf):
    rows = registry.op3_language(spark, sf).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held)


def test_languages_of_odd_documents(odd, empty):
    rows = {r.doc_id: r for r in language.languages(odd).collect()}
    assert [(rows[i].lang_pred, rows[i].score) for i in (0, 1, 2, 3)] == [("und", 0.0)] * 4
    assert len(language.languages(odd).collect()) == odd.count()
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert language.languages(empty).collect() == []
    assert {r.lang_pred for r in language.languages(odd.where("lang is null")).collect()} == {"und"}
