import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import language, resemblance, simhash, stages, toxicity
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Prose in two languages with toxic texts, texts without letters and copies; and the tables' folder."""
    rows = []
    for i in range(120):
        text = prose(i, 80)
        rows.append((i, f"{text} idiot {text[:40]}" if i % 6 == 0 else text, "en", "s", len(text)))
    rows += [(200, "12 !! 34", "en", "s", 8), (201, None, "en", "s", 0), (202, rows[1][1], "en", "s", 0), (203, rows[1][1] + "\n", "en", "s", 0), (203, rows[1][1], "en", "s", 0)]
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}"


def test_stages_take_effect(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    calm = stages.drop_toxic(spark, docs, corpus)
    assert calm.columns == docs.columns
    ids = {r.doc_id for r in calm.collect()}
    assert not ids & set(range(0, 120, 6)) and ids >= set(range(1, 120)) - set(range(0, 120, 6))
    told = stages.drop_unknown_language(spark, calm, corpus)
    assert {r.doc_id for r in told.collect()} == ids - {200, 201} and told.columns == docs.columns
    one = stages.drop_near_duplicates(spark, told, corpus)
    kept = [r.doc_id for r in one.collect()]
    assert sorted(kept) == sorted(ids - {200, 201, 202, 203}) and one.columns == docs.columns


def firsts_of(texts):
    """The smallest id of each cluster of texts whose sets of five-word shingles have a similarity of 0.8 or more, by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(len(words) - 4, min(len(words), 1)))}
    label = {i: i for i in sorted(sets)}
    changed = True
    while changed:
        changed = False
        for i in label:
            near = min(label[j] for j in label if sets[i] == sets[j] or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
            changed |= near < label[i]
            label[i] = near
    return set(label.values())


def test_run_equals_the_operators_one_after_another(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {d.doc_id: d.text for d in docs.collect()}
    bad = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.predicted}
    docs = docs.where(~docs.doc_id.isin(list(bad)))
    model = language.learn(docs)
    told = {i for i, t in texts.items() if i not in bad and (p := model.predict(t))[0] != "und" and p[1] >= model.floor}
    docs = docs.where(docs.doc_id.isin(list(told)))
    firsts = firsts_of({i: texts[i] for i in told})
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == firsts
    for i in firsts:
        parts = sorted((r.start, r.length, r.doc_tokens) for r in rows if r.doc_id == i)
        assert sum(p[1] for p in parts) == parts[0][2]


def test_empty_and_odd_documents(spark, corpus, odd, empty):
    wide = odd.selectExpr("doc_id", "text", "lang", "'s' AS source", "1L AS n_chars", "score", "fingerprint", "rank")
    for docs in (wide, wide.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, corpus)
            assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert stages.pack(spark, docs, corpus).columns[:2] == ["doc_id", "start"]


def test_rows_without_an_id_are_rows_like_any_other(spark, corpus):
    docs = spark.createDataFrame([(None, "a b c", "en"), (None, "a b c", "en"), (1, "a b c", "en"), (2, "a b c", "en"), (None, "d e f", "en"), (None, "d e f", "en")], "doc_id long, text string, lang string")
    assert sorted((str(r.doc_id), r.text) for r in stages.drop_near_duplicates(spark, docs, corpus).collect()) == [("1", "a b c"), ("None", "d e f")]


def test_a_column_named_like_the_files_metadata(spark, corpus, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", "m", 7), (2, "a b c", "n", 8), (3, "d", "o", 9)], "doc_id long, text string, _metadata string, place int")
    docs.write.parquet(f"file://{tmp_path}/docs")
    for d in (docs, spark.read.parquet(f"file://{tmp_path}/docs")):
        assert sorted(map(tuple, stages.drop_near_duplicates(spark, d, corpus).collect())) == [(1, "a b c", "m", 7), (3, "d", "o", 9)]


def test_near_copies_of_similar_words_go(spark, corpus):
    words = prose(7, 200).split()
    changed = [[*words[:i], "other", *words[i + 1 :]] for i in (30, 90, 160)]  # similarity 191 / 201
    half = [w if i < 100 else w + "x" for i, w in enumerate(words)]
    rows = [(i, " ".join(x), "en") for i, x in enumerate([words, *changed, half])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len({simhash.fingerprint(t) for _, t, _ in rows}) == 5
    assert sorted(r.doc_id for r in stages.drop_near_duplicates(spark, docs, corpus).collect()) == [0, 4]


def test_a_large_cluster_of_near_copies_hangs_together(spark, corpus):
    words = prose(8, 150).split()
    rows = [(i, " ".join([*words[: i % 140], f"own{i}", *words[i % 140 + 1 :]]), "en") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r.doc_id for r in stages.drop_near_duplicates(spark, docs, corpus).collect()] == [0]


def test_similarity_is_that_of_sets_of_five_words():
    a, b = "a b c d e f g a b c d e", "A  b c d e\nf g"
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a.split(), b.lower().split())]
    assert resemblance.similarity(resemblance.shingles(a), resemblance.shingles(b)) == len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert resemblance.keys(resemblance.shingles(None)) == [] and len(resemblance.shingles("a b")) == 1


def test_rows_that_share_an_id_are_rows_like_any_other(spark, corpus):
    a, b, c = prose(20, 40), prose(21, 40), prose(22, 40)
    rows = [(1, a, "en"), (1, b, "en"), (2, b, "en"), (3, c, "en"), (3, c, "en"), (4, a, "en")]
    for some in (rows, rows[::-1]):
        docs = spark.createDataFrame(some, "doc_id long, text string, lang string")
        assert sorted((r.doc_id, r.text) for r in stages.drop_near_duplicates(spark, docs, corpus).collect()) == sorted([(1, a), (1, b), (3, c)])


def test_a_crowded_key_hides_no_pair(spark, corpus, monkeypatch):
    """All texts share their only key; each is similar to one other, some to one of another size."""
    rows = []
    for i in range(150):
        words = prose(1000 + i, 40 + i).split()
        more = [f"own{i}", *(f"more{i}x{j}" for j in range(i % 8))]
        rows += [(2 * i, " ".join(words), "en"), (2 * i + 1, " ".join([*words, *more]), "en")]
    expected = firsts_of({i: t for i, t, _ in rows})
    assert len(expected) == 150
    monkeypatch.setattr(resemblance, "keys", lambda own: [7] if len(own) else [])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in stages.drop_near_duplicates(spark, docs, corpus).collect()} == expected
    monkeypatch.setattr(resemblance, "BLOCK_TEXTS", 20, raising=False)
    assert {r.doc_id for r in stages.drop_near_duplicates(spark, docs, corpus).collect()} == expected


def test_a_crowded_key_makes_no_row_for_each_pair(spark, corpus, monkeypatch):
    docs = spark.createDataFrame([(i, prose(2000 + i, 30), "en") for i in range(300)], "doc_id long, text string, lang string")
    made, write = {}, resemblance.written

    def counted(df, label):
        out = write(df, label)
        made[label] = max(made.get(label, 0), out.count())
        return out

    monkeypatch.setattr(resemblance, "keys", lambda own: [7])
    monkeypatch.setattr(resemblance, "written", counted)
    assert stages.drop_near_duplicates(spark, docs, corpus).count() == 300
    assert made["shared"] == 300 and max(made.values()) <= 300, made


def test_one_cluster_but_for_a_stray_is_not_compared_with_itself(spark, monkeypatch):
    """Blocks and jobs of a crowd: every two members of different clusters and near sizes meet, those of a large cluster don't."""
    import random

    pick = random.Random(6)
    monkeypatch.setattr(resemblance, "BLOCK_TEXTS", 20)
    rows = [(key, pick.randrange(-(1 << 63), 1 << 63), pick.choice([50, 60, 61, 80, 400]), 7) for key in (1, 2) for _ in range(600)]
    rows += [(1, 5, 55, 5)] + [(2, pick.randrange(-(1 << 63), 1 << 63), pick.choice([50, 61]), root) for root in range(100, 140)]
    met = spark.createDataFrame(rows, "key long, digest long, size long, root long")
    blocks = {r.id: r for r in resemblance._blocks(met).collect()}
    jobs = resemblance._jobs(spark.createDataFrame(list(blocks.values()))).collect()
    assert sorted(blocks) == list(range(len(blocks))) and sum(len(b.members) for b in blocks.values()) == len(rows)
    assert max(len(b.members) for b in blocks.values()) < 60 and all(j.last - j.first < resemblance.RUN for j in jobs)
    pairs = [(j.id, other) for j in jobs for other in range(j.first, j.last + 1)]
    assert len(pairs) == len(set(pairs))
    met_ = {frozenset((blocks[a].key, m, n)) for a, b in pairs for m in blocks[a].members for n in blocks[b].members}
    steps = {d: (k, int(__import__("math").log(size) // resemblance.STEP), root) for k, d, size, root in rows}
    for a in rows[::7] + rows[-41:]:
        for b in rows[-41:]:
            if a[0] == b[0] and a[1] != b[1] and a[3] != b[3] and abs(steps[a[1]][1] - steps[b[1]][1]) <= 1:
                assert frozenset((a[0], a[1], b[1])) in met_
    own = [b for b in blocks.values() if b.key == 1]
    assert sum(blocks[a].key == 1 for a, _ in pairs) <= len(own) + 1  # in proportion to the members


def test_most_of_all_rows_are_copies_and_share_no_task(spark, corpus):
    """Of ten thousand copies in eight partitions no step joins more than its share in one."""
    from lodestar.llm.common import spread

    big = spark.range(12_000).select(F.when(F.col("id") < 10_000, 3).otherwise(F.col("id")).alias("cluster"), "id").repartition(8)
    big.write.mode("overwrite").parquet(f"{corpus}/big")
    big = spark.read.parquet(f"{corpus}/big")
    small = big.groupBy("cluster").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("cluster <> 10500")
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    made = spread(big, small, "cluster")
    assert sorted(map(tuple, made.collect())) == sorted((r.cluster, r.id, 0 if r.cluster == 3 else r.cluster) for r in big.where("cluster <> 10500").collect())
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    for k, v in before.items():
        spark.conf.set(k, v)
    assert max(sizes) < 12_000 / 4
    rows = [(i, "the very same text of a few words" if i % 10 else prose(i, 30), "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = stages.drop_near_duplicates(spark, docs, corpus)
    assert sorted(r.doc_id for r in kept.collect()) == sorted([1, *range(0, 3000, 10)])


def test_sets_are_matched_as_one_by_one():
    words = prose(30, 120).split()
    texts = [" ".join([*words[: 3 * i], *(f"w{i % 7}x{j}" for j in range(i % 11)), *words[3 * i + i % 5 :]]) for i in range(38)] + [prose(31, 9)]
    sets = [resemblance.shingles(t) for t in texts]
    for one, other in ((sets, sets), (sets[:7], sets[5:]), (sets[-1:], sets[:3])):
        assert resemblance.matches(one, other).tolist() == [[resemblance.similarity(a, b) >= resemblance.SIMILAR for b in other] for a in one]


def test_near_duplicates_let_the_drivers_heap_shrink(spark, corpus):
    """The plans of jobs that are over are given back round by round, not kept until the heap is full."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    stages.drop_near_duplicates(spark, spark.read.parquet(f"{corpus}/documents.parquet"), corpus)
    assert full() >= before + 2
