import csv
import json

import pytest

from lodestar import cli
from lodestar.functions.queries import Unchanged
from lodestar.plans import index, lifecycle, search
from lodestar.streaming import ingest
from tests import fakes

QUERIES = Unchanged().process(["bright", "dark"])


def build(spark, tmp_path, stretches=4, **more):
    return index.build(spark, tmp_path / "e", tmp_path / "ix", fakes.FACTORIES, checkpoint_rows=2, batch=2, decoder=fakes.brightness, stretches=stretches, **more)


def test_progress_and_size(spark, tmp_path):
    fakes.evidence(tmp_path / "e", (1, 2, 3))
    heard = []
    build(spark, tmp_path, 1, progress=lambda *x: heard.append(x))
    assert heard == [(f"index-{m}{end}", n, 3) for m in ("siglip2", "clip") for n, end in ((2, ""), (3, ""), (3, "-complete"))]
    assert index.size_bytes(tmp_path / "ix") > 1000


def test_a_build_of_many_small_stretches_has_few_jobs_and_tasks(spark, tmp_path, monkeypatch):
    """Jobs go by rows, not by stretches; a task has a run of stretches, each with a file and a commit of its own."""
    fakes.evidence(tmp_path / "e", tuple(range(1, 91)))
    jobs, plain = [], index.commit_stretches

    def heard(spark, paths, meta, encoded, model_id, begin, end, size):
        jobs.append((model_id, begin, end, encoded.rdd.getNumPartitions()))
        plain(spark, paths, meta, encoded, model_id, begin, end, size)

    monkeypatch.setattr(index, "commit_stretches", heard)
    index.build(spark, tmp_path / "e", tmp_path / "ix", fakes.FACTORIES, checkpoint_rows=2, batch=2, decoder=fakes.brightness)
    assert jobs == [(m, 0, 90, 16) for m in ("siglip2", "clip")]
    commits = index.journal(spark, tmp_path / "ix").where("model_id = 'clip'").orderBy("sequence").collect()
    assert [(c.sequence, c.start, c.end) for c in commits] == [(i, 2 * i, 2 * i + 2) for i in range(45)]
    found = index.rows(spark, tmp_path / "ix")
    assert found.groupBy("model_id").count().collect() and found.select("model_id", "ordinal").distinct().count() == found.count() == 180
    assert not any("start=" in f for f in found.inputFiles())


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("built")
    fakes.evidence(folder / "e")
    return folder, build(spark, folder)


def test_build(spark, built):
    folder, done = built
    assert (done.state, done.image_count) == ("COMPLETE", 4)
    assert done.models == {m: {"valid": 3, "decode_errors": 1, "pending": 0} for m in ("siglip2", "clip")}
    rows = index.rows(spark, folder / "ix").where("model_id = 'clip'").orderBy("ordinal").collect()
    assert [r.state for r in rows] == [1, 1, 1, 2] and rows[3].error_type == "ValueError"
    assert index.pending(spark, folder / "ix").count() == 0
    assert index.verify(spark, folder / "ix", full=True).checks[-1][1]


def test_a_direct_search_deals_its_images_over_all_cores(spark, built, tmp_path, monkeypatch):
    """However few bytes the manifest has: before, all its rows were one task's."""
    folder, _ = built
    parts, plain = [], search.images.encode
    monkeypatch.setattr(search.images, "encode", lambda manifest, *more: parts.append(manifest.rdd.getNumPartitions()) or plain(manifest, *more))
    search.direct(spark, folder / "e", tmp_path / "d.csv", QUERIES, fakes.FACTORIES, search.Settings(top_k=2), decoder=fakes.brightness)
    assert parts == [16, 16]


def test_an_index_is_copied_by_tasks(spark, built, tmp_path, monkeypatch):
    """The driver copies what isn't rows; the copy is the same."""
    ix, copy, held = (built[0] / "ix").resolve(), tmp_path / "copy", []
    plain = lifecycle.shutil.copytree
    monkeypatch.setattr(lifecycle.shutil, "copytree", lambda *given, **more: (plain(*given, **more), held.append((copy / "rows").exists())))
    lifecycle._copied(spark, ix, copy)
    files = lambda root: {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}
    assert held and not any(held) and files(copy) == files(ix) and len(list(copy.glob("rows/*/start=*/rows.parquet"))) == 4


def keys(outcome):
    return {(r.file_id, r.query_id) for r in outcome.frames.fused.collect()}


def test_indexed_search_equals_direct_search_and_encodes_no_image(spark, built, tmp_path):
    folder, _ = built
    settings = search.Settings(top_k=2, evaluator_top_k=1)
    one = search.indexed(spark, folder / "ix", tmp_path / "i.csv", QUERIES, fakes.BLIND, settings, tmp_path / "f.csv")
    two = search.direct(spark, folder / "e", tmp_path / "d.csv", QUERIES, fakes.FACTORIES, settings, tmp_path / "g.csv", decoder=fakes.brightness)
    assert keys(one) == {(2, "q0001"), (1, "q0001"), (0, "q0002"), (1, "q0002")} == keys(two)
    shown = [[r[:-1] for r in csv.reader(p.open(encoding="utf-8-sig", newline=""))] for p in (tmp_path / "i.csv", tmp_path / "d.csv")]
    assert shown[0] == shown[1] and len(shown[0]) == 5
    assert one.final_rows == two.final_rows == 2
    run = json.loads((tmp_path / "i.csv.run.json").read_text())
    assert run["state"] == "COMPLETE" and len(run["reports"]) == 2
    assert two.metrics["any"] == {"processed": 3, "decode_errors": 1}
    assert "4 audit rows" in search.summary(one)
    with pytest.raises(ValueError, match="outside"):
        search.indexed(spark, folder / "ix", folder / "ix/r.csv", QUERIES, fakes.BLIND)
    with pytest.raises(ValueError, match="together"):
        search.indexed(spark, folder / "ix", tmp_path / "x.csv", QUERIES, fakes.BLIND, final_output=tmp_path / "y.csv")


def test_full_ranking_of_one_model(spark, built, tmp_path):
    count, ranked = search.all_results(spark, built[0] / "e", tmp_path / "a.csv", QUERIES, fakes.siglip2, decoder=fakes.brightness)
    assert count == 6
    assert [r.file_id for r in ranked.where("query_id = 'q0001'").orderBy("rank").collect()] == [2, 1, 0]


def test_resume_after_a_lost_build(spark, tmp_path, monkeypatch):
    fakes.evidence(tmp_path / "e")
    real, calls = index.commit_stretches, []

    def fails(*args):
        calls.append(args)
        if len(calls) == 2:
            raise KeyboardInterrupt
        real(*args)

    monkeypatch.setattr(index, "commit_stretches", fails)
    with pytest.raises(KeyboardInterrupt):
        build(spark, tmp_path, 1)
    monkeypatch.setattr(index, "commit_stretches", real)
    with (tmp_path / "ix/journal.jsonl").open("a") as f:
        f.write('{"sequence": 1, "mod')
    with pytest.raises(ValueError, match="COMPLETE"):
        index.verify(spark, tmp_path / "ix", require_complete=True)
    assert index.pending(spark, tmp_path / "ix").count() == 6
    done = build(spark, tmp_path, resume=True)
    assert done.state == "COMPLETE" and done.models["clip"]["valid"] == 3
    with pytest.raises(ValueError, match="BUILDING"):
        build(spark, tmp_path, resume=True)


def test_resume_checks_the_manifest_before_loading_a_model(spark, tmp_path):
    fakes.evidence(tmp_path / "e")
    index.start(spark, tmp_path / "e", tmp_path / "ix")
    part = next((tmp_path / "ix/manifest").glob("*.parquet"))
    rows = spark.read.parquet(f"file://{part}").toPandas()
    rows["size"] += 1
    rows.to_parquet(part)
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="hash mismatch"):
        index.build(spark, tmp_path / "e", tmp_path / "ix", {m: lambda: pytest.fail("loaded") for m in fakes.FACTORIES}, resume=True)


def test_a_flipped_byte_is_found_without_full(spark, tmp_path):
    fakes.evidence(tmp_path / "e", (10, 200))
    build(spark, tmp_path)
    part = next((tmp_path / "ix/rows").rglob("*.parquet"))
    data = bytearray(part.read_bytes())
    data[len(data) // 2] ^= 1
    part.write_bytes(data)
    with pytest.raises(ValueError, match="hash mismatch"):
        index.verify(spark, tmp_path / "ix")


def test_changed_evidence_ends_the_build(spark, tmp_path):
    fakes.evidence(tmp_path / "e")
    index.start(spark, tmp_path / "e", tmp_path / "ix")
    (tmp_path / "e/0.png").write_text("11")
    with pytest.raises(Exception, match="evidence changed"):
        build(spark, tmp_path, resume=True)


def test_refusals(spark, tmp_path):
    fakes.evidence(tmp_path / "e", ())
    with pytest.raises(ValueError, match="no image of a known type"):
        build(spark, tmp_path)
    fakes.evidence(tmp_path / "e", ("bad", "worse"))
    with pytest.raises(RuntimeError, match="no image could be decoded"):
        build(spark, tmp_path)
    with pytest.raises(FileExistsError):
        build(spark, tmp_path)
    with pytest.raises(ValueError, match="order"):
        index.build(spark, tmp_path / "e", tmp_path / "iy", {"clip": fakes.clip, "siglip2": fakes.siglip2})


def test_stream_goes_on_where_it_was(spark, tmp_path):
    fakes.evidence(tmp_path / "e", (1, 2, 3))
    index.start(spark, tmp_path / "e", tmp_path / "ix")
    manifest, rows, check = (f"file://{tmp_path}/{x}" for x in ("ix/manifest", "rows", "check"))
    ingest.encode_stream(spark, manifest, rows, check, fakes.clip, decoder=fakes.brightness)
    assert spark.read.parquet(rows).count() == 3
    assert ingest.encode_stream(spark, manifest, rows, check, fakes.clip, decoder=fakes.brightness) == 0
    more = index.manifest(spark, tmp_path / "ix").selectExpr("ordinal + 3 AS ordinal", "relative_path", "source_path", "size", "mtime_ns", "sha256")
    more.write.mode("append").parquet(manifest)
    assert ingest.encode_stream(spark, manifest, rows, check, fakes.clip, decoder=fakes.brightness) > 0
    assert ingest.progress(spark.read.parquet(rows).drop("batch")).first().processed == 6


BASE = ["search", "--query", "x", "--encoder", "tests.fakes:make", "--device", "cpu"]


@pytest.mark.parametrize(
    "argv, words",
    [
        ([*BASE, "--direct"], "--directory is needed"),
        (BASE, "--index is needed"),
        ([*BASE, "--index", "i", "--top-k", "0"], "--top-k is 0"),
        ([*BASE, "--index", "i", "--rrf-constant", "-1"], "takes 0 or more"),
        ([*BASE, "--index", "i", "--final-output", "f"], "needs the other"),
        ([*BASE, "--index", "i", "--output", "f", "--final-output", "f", "--evaluator-top-k", "1"], "the same file"),
        ([*BASE, "--direct", "--directory", "/tmp", "--output", "/x", "--evaluator-rrf-constant", "1"], "without --final-output"),
        ([*BASE, "--directory", "/tmp", "--output", "/x", "--all-results", "--top-k", "3"], "no use for --top-k"),
        ([*BASE, "--index", "i", "--min-percent", "3"], "no --min-percent"),
        ([*BASE, "--index", "i", "--max-images", "3", "--clip-model", "m"], "settled --max-images, --clip-model"),
        ([*BASE, "--direct", "--directory", "/tmp", "--output", "/x", "--chunk-rows", "3"], "search of an index"),
        ([*BASE, "--index", "i", "--chunk-rows", "0"], "--chunk-rows is 0"),
        ([*BASE, "--index", "i", "--parts"], "--parts is for"),
        ([*BASE, "--direct", "--directory", "/tmp", "--output", "/tmp/x.csv"], "names a place in the evidence"),
        ([*BASE, "--direct", "--directory", "/none"], "no such folder"),
    ],
)
def test_argument_faults(argv, words):
    assert any(words in f for f in cli.faults(cli.parser().parse_args(argv)))


def test_command_line(spark, built, tmp_path, capsys):
    folder, _ = built
    assert cli.main(["verify", "--index", str(folder / "ix"), "--full"], spark) == 0
    argv = ["search", "--index", str(folder / "ix"), "--query", "bright", "--query", "dark", "--top-k", "2", "--output", str(tmp_path / "c.csv"), "--encoder", "tests.fakes:make", "--device", "cpu", "--chunk-rows", "2"]
    assert cli.main(argv, spark) == 0
    said = capsys.readouterr()
    assert "4 audit rows" in said.out and "lodestar search" in said.err and "query: bright, dark" in said.err
    assert cli.duration(3661.4) == "01:01:01" and cli.duration(-1) == "00:00:00"


def test_a_model_cache_in_the_evidence_is_refused(tmp_path, monkeypatch):
    monkeypatch.setenv("HF_HOME", str(tmp_path / "models"))
    args = cli.parser().parse_args([*BASE, "--direct", "--directory", str(tmp_path), "--output", "/x"])
    assert any("HF_HOME" in f for f in cli.faults(args))


def test_devices_names_and_revisions_reach_the_encoder(monkeypatch, tmp_path):
    monkeypatch.chdir(tmp_path)
    (tmp_path / ".env").write_text("CLIP_REVISION=r7\nSIGLIP2_REVISION=\n")
    assert cli.factories("tests.fakes:make", "cpu")["clip"]().revision == "r7"
    (tmp_path / ".env").write_text("OPENAI_CLIP_REVISION='r8'\nCLIP_REVISION=r7\n")
    assert cli.factories("tests.fakes:make", "cpu")["clip"]().revision == "r8"
    monkeypatch.setenv("CLIP_REVISION", "r9")
    made = {m: f() for m, f in cli.factories("tests.fakes:make", "cpu", {"siglip2": "other"}).items()}
    assert (made["siglip2"].name, made["siglip2"].revision, made["clip"].name, made["clip"].revision) == ("other", "r1", "fake", "r9")
    with pytest.raises(SystemExit, match="no cuda"):
        cli.require_device("cuda", type("M", (), {"available": staticmethod(lambda device: device == "cpu")}))


def test_another_encoder_of_the_same_name_is_told_apart():
    import numpy as np

    facts = []
    for weights in (np.arange(4.0), np.arange(4.0) + 1, np.arange(4.0)):
        e = fakes.siglip2()
        e.weights = {"layer": [weights, {"deep": b"x"}]}
        facts.append(index.identity(e))
    assert facts[0] == facts[2] and facts[0]["weights"] != facts[1]["weights"] and facts[0]["digest"] != facts[1]["digest"]


def test_many_stretches_in_one_job(spark, tmp_path):
    fakes.evidence(tmp_path / "e", range(1, 8))
    done = index.build(spark, tmp_path / "e", tmp_path / "ix", fakes.FACTORIES, 2, 2, decoder=fakes.brightness, stretches=3)
    commits = index.read_journal(tmp_path / "ix/journal.jsonl")
    assert [(c["model_id"], c["sequence"], c["start"], c["end"]) for c in commits] == [(m, i, 2 * i, min(2 * i + 2, 7)) for m in ("siglip2", "clip") for i in range(4)]
    assert done.seconds.keys() == {"siglip2", "clip"} and all(r > 0 for r in done.rates().values()) and done.metadata["environment"]["packages"]["numpy"]
    part = next((tmp_path / "ix/rows/model_id=clip/start=4").glob("*.parquet"))
    part.unlink()
    with pytest.raises(ValueError, match="missing"):
        index.verify(spark, tmp_path / "ix")


def test_one_file_for_each_stretch_and_no_drafts(spark, built):
    folder, _ = built
    files = sorted(p.relative_to(folder / "ix/rows").as_posix() for p in (folder / "ix/rows").rglob("*") if p.is_file())
    assert files == [f"model_id={m}/start={s}/rows.parquet" for m in ("clip", "siglip2") for s in (0, 2)]
    commits = index.journal(spark, folder / "ix").collect()
    assert len(commits) == 4 and all(c.file_size > 0 and len(c.file_sha256) == len(c.rows_sha256) == 64 for c in commits)


class Failing(fakes.Fake):
    """Fails at one image, after others of the same stretch were written."""

    def encode_images(self, images):
        if 3 in images:
            raise RuntimeError("out of memory")
        return super().encode_images(images)


def test_a_task_that_fails_leaves_nothing_that_counts(spark, tmp_path):
    fakes.evidence(tmp_path / "e", (1, 2, 3, 4))
    with pytest.raises(Exception, match="out of memory"):
        index.build(spark, tmp_path / "e", tmp_path / "ix", {"siglip2": lambda: Failing("siglip2"), "clip": fakes.clip}, 4, 1, decoder=fakes.brightness)
    assert not [p for p in (tmp_path / "ix/rows").rglob("*") if p.is_file()] and not (tmp_path / "ix/journal.jsonl").read_bytes()
    assert index.build(spark, tmp_path / "e", tmp_path / "ix", fakes.FACTORIES, 4, 1, decoder=fakes.brightness, resume=True).state == "COMPLETE"


def test_the_sink_refuses_stretches_that_are_not_whole(tmp_path):
    import pyarrow as pa

    from lodestar.sources import stretches

    journal, rows = tmp_path / "j", tmp_path / "rows"
    journal.touch(), rows.mkdir()
    options = {"rows": rows, "journal": journal, "model_id": "clip", "begin": 0, "end": 4, "size": 2, "sequence": 0}

    def batch(ordinals, vectors=None):
        data = {"ordinal": ordinals, "state": [1] * len(ordinals), "embedding": vectors or [[1.0, 0.0]] * len(ordinals), "error_type": None, "message": None}
        return pa.RecordBatch.from_pydict({k: pa.array(v if v is not None else [None] * len(ordinals), stretches.SCHEMA.field(k).type) for k, v in data.items()})

    writer = stretches.StretchWriter({k: str(v) for k, v in options.items()})
    good = writer.write(iter([batch([0]), batch([1, 2]), batch([3])]))
    for bad in ([good.lines[0]], [good.lines[0], good.lines[0]], [good.lines[0], writer.write(iter([batch([3])])).lines[0]]):
        with pytest.raises(RuntimeError, match="other rows"):
            writer.commit([stretches.Stretches([dict(x) for x in bad])])
    odd = writer.write(iter([batch([2, 3], [[1.0], [1.0]])]))
    with pytest.raises(RuntimeError, match="several dimensions"):
        writer.commit([stretches.Stretches([dict(good.lines[0])]), stretches.Stretches([dict(odd.lines[0])])])
    assert not journal.read_bytes()
    again = writer.write(iter([batch([0, 1, 2, 3])]))
    assert [x["rows_sha256"] for x in again.lines] == [x["rows_sha256"] for x in good.lines]  # however rows come in batches
    writer.commit([again, None])
    assert [c["start"] for c in index.read_journal(journal)] == [0, 2]
    t = stretches.tally(rows / "start=2/rows.parquet")
    assert (t.rows, t.lowest, t.highest, t.odd, t.long, t.digest()) == (2, 2, 3, 0, 0, again.lines[1]["rows_sha256"])
    wrong = stretches.Tally()
    wrong.add(batch([0, 1, 2], [[float("nan"), 1.0], [2.0, 0.0], [0.0, 1.0]]))
    assert (wrong.odd, wrong.long) == (1, 1)


def test_damage_is_located_and_parts_are_proved(spark, tmp_path):
    fakes.evidence(tmp_path / "e", range(1, 41))
    index.build(spark, tmp_path / "e", tmp_path / "ix", fakes.FACTORIES, 2, 2, decoder=fakes.brightness)
    assert index.damaged(spark, tmp_path / "ix").collect() == []
    assert index.stored_tree(spark, tmp_path / "ix").where("model_id = 'clip'").groupBy("level").count().orderBy("level").collect() == [(0, 20), (1, 2), (2, 1)]
    assert index.verify_part(spark, tmp_path / "ix", "clip", 5, 9) == 3
    part = tmp_path / "ix/rows/model_id=clip/start=6/rows.parquet"
    other = (tmp_path / "ix/rows/model_id=siglip2/start=6/rows.parquet").read_bytes()
    part.write_bytes(other[:40] + b"x" + other[41:])
    (tmp_path / "ix/rows/model_id=siglip2/start=38/rows.parquet").unlink()
    assert sorted(map(tuple, index.damaged(spark, tmp_path / "ix").collect())) == [("clip", 6, 8), ("siglip2", 38, 40)]
    assert index.verify_part(spark, tmp_path / "ix", "clip", 10, 40) == 15
    with pytest.raises(ValueError, match="mismatch of rows/model_id=clip/start=6"):
        index.verify_part(spark, tmp_path / "ix", "clip", 5, 9)
    meta = json.loads((tmp_path / "ix/index.json").read_text())
    meta["models"]["clip"]["rows_root"] = "0" * 64
    (tmp_path / "ix/index.json").write_text(json.dumps(meta))
    with pytest.raises(ValueError, match="root"):
        index.verify_part(spark, tmp_path / "ix", "clip", 10, 12)


def test_a_bad_line_of_the_journal_is_named(spark, tmp_path):
    fakes.evidence(tmp_path / "e", (1, 2))
    build(spark, tmp_path)
    journal = tmp_path / "ix/journal.jsonl"
    journal.write_text(journal.read_text() + '{"sequence": 1}\n')
    with pytest.raises(ValueError, match="journal line 3 lacks model_id"):
        index.journal(spark, tmp_path / "ix")
    journal.write_text(journal.read_text().replace('{"sequence": 1}\n', '{"sequence": 1'))
    assert index.journal(spark, tmp_path / "ix").count() == 2


def test_a_full_ranking_in_parts(spark, built, tmp_path):
    heard = []
    count, _ = search.all_results(spark, built[0] / "e", tmp_path / "parts", QUERIES, fakes.siglip2, decoder=fakes.brightness, parts=True, progress=lambda *x: heard.append(x))
    shown = [r for p in sorted((tmp_path / "parts").glob("*.csv")) for r in list(csv.reader(p.open(newline="")))[1:]]
    assert count == 6 == len(shown) and [r[3] for r in shown] == ["1", "2", "3"] * 2
    assert settled(heard) == [("encoding-siglip2-complete", 4, 4), ("reports", 6, 6)]


def settled(heard):
    """What was heard when a phase was over; what was heard while models encoded grows up to all, and never comes after their end."""
    for model in ("siglip2", "clip"):
        own = [(phase, done) for phase, done, _ in heard if phase.startswith(f"encoding-{model}")]
        if own:
            numbers = [done for _, done in own[:-1]]
            assert numbers == sorted(set(numbers)) and numbers[-1] == own[-1][1] and own[-1][0].endswith("-complete")
    return [x for x in heard if x[0] not in ("encoding-siglip2", "encoding-clip")]


def test_progress_of_searches(spark, built, tmp_path):
    heard = []
    search.direct(spark, built[0] / "e", tmp_path / "d.csv", QUERIES, fakes.FACTORIES, search.Settings(2), decoder=fakes.brightness, progress=lambda *x: heard.append(x))
    assert settled(heard) == [("discovery", 4, 4), ("encoding-siglip2-complete", 4, 4), ("encoding-clip-complete", 4, 4), ("ranking", 2, 2), ("reports", 4, 4)]
    heard.clear()
    search.indexed(spark, built[0] / "ix", tmp_path / "i.csv", QUERIES, fakes.BLIND, search.Settings(2), progress=lambda *x: heard.append(x))
    assert heard == [("ranking", 2, 2), ("reports", 4, 4)]


class Bomb(Exception):
    pass


Bomb.__name__ = "DecompressionBombError"


def explode(data):
    if data == b"100":
        raise Bomb("too many pixels")
    return fakes.brightness(data)


def test_a_decompression_bomb_is_a_row(spark, tmp_path):
    fakes.evidence(tmp_path / "e")
    listed = spark.createDataFrame([(i, str(tmp_path / f"e/{i}.png")) for i in range(4)], "ordinal long, source_path string")
    rows = index.images.encode(listed, fakes.clip, decoder=explode).orderBy("ordinal").collect()
    assert [r.state for r in rows] == [1, 2, 1, 2] and rows[1].error_type == "DecompressionBombError"


def test_decoding_turns_upright_and_to_rgb(monkeypatch):
    """The image library isn't here: a stand-in says what is asked of it."""
    import sys
    import types

    asked = []

    class Image:
        def __enter__(self):
            return self

        def __exit__(self, *x):
            asked.append("closed")

        def convert(self, mode):
            asked.append(mode)
            return [[[1, 2, 3]]]

    pil = types.ModuleType("PIL")
    pil.Image = types.SimpleNamespace(open=lambda f: asked.append(f.read()) or Image())
    pil.ImageOps = types.SimpleNamespace(exif_transpose=lambda image: asked.append("turned") or image)
    monkeypatch.setitem(sys.modules, "PIL", pil)
    assert index.images.decode(b"data").tolist() == [[[1, 2, 3]]]
    assert asked == [b"data", "turned", "RGB", "closed"]


def test_counting_by_task_is_not_changed_by_retries(spark):
    done = index.images.counter(spark)
    spark.sparkContext.parallelize([(0, 5), (1, 3), (0, 5), (1, 2)], 4).foreach(lambda x: done.add({x[0]: x[1]}))
    assert index.images.counted(done) == 8
