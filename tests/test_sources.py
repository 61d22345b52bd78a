import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from lodestar.functions import checks, digests, paths
from lodestar.functions.queries import Query, Unchanged, frame, numbered
from lodestar.operators import metrics
from lodestar.sources import manifest, reports, settings, tree


def test_discovery_order_and_kinds(spark, tmp_path):
    tree_ = {"Maps/north.tif": 1, "Maps/old/1890.BMP": 1, "maps2/.hidden.jpeg": 1, "maps2/readme.md": 0, "beta.JPEG": 1, "Alpha.webp": 1, "alpha.webp": 1, "plan.pdf": 0, ".png": 0, "-x.bmp": 1}
    for name in tree_:
        path = tmp_path / "e" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    (tmp_path / "e/again.webp").symlink_to(tmp_path / "e/Alpha.webp")
    (tmp_path / "e/elsewhere").symlink_to(tmp_path / "e/Maps")
    found, errors = tree.discover(spark, tmp_path / "e")
    rows = found.orderBy("ordinal").collect()
    walked = ["-x.bmp", "Alpha.webp", "alpha.webp", "beta.JPEG", "Maps/north.tif", "Maps/old/1890.BMP", "maps2/.hidden.jpeg"]
    assert [r.relative_path for r in rows] == walked and len(walked) == sum(tree_.values())
    assert [r.ordinal for r in rows] == list(range(7)) and errors.count() == 0
    few, _ = tree.discover(spark, tmp_path / "e", 3)
    assert [r.relative_path for r in few.orderBy("ordinal").collect()] == walked[:3]
    assert tree.discover(spark, tmp_path / "e", 0)[0].count() == 0
    with pytest.raises(ValueError):
        tree.discover(spark, tmp_path / "e", -1)
    with pytest.raises(Exception, match="no such folder"):
        tree.discover(spark, tmp_path / "none")[0].count()


def test_manifest_round_trip_and_refusals(spark, tmp_path):
    (tmp_path / "e").mkdir()
    rows = spark.createDataFrame([(1, "b", "/b"), (0, "é", "/é")], "ordinal long, relative_path string, source_path string")
    with pytest.raises(ValueError, match="outside evidence"):
        manifest.write(rows, f"file://{tmp_path}/e/m", tmp_path / "e")
    assert not (tmp_path / "e/m").exists()
    manifest.write(rows, f"file://{tmp_path}/m", tmp_path / "e")
    assert [r.relative_path for r in manifest.read(spark, f"file://{tmp_path}/m").orderBy("ordinal").collect()] == ["é", "b"]
    manifest.write(rows.withColumn("ordinal", F.col("ordinal") + 2), f"file://{tmp_path}/gap")
    with pytest.raises(ValueError, match="contiguous"):
        manifest.read(spark, f"file://{tmp_path}/gap")


def test_every_shape_of_tree_is_walked(spark, tmp_path, monkeypatch):
    """A chain of folders, a folder of many folders, links, a folder that can't be read: in rounds, whatever a task's share."""
    import os
    from pathlib import Path

    top, want = tmp_path / "e", set()
    deep = top / "one"
    for i in range(60):
        deep = deep / f"d{i}"
        deep.mkdir(parents=True)
        (deep / "x.png").touch()
        want.add(str(deep.relative_to(top) / "x.png"))
    for i in range(150):
        wide = top / "one/wide" / f"w{i}"
        wide.mkdir(parents=True)
        for name in ("a.JPG", "b.txt"):
            (wide / name).touch()
        want.add(f"one/wide/w{i}/a.JPG")
    os.symlink(deep, top / "link")
    os.symlink(deep / "x.png", top / "link.png")
    gone = tree.Walk(str(top), (".png",), 99)
    found = [r for b in gone(iter([tree.pa.RecordBatch.from_pydict({"folder": [str(top / "none"), str(deep)]})])) for r in b.to_pylist()]
    assert {(Path(r["source_path"]).name, r["error_type"]) for r in found} == {("none", "FileNotFoundError"), ("x.png", None)}
    for first, later in ((1 << 20, 1), (40, 60)):
        monkeypatch.setattr(tree, "FIRST", first)
        monkeypatch.setattr(tree, "LATER", later)
        rows = tree.scan(spark, top).collect()
        assert {r.relative_path for r in rows} == want and len(rows) == len(want)
    share = [b.num_rows for b in tree.Walk(str(top), (".jpg",), 20)(iter([tree.pa.RecordBatch.from_pydict({"folder": [str(top / "one/wide")]})]))]
    assert sum(share) == 150  # one folder's entries go to one task, what is in its folders to others


def test_case_folding_of_every_character(spark):
    import sys

    every = "".join(chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and chr(c) != "/")
    texts = [every[i : i + 997] for i in range(0, len(every), 997)] + ["Straße", "ΟΔΟΣ", "plain ASCII [x]", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", paths.fold(F.col("t")).alias("f")).collect()
    assert all(r.f == r.t.casefold() for r in rows)
    names = ["ß/B", "SS/a", "ss.png", "Ss/ﬀ.png", "ς", "Σ/Z"]
    keys = {r.p: [(k.is_dir, k.fold, k.name) for k in r.k] for r in spark.createDataFrame([(n,) for n in names], "p string").select("p", paths.walk_key(F.col("p")).alias("k")).collect()}
    assert all(keys[n] == [(int(i < n.count("/")), p.casefold(), p) for i, p in enumerate(n.split("/"))] for n in names)


def test_a_report_is_one_file_in_order_that_no_driver_wrote(spark, tmp_path):
    rows = spark.range(1000).select(F.format_string("é\"%d\n", "id").alias("FilePath"), F.lit("q,x").alias("Query"), (F.col("id") / 7).alias("SigLIP2Score"), (F.col("id") * 389 % 1000).cast("int").alias("Rank"), F.lit("m").alias("Model"), F.lit(None).cast("string").alias("Revision")).repartition(7)
    assert reports.write_csv(rows, reports.ALL_RESULTS, ["Rank"], tmp_path / "r.csv") == 1000
    want = io.StringIO(newline="")
    out = csv.writer(want)
    out.writerow(reports.ALL_RESULTS)
    for r in sorted(rows.collect(), key=lambda r: r.Rank):
        out.writerow([r.FilePath, r.Query, f"{r.SigLIP2Score:.6f}", r.Rank, r.Model, ""])
    assert (tmp_path / "r.csv").read_bytes() == want.getvalue().encode("utf-8-sig")
    assert reports.write_csv(rows.limit(0), reports.ALL_RESULTS, ["Rank"], tmp_path / "e.csv") == 0
    assert (tmp_path / "e.csv").read_bytes() == (",".join(reports.ALL_RESULTS) + "\r\n").encode("utf-8-sig")
    with pytest.raises(Exception, match="no good"):
        reports.write_csv(rows.withColumn("Rank", F.raise_error(F.lit("no good")).cast("int")), reports.ALL_RESULTS, ["Rank"], tmp_path / "x.csv")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["e.csv", "r.csv"]


def test_error_journal(spark, tmp_path):
    path = f"file://{tmp_path}/errors"
    journal = reports.ErrorJournal(spark, path)
    with pytest.raises(RuntimeError, match="opened"):
        journal.record("decode", "clip", "too early")
    with journal:
        assert (tmp_path / "errors/_SUCCESS").exists()
        journal.record("decode", "clip", OSError("broken"))
        journal.record("discovery", None, {"path": "/x", "error_type": "PermissionError", "tries": 2})
        journal.record("decode", "siglip2", spark.createDataFrame([(3, "bad")], "ordinal long, message string"))
    found = {(r.phase, r.model_id, r.message, r.path, r.ordinal) for r in spark.read.json(path).collect()}
    assert found == {("decode", "clip", "broken", None, None), ("discovery", None, None, "/x", None), ("decode", "siglip2", "bad", None, 3)}


def test_bitmaps_of_passes_are_merged_without_the_passes(spark, tmp_path):
    import random

    pick = random.Random(1)
    path, seen = f"file://{tmp_path}/bits", set()
    for n in range(3):
        rows = [(pick.choice(["clip", "siglip2"]), pick.choice([pick.randrange(50), pick.randrange(200_000), None]), pick.choice(["processed", "decode_error", None])) for _ in range(400)]
        metrics.record_pass(spark.createDataFrame(rows, "model_id string, ordinal long, status string"), path)
        seen |= {r for r in rows if None not in r}
    bits = metrics.recorded(spark, path)
    count = lambda status, model=None: len({o for m, o, s in seen if s == status and model in (None, m)})
    assert tuple(metrics.covered(bits).first()) == (count("processed"), count("decode_error"))
    assert {r.model_id: (r.processed, r.decode_errors) for r in metrics.covered(bits, "model_id").collect()} == {m: (count("processed", m), count("decode_error", m)) for m in ("clip", "siglip2")}
    assert tuple(metrics.scan_metrics(spark.createDataFrame([], "model_id string, ordinal long, status string")).first()) == (0, 0)


def test_a_journal_is_followed_commit_by_commit(spark, tmp_path):
    from lodestar.streaming import chain

    def arrive(n, rows):
        made = spark.createDataFrame([(m, s, a, b, b - a, 1, "x", "t") for m, s, a, b in rows], "model_id string, sequence int, start long, `end` long, valid_count long, error_count long, rows_sha256 string, committed_at string")
        made.coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
        assert chain.follow(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/check") == n
        return {(r.model_id, r.sequence, r.start): (r.linked, r.prefix, r.valid, r.errors) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}

    arrive(1, [("clip", 1, 2, 5), ("clip", 0, 0, 2), ("siglip2", 0, 0, 4)])
    found = arrive(1, [("clip", 2, 5, 6), ("siglip2", 1, 5, 6), ("siglip2", 2, 4, 5)])
    assert found["clip", 2, 5] == (True, 6, 6, 3) and found["clip", 0, 0] == (True, 2, 2, 1)
    assert found["siglip2", 1, 5] == (False, 4, 4, 1) and found["siglip2", 2, 4] == (False, 4, 4, 1)
    assert arrive(1, [("clip", 2, 6, 7), ("clip", 3, 6, 7)])["clip", 2, 6] == (False, 6, 6, 3)  # a number that came before breaks it
    assert len(found) == 6


def test_contiguity_of_an_empty_manifest(spark):
    assert checks.require_contiguous(spark.createDataFrame([], "ordinal long")) == 0


def test_paths():
    assert paths.is_within("/a/b/c", "/a/b") and not paths.is_within("/a/bc", "/a/b")
    with pytest.raises(ValueError):
        paths.require_disjoint("/a/b", "/a")


@pytest.mark.parametrize("root, shown", [(None, "/s/x/y.png"), ("E:\\", "E:\\x\\y.png"), ("E:/case/", "E:\\case\\x\\y.png"), ("E:", "E:x\\y.png")])
def test_display_path(spark, root, shown):
    row = spark.createDataFrame([("x/y.png", "/s/x/y.png")], "r string, s string")
    assert row.select(paths.display(F.col("r"), F.col("s"), root).alias("p")).first().p == shown


def test_suffixes(spark):
    rows = spark.createDataFrame([("a/B.JPG",), (".jpg",), ("a.b/c",), ("x.tar.gz",)], "p string")
    assert [r.s for r in rows.select(paths.suffix(F.col("p")).alias("s")).collect()] == [".jpg", "", "", ".gz"]


def test_queries(spark):
    made = Unchanged().process(["Es un perro", "Es un robot", "Es un perro"])
    assert [q.query_id for q in made] == ["q0001", "q0002", "q0003"] and made[2].original_query == "Es un perro"
    assert frame(spark, made).count() == 3
    with pytest.raises(ValueError):
        Query("q", " ", "x")
    with pytest.raises(ValueError):
        Unchanged().process([])
    with pytest.raises(Exception, match="blank"):
        numbered(spark.createDataFrame([(0, " ")], "p int, t string"), "p", "t").collect()


def test_csv_bytes(spark, tmp_path):
    rows = spark.createDataFrame([('a "b"', "q", 0.1234565, 1, "m", None)], "FilePath string, Query string, SigLIP2Score double, Rank int, Model string, Revision string")
    reports.write_csv(rows, reports.ALL_RESULTS, ["Rank"], tmp_path / "r.csv")
    data = (tmp_path / "r.csv").read_bytes()
    assert data.startswith(b"\xef\xbb\xbfFilePath,") and data.endswith(b'\r\n"a ""b""",q,0.123457,1,m,\r\n'.replace(b"0.123457", f"{0.1234565:.6f}".encode()))
    reports.write_parts(rows, reports.ALL_RESULTS, ["Rank"], f"file://{tmp_path}/parts")
    part = next((tmp_path / "parts").glob("*.csv"))
    assert list(csv.reader(part.open(newline="")))[1] == ['a "b"', "q", f"{0.1234565:.6f}", "1", "m", ""]


def test_env_files(tmp_path):
    (tmp_path / ".env").write_text("# c\n\nA = 'x y'\nB=3\nC=\n")
    got = settings.read_env(tmp_path / ".env")
    assert got == {"A": "x y", "B": "3", "C": ""}
    assert settings.whole_number(got, "B") == 3 and settings.whole_number(got, "C", 7) == 7
    for bad in (lambda: settings.required(got, "C"), lambda: settings.whole_number(got, "A"), lambda: settings.whole_number(got, "B", least=4)):
        with pytest.raises(settings.SettingError):
            bad()


def test_digests(tmp_path):
    digests.write_json(tmp_path / "x.json", {"b": 1, "a": 2})
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": 2, "b": 1}
    assert digests.canonical({"b": 1, "a": 2}) == digests.canonical({"a": 2, "b": 1})
    seal, digest = digests.seal(tmp_path / "x.json"), digests.of_file(tmp_path / "x.json")
    size = (tmp_path / "x.json").stat().st_size
    digests.require_sealed(tmp_path / "x.json", size, digest, seal, False, "x")
    data = (tmp_path / "x.json").read_bytes()
    (tmp_path / "x.json").write_bytes(data[:-2] + b" \n")
    with pytest.raises(ValueError, match="hash mismatch"):
        digests.require_sealed(tmp_path / "x.json", size, digest, seal, False, "x")
    with pytest.raises(ValueError, match="name"):
        digests.require_same({"name": 1}, {"name": 2}, ["name"])


def test_plain_values():
    from dataclasses import dataclass
    from pathlib import Path

    import numpy as np

    @dataclass
    class Pair:
        a: int
        b: object

    value = {"x": Pair(1, {Path("/p"), "q"}), 2: np.float64(0.5), "w": np.arange(3), "z": b"1", "f": digests.seal}
    flat = digests.plain(value)
    assert flat["x"]["b"] == ["/p", "q"] and flat["2"] == 0.5 and flat["w"]["shape"] == [3] and flat["f"].endswith("digests.seal")
    assert json.loads(json.dumps(flat)) == flat and digests.canonical(value) == digests.canonical(dict(reversed(value.items())))
    assert digests.canonical({"w": np.arange(3)}) != digests.canonical({"w": np.arange(3.0)})


def test_digests_by_ranges(spark):
    rows = spark.range(50).selectExpr("id % 2 AS k", "id", "CAST(id AS string) AS t")
    whole = [{r.k: (r.rows, r.digest) for r in digests.by_ranges(rows.repartition(n), ["k"], F.col("t").cast("binary"), F.col("id"), 8).collect()} for n in (1, 7)]
    assert whole[0] == whole[1] and {v[0] for v in whole[0].values()} == {25}
    other = digests.by_ranges(rows.where("id <> 49"), ["k"], F.col("t").cast("binary"), F.col("id"), 8)
    changed = {r.k: r.digest for r in other.collect()}
    assert changed[0] == whole[0][0][1] and changed[1] != whole[0][1][1]


def test_a_failed_file_leaves_nothing(tmp_path):
    with pytest.raises(KeyError), digests.atomic(tmp_path / "x") as f:
        f.write(b"half")
        raise KeyError
    assert list(tmp_path.iterdir()) == []


def test_metrics_of_passes(spark):
    rows = [("siglip2", 0, "processed"), ("siglip2", 1, "processed"), ("siglip2", 2, "decode_error"), ("clip", 0, "processed"), ("clip", 2, "processed"), ("clip", 1, "decode_error"), ("clip", 0, "processed")]
    passes = spark.createDataFrame(rows, "model_id string, ordinal long, status string")
    assert {r.model_id: (r.processed, r.decode_errors) for r in metrics.pass_metrics(passes).collect()} == {"siglip2": (2, 1), "clip": (2, 1)}
    whole = metrics.scan_metrics(passes).first()
    assert (whole.processed, whole.decode_errors) == (3, 2)
    assert {(r.model_id, r.status): r.ordinals for r in metrics.bitmap_counts(passes).collect()}["clip", "processed"] == 2


def test_commit_chains(spark):
    def chain(rows):
        return metrics.commit_totals(spark.createDataFrame([("clip", s, a, b, b - a, 0) for s, a, b in rows], "model_id string, sequence int, start long, `end` long, valid_count long, error_count long")).first()

    good = chain([(0, 0, 2), (1, 2, 5)])
    assert (good.chain_ok, good.committed_prefix, good.valid) == (True, 5, 5)
    assert not chain([(0, 0, 2), (1, 3, 5)]).chain_ok and not chain([(0, 0, 2), (2, 2, 5)]).chain_ok and not chain([(0, 0, 0)]).chain_ok
