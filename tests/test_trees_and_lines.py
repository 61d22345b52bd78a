import hashlib
import json

import pytest

from lodestar.functions import merkle
from lodestar.sources import lines, manifest
from lodestar.session import Watch


def leaf(i):
    return hashlib.sha256(str(i).encode()).hexdigest()


def plain_tree(leaves, fanout):
    """Levels of {position: digest} of one group, in one process."""
    levels, highest = [dict(leaves)], max(leaves)
    while highest:
        up = {}
        for p in sorted(levels[-1]):
            up[p // fanout] = up.get(p // fanout, "") + levels[-1][p]
        levels.append({p: hashlib.sha256(d.encode()).hexdigest() for p, d in up.items()})
        highest //= fanout
    return levels


def frame(spark, groups):
    return spark.createDataFrame([(g, p, d) for g, own in groups.items() for p, d in own.items()], "g string, position long, digest string")


def test_trees_differences_and_proofs(spark):
    one = {"a": {i: leaf(i) for i in range(70) if i % 9}, "b": {3: leaf(3)}, "c": {i: leaf(-i) for i in range(5)}}
    nodes = merkle.tree(frame(spark, one), ["g"], 4)
    found = {(r.g, r.level, r.position): r.digest for r in nodes.collect()}
    want = plain_tree(one["a"], 4)
    assert {(lv, p): d for (g, lv, p), d in found.items() if g == "a"} == {(lv, p): d for lv, own in enumerate(want) for p, d in own.items()}
    assert {r.g: r.digest for r in merkle.roots(nodes, ["g"]).collect()} == {g: found[g, 4, 0] for g in one}
    two = {"a": {**one["a"], 33: leaf("x"), 69: leaf("y")}, "b": dict(one["b"]), "c": {i: d for i, d in one["c"].items() if i != 2}}
    other = merkle.differing(nodes, merkle.tree(frame(spark, two), ["g"], 4), ["g"], 4).collect()
    assert {(r.g, r.position) for r in other if r.level == 0} == {("a", 33), ("a", 69), ("c", 2)}
    assert {(r.g, r.position) for r in other if r.level == 2} == {("a", 2), ("a", 4), ("c", 0)} and len(other) < 20
    part = frame(spark, {"a": {p: one["a"][p] for p in (1, 34, 35)}, "b": one["b"], "c": {0: one["c"][0]}})
    beside = merkle.proof(nodes, part, ["g"], 4)
    assert beside.where("g = 'a'").count() <= 3 * 3 * 4
    assert {r.g: r.digest for r in merkle.climbed(part, beside, ["g"], 4, 4).collect()} == {g: found[g, 4, 0] for g in one}
    lie = frame(spark, {"a": {1: leaf("lie")}})
    assert merkle.climbed(lie, merkle.proof(nodes, lie, ["g"], 4), ["g"], 4, 4).first().digest != found["a", 4, 0]
    assert merkle.tree(frame(spark, {}), ["g"]).count() == 0


def entry(i, ordinal=None, **more):
    return json.dumps({"ordinal": i if ordinal is None else ordinal, "relative_path": f"p{i}", "source_path": "/x"} | more)


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_are_numbered_across_splits(spark, tmp_path, small_splits):
    texts = [f"line {i} " + "x" * (i * 37 % 90) if i % 7 else "" for i in range(399)]
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.txt").write_text("\n".join(texts[:250]) + "\n")
    (tmp_path / "f/b.txt").write_text("\n".join(texts[250:]))
    found = lines.numbered(spark, f"file://{tmp_path}/f").collect()
    assert len({(r.file, r.begin) for r in found}) > 20
    assert [r.value for r in sorted(found, key=lambda r: r.number)] == texts and sorted(r.number for r in found) == list(range(399))
    assert {(r.file[-5:], r.line, r.value) for r in found} == {(f"{'a' if i < 250 else 'b'}.txt", i + 1 if i < 250 else i - 249, t) for i, t in enumerate(texts)}


def test_manifest_faults_name_their_lines(spark, tmp_path, small_splits):
    file = tmp_path / "m.jsonl"
    rows = [entry(i) for i in range(60)]
    file.write_text("\n".join([*rows[:20], "", " ", *rows[20:]]) + "\n")
    assert manifest.read(spark, f"file://{file}").count() == 60  # blank lines are no fault
    for at, bad, words in ((31, "{oops", "isn't a JSON object"), (40, entry(40, relative_path=None), "lacks relative_path"), (45, entry(45, "45x"), "isn't a JSON object"), (50, entry(50, 51), "has ordinal 51"), (0, "[]", "isn't a JSON object")):
        file.write_text("\n".join([*rows[:at], bad, *rows[at + 1 :]]))
        with pytest.raises(ValueError, match=f"m.jsonl line {at + 1} {words}"):
            manifest.read(spark, f"file://{file}")
    file.write_text("\n".join([rows[0], "", "{", rows[2], entry(3, 9), entry(4, 4)]))
    assert [(r.line, r.problem.split(" ")[0]) for r in manifest.faults(spark, f"file://{file}").orderBy("line").collect()] == [(3, "isn't"), (5, "has")]
    file.write_text("")
    assert manifest.read(spark, f"file://{file}").count() == 0


def test_watching_grows_and_ends():
    import time

    numbers, heard = iter([1, 1, 3, 2, 3, 5]), []
    with Watch(lambda: next(numbers, 7), heard.append, 0.01):
        time.sleep(0.3)
    assert heard == [1, 3, 5, 7]

    def fails(n):
        raise InterruptedError

    with pytest.raises(InterruptedError), Watch(lambda: 1, fails, 0.01):
        time.sleep(0.1)
    with pytest.raises(KeyError), Watch(lambda: 0, fails, 0.01):
        raise KeyError
