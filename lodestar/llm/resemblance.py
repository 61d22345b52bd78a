"""Near-duplicates by the resemblance of texts: the Jaccard similarity of their sets of five-word shingles.

Candidates share a key.  The fuzzy keys of simhash.py, made of the fingerprint of
these shingles, meet any two texts whose fingerprints differ in two bits or less.  Texts
of similarity 0.8 differ in about ten of 64 bits, too many for Golay words: so
each text has keys of minima as well, each a hash of ROWS minima of the shingles'
hashes under different permutations (MinHash), one for each of BANDS bands.  Two
texts of similarity s share one with probability 1 - (1 - s^ROWS)^BANDS, 0.9998 at 0.8.

Every pair is verified by its sets as they are, and only pairs that can still
join two clusters are.  For a few rounds each key offers its members outside
its first cluster (that with the least digest) the least member of it, and each text
is compared with the one that most of its keys offer: near copies of one
text hang together after that.  Then, for keys whose members still lie
in several clusters, all pairs between these are compared.  Those of keys with more than PAIRS_UP_TO
members are never made as rows: members are dealt to blocks by their numbers of shingles, a task
maps the sets of two blocks, counts what each two have in common at once, and returns one link for
each member that has any.  Blocks whose numbers of shingles are too far apart don't meet.
Texts with equal sets share a digest and are never paired.
"""

from __future__ import annotations

import atexit
import math
import shutil
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import simhash
from lodestar.llm.common import arrow_rows, release, shared_dir, spread, written
from lodestar.llm.components import components
from lodestar.llm.elias_fano import dump, load
from lodestar.llm.lm import word_hashes
from lodestar.operators.ranking import ordinals
from lodestar.session import few

#: Words of a shingle and the least similarity of near-duplicates.
WIDTH, SIMILAR = 5, 0.8
#: Keys of minima of a text, and minima of a key.
BANDS, ROWS = 16, 4
#: Rounds in which each text is compared with one other.
ROUNDS = 2
#: Texts of a key up to which its pairs become rows; the most texts and shingles that a block of larger ones has on average.
PAIRS_UP_TO, BLOCK_TEXTS, BLOCK_SHINGLES = 32, 512, 1 << 19
#: Blocks that one row of jobs compares a block with.
RUN = 16
#: Shingles of a file of sets. Two texts that can be similar lie in the same or in adjacent steps of the logarithm of their sizes.
SHARD_SHINGLES, STEP = 1 << 21, -math.log(SIMILAR - 0.01)
#: Pairs of members that share a shingle up to which they are counted one by one, and shingles of a matrix for the others.
LIGHT, WIDE = 32, 1 << 11
#: Shingles whose permuted hashes are held at once.
BLOCK = 1 << 12

_U = np.uint64
_draw = np.random.default_rng(42)
#: Of each permutation the odd factor and the shift, and the factors that mix a band's minima.
_FACTORS = _draw.integers(0, 1 << 63, BANDS * ROWS, _U) * _U(2) + _U(1)
_SHIFTS = _draw.integers(0, 1 << 63, BANDS * ROWS, _U)
_BAND = _draw.integers(0, 1 << 63, ROWS, _U) * _U(2) + _U(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's shingles; fewer words than WIDTH make one shingle, none make none."""
    words = word_hashes(text).astype(_U)
    if not len(words):
        return words
    width = min(WIDTH, len(words))
    out = np.full(len(words) - width + 1, width, _U)
    for i in range(width):
        out = _mixed(out) + words[i : len(words) - width + 1 + i]
    return np.unique(_mixed(out))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def keys(own: np.ndarray) -> list[int]:
    """The distinct keys of a text's shingles; none without shingles."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, (1 << 64) - 1, _U)
    for at in range(0, len(own), BLOCK):
        least = np.minimum(least, (own[at : at + BLOCK, None] * _FACTORS + _SHIFTS).min(axis=0))
    band = (_mixed(least).reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=_U) + np.arange(BANDS, dtype=_U)
    fuzzy = simhash.fuzzy_keys(np.array([simhash.majority(own)], _U))[0].astype(_U)
    return np.unique(np.concatenate([_mixed(band), _mixed(fuzzy + _U(BANDS))]).view(np.int64)).tolist()


def _digest(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), 42) - (1 << 63)


def _sketched(rows: DataFrame) -> DataFrame:
    """rows with their column text replaced by digest and size (of the set of shingles) and keys."""
    rest = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sizes, found = [], [], []
            for t in b.column("text"):
                own = shingles(t.as_py())
                digests.append(_digest(own))
                sizes.append(len(own))
                found.append(keys(own))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(digests, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=[*rest, "digest", "size", "keys"])

    return rows.mapInArrow(run, rows.drop("text").withColumns({"digest": F.lit(0).cast("long"), "size": F.lit(0).cast("long"), "keys": F.array(F.lit(0).cast("long"))}).schema)


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (u, v) whose texts (digest, text) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, held = None, np.zeros(0, _U)
        for b in batches:
            kept = []
            for u, v, one, other in zip(*(b.column(c) for c in ("u", "v", "one", "other")), strict=True):
                if v.as_py() != digest:  # rows of one v come one after another
                    digest, held = v.as_py(), shingles(other.as_py())
                own = shingles(one.as_py())
                kept.append(min(len(own), len(held)) >= SIMILAR * max(len(own), len(held)) and similarity(own, held) >= SIMILAR)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(kept)) for c in ("u", "v")], names=["u", "v"])

    both = pairs.join(texts.select(F.col("digest").alias("u"), F.col("text").alias("one")), "u")
    both = both.join(texts.select(F.col("digest").alias("v"), F.col("text").alias("other")), "v")
    return written(both.select("u", "v", "one", "other").mapInArrow(run, "u long, v long"), "similar")


def _rooted(shared: DataFrame, roots: DataFrame | None) -> DataFrame:
    """shared (digest, size, key) with the cluster of each digest so far."""
    if roots is None:
        return shared.withColumn("root", F.col("digest"))
    return shared.join(roots.withColumnRenamed("u", "digest"), "digest", "left").select("digest", "size", "key", F.coalesce("root", "digest").alias("root"))


def _open(rooted: DataFrame) -> DataFrame:
    """(key, n, least): keys with members of several clusters, how many members, and the least (root, digest)."""
    found = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("root", "digest")).alias("least"), F.max("root").alias("high"))
    return found.where("least.root <> high").select("key", "n", "least")


def _opened(rooted: DataFrame) -> DataFrame:
    """rooted with n and least of its keys, those of _open(); a key that very many texts share goes to no single task."""
    return spread(rooted, _open(rooted).withColumn("rows", F.col("n")), "key", "rows")


def _offers(shared: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(u, v): each text outside the first cluster of a key, with the least text of such a cluster that most of its keys offer."""
    rooted = _rooted(shared, roots)
    offered = _opened(rooted).where("root <> least.root").groupBy(F.col("digest").alias("u"), F.col("least.digest").alias("v")).count()
    return offered.groupBy("u").agg(F.max_by("v", F.struct("count", "v")).alias("v"))


def _pairs(met: DataFrame) -> DataFrame:
    """(u, v): the pairs of texts that share a key, lie in different clusters and have sizes that allow it."""
    groups = met.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("digest", "root", "size"))).alias("members"))
    ends = groups.select(F.posexplode("members").alias("place", "one"), "members")
    pairs = ends.select(F.col("one"), F.explode(F.expr("slice(members, 1, place)")).alias("other"))
    near = F.least("one.size", "other.size") >= SIMILAR * F.greatest("one.size", "other.size")
    return pairs.where(near & (F.col("one.root") != F.col("other.root"))).select(F.greatest("one.digest", "other.digest").alias("u"), F.least("one.digest", "other.digest").alias("v")).distinct()


def matches(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Of each set of one and each of other, whether they are similar: a matrix.

    Shingles that few of these sets have are counted pair by pair, all others by products of matrices.
    """
    sizes = [np.array([len(s) for s in sets], np.int64) for sets in (one, other)]
    values = [np.concatenate(sets) for sets in (one, other)]
    common = np.intersect1d(*values)
    both = np.zeros((len(one), len(other)), np.int64)
    if len(common):
        ids, rows = [], []
        for v, n in zip(values, sizes, strict=True):
            at = np.minimum(np.searchsorted(common, v), len(common) - 1)
            held = np.flatnonzero(common[at] == v)
            order = held[np.argsort(at[held], kind="stable")]
            ids.append(at[order])
            rows.append(np.repeat(np.arange(len(n)), n)[order])
        times = [np.bincount(i, minlength=len(common)) for i in ids]
        light = times[0] * times[1] <= LIGHT
        mine = light[ids[0]]
        reps = times[1][ids[0][mine]]
        firsts = (np.cumsum(times[1]) - times[1])[ids[0][mine]]
        places = np.repeat(firsts - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
        both += np.bincount(np.repeat(rows[0][mine], reps) * len(other) + rows[1][places], minlength=both.size).reshape(both.shape)
        heavy = [(np.cumsum(~light) - 1)[i[~light[i]]] for i in ids]
        rows = [r[~light[i]] for r, i in zip(rows, ids, strict=True)]
        for at in range(0, int((~light).sum()), WIDE):
            marks = []
            for h, r, n in zip(heavy, rows, sizes, strict=True):
                a, b = np.searchsorted(h, (at, at + WIDE))
                m = np.zeros((len(n), WIDE), np.float32)
                m[r[a:b], h[a:b] - at] = 1
                marks.append(m)
            both += (marks[0] @ marks[1].T).astype(np.int64)
    union = sizes[0][:, None] + sizes[1] - both
    return both / np.maximum(union, 1) >= SIMILAR


def _reached(similar: np.ndarray, one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each of the digests one and other (rows and columns of similar) the least that paths of similar pairs reach."""
    most = np.iinfo(np.int64).max
    while True:
        rows = np.minimum(one, np.where(similar, other, most).min(axis=1))
        columns = np.minimum(other, np.where(similar, rows[:, None], most).min(axis=0))
        if (rows == one).all() and (columns == other).all():
            return one, other
        one, other = rows, columns


def _part(digests: np.ndarray, parts: int) -> np.ndarray:
    """The part of each digest: parts are ranges of their high 32 bits, as those of a key's blocks are, so that a block's sets lie in few files."""
    return ((digests.view(_U) >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def _sets(texts: DataFrame, shards: int) -> Callable[[np.ndarray], list[np.ndarray]]:
    """Write the shingles of texts (digest, text) as mapped files in the shared folder; what is returned finds them by digests, in any task."""
    folder = _folder(texts.sparkSession, "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = b.column("digest")
            found = [shingles(t.as_py()).view(np.int64) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(_part(digests.to_numpy(zero_copy_only=False), shards), pa.int64()), digests, pa.array(found, pa.list_(pa.int64()))], names=["shard", "digest", "shingles"])

    def write(group: pa.Table) -> pa.Table:
        rows = group.sort_by("digest")
        found = [c.values.to_numpy()[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in rows["shingles"].chunks]
        dump(Path(folder, str(group["shard"][0].as_py())), {"digest": rows["digest"].to_numpy(), "end": np.cumsum(pc.list_value_length(rows["shingles"]).to_numpy().astype(np.int64)), "shingles": np.concatenate(found).view(_U)})
        return pa.table({"n": [len(rows)]})

    texts.mapInArrow(run, "shard long, digest long, shingles array<long>").groupBy("shard").applyInArrow(write, "n long").agg(F.sum("n")).collect()

    def find(digests: np.ndarray) -> list[np.ndarray]:
        found: list[np.ndarray] = [np.zeros(0, _U)] * len(digests)
        of = _part(digests, shards)
        for s in np.unique(of):  # one file is open at a time: sets are copied
            held, mine = load(Path(folder, str(s))), np.flatnonzero(of == s)
            for i, at in zip(mine, np.searchsorted(held["digest"], digests[mine]), strict=True):
                found[i] = np.array(held["shingles"][held["end"][at - 1] if at else 0 : held["end"][at]])
        return found

    return find


def _blocks(met: DataFrame) -> DataFrame:
    """met (key, digest, size, root) -> (id, key, step, own, root, members): blocks of members, numbered in the order of keys, steps and clusters.

    The members of a key are dealt to blocks by steps of their size and by ranges of their digests, so that none meets in one
    task.  A cluster that could fill a good part of a block has blocks of its own (own), all others share theirs (root 0).
    """
    step = ["key", "step"]
    placed = met.select("key", "digest", "size", "root", F.floor(F.log("size") / STEP).alias("step"))
    groups = written(placed.groupBy(*step, "root").agg(F.count("*").alias("n"), F.sum("size").alias("s")), "groups")
    large = F.greatest(F.col("n") / BLOCK_TEXTS, F.col("s") / BLOCK_SHINGLES) >= 0.25
    owned = placed.join(few(groups.where(large).select(*step, "root", F.lit(True).alias("own"))), [*step, "root"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    owned = owned.withColumn("root", F.when(F.col("own"), F.col("root")).otherwise(0))
    kept = groups.withColumn("own", large).withColumn("root", F.when(large, F.col("root")).otherwise(0)).groupBy(*step, "own", "root")
    parts = kept.agg(F.ceil(F.greatest(F.sum("n") / BLOCK_TEXTS, F.sum("s") / BLOCK_SHINGLES)).cast("long").alias("parts"))
    part = F.shiftright(F.shiftrightunsigned("digest", 32) * F.col("parts"), 32)
    blocks = owned.join(few(parts), [*step, "own", "root"]).groupBy(*step, "own", "root", part.alias("part")).agg(F.collect_list("digest").alias("members"))
    return written(ordinals(blocks, *(F.col(c) for c in ("key", "step", "own", "root", "part")), name="id"), "blocks")


def _jobs(blocks: DataFrame) -> DataFrame:
    """(id, first, last): each block with ranges of the blocks that it has to be compared with, RUN of them at most; numbers only.

    Those are the blocks from itself on of its key and step, and all of the next step; blocks of one cluster
    alone aren't compared with each other, for their members hang together already.
    """
    step = ["key", "step"]
    numbers = blocks.select("id", *step, "own", "root")
    spans = numbers.groupBy(*step).agg(F.max("id").alias("end"))
    mine = numbers.where("own").groupBy(*step, "root").agg(F.min("id").alias("begin"), F.max("id").alias("end"))
    after = lambda t, *names: t.withColumn("step", F.col("step") - 1).toDF(*t.columns[: len(t.columns) - len(names)], *names)
    found = numbers.join(spans, step).join(after(spans, "next"), step, "left").withColumn("end", F.coalesce("next", "end")).drop("next")
    found = found.join(mine.toDF(*step, "root", "a", "b"), [*step, "root"], "left").join(after(mine, "c", "d"), [*step, "root"], "left")
    span = lambda x, y: F.struct(x.alias("first"), y.alias("last"))
    alone = F.when(F.col("c").isNull(), F.array(span(F.col("b") + 1, F.col("end")))).otherwise(F.array(span(F.col("b") + 1, F.col("c") - 1), span(F.col("d") + 1, F.col("end"))))
    ranges = found.select("id", F.explode(F.when(F.col("own"), alone).otherwise(F.array(span(F.col("id"), F.col("end"))))).alias("r")).where("r.first <= r.last")
    starts = ranges.select("id", F.explode(F.sequence("r.first", "r.last", F.lit(RUN))).alias("first"), F.col("r.last").alias("end"))
    return starts.select("id", "first", F.least(F.col("first") + RUN - 1, F.col("end")).alias("last"))


def _crowds(met: DataFrame, texts: DataFrame) -> DataFrame | None:
    """(u, v): links that connect exactly the texts which paths of similar pairs within a key connect, beside the clusters that there are; None without members.

    Blocks lie in files by their numbers, and a task is given numbers: it compares one block with a run of others.
    """
    cores = met.sparkSession.sparkContext.defaultParallelism
    owners = met.select("digest", "size").distinct()
    n, total = owners.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return None
    find = _sets(texts.join(owners, "digest", "left_semi"), max(-(-total // SHARD_SHINGLES), min(-(-n // 64), 4 * cores)))
    blocks, folder = _blocks(met), _folder(met.sparkSession, "blocks")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, members in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                dump(Path(folder, str(number)), {"digest": np.array(members.values, np.int64)})
            yield b.select([0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, one, sets = None, None, None
        for b in batches:
            for number, first, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if number != at:
                    one = np.array(load(Path(folder, str(number)))["digest"])
                    at, sets = number, find(one)
                for other in range(first, last + 1):
                    two = one if other == number else np.array(load(Path(folder, str(other)))["digest"])
                    ends = _reached(matches(sets, sets if other == number else find(two)), one, two)
                    u, v = (one, ends[0]) if other == number else (np.concatenate([one, two]), np.concatenate(ends))
                    yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], names=["u", "v"])

    blocks.select("id", "members").mapInArrow(write, "id long").agg(F.count("*")).collect()
    jobs = written(_jobs(blocks), "jobs")
    tasks = max(1, min(jobs.count(), 16 * cores))
    return written(jobs.repartition(tasks).mapInArrow(run, "u long, v long"), "crowds")


def _rest(shared: DataFrame, roots: DataFrame | None, texts_of: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """(u, v): what links the similar texts that share a key and lie in different clusters; None if no key has any."""
    rooted = _rooted(shared, roots)
    met = written(_opened(rooted), "open")
    if met.isEmpty():
        return None
    pairs, crowded = written(_pairs(met.where(F.col("n") <= PAIRS_UP_TO)), "pairs"), met.where(F.col("n") > PAIRS_UP_TO)
    texts = written(texts_of(_ends(pairs).union(crowded.select("digest")).distinct()), "texts")
    links, more = _similar(pairs, texts), _crowds(crowded, texts)
    return links if more is None else links.union(more)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("digest")).distinct()


def _folder(spark: SparkSession, label: str) -> str:
    """A new folder for mapped files in the shared one."""
    url = urlparse(shared_dir(spark))
    if url.scheme not in ("", "file"):
        raise ValueError(f"{label} are mapped from files: mount the shared folder {url.geturl()} on every node and name it as a file: path")
    folder = f"{url.path}/lodestar/{label}-{uuid.uuid4().hex}"
    Path(folder).mkdir(parents=True)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def located(rows: DataFrame, marks: DataFrame, without: bool = False) -> DataFrame:
    """Those of rows (with file and place) that marks (file, place, digest) names, as digest and text; or, without, all others as they are.

    Marks are written as one mapped file for each file of rows, whose rows look themselves up
    in it: what is sent anywhere is the marks, not the texts.
    """
    folder = _folder(rows.sparkSession, "marks")

    def write(group: pa.Table) -> pa.Table:
        order = np.argsort(group["place"].to_numpy())
        dump(Path(folder, str(group["file"][0].as_py())), {c: group[c].to_numpy()[order] for c in ("place", "digest")})
        return pa.table({"n": [len(order)]})

    marks.select("file", "place", "digest").groupBy("file").applyInArrow(write, "n long").agg(F.sum("n")).collect()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files, places = (b.column(c).to_numpy(zero_copy_only=False) for c in ("file", "place"))
            named, digests = np.zeros(b.num_rows, bool), np.zeros(b.num_rows, np.int64)
            for f in np.unique(files):
                path = Path(folder, str(f))
                if path.exists():
                    held, mine = load(path), np.flatnonzero(files == f)
                    at = np.minimum(np.searchsorted(held["place"], places[mine]), len(held["place"]) - 1)
                    named[mine] = held["place"][at] == places[mine]
                    digests[mine] = held["digest"][at]
            if without:
                yield b.filter(pa.array(~named))
            else:
                yield pa.RecordBatch.from_arrays([pa.array(digests[named]), b.column("text").filter(pa.array(named))], names=["digest", "text"])

    return rows.mapInArrow(run, rows.schema if without else "digest long, text string")


def clusters(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """rows: those of docs, columns c0, c1 and so on in turn, then file and place; and of each (file, place, cluster, doc_id, hash of the text).

    Clusters are what paths of pairs of similarity SIMILAR or more connect.
    Texts without words are alike.  Rows are known by their file and their place
    in it, so that no text is written again; docs that aren't read from files are
    written first.
    """
    arrow_rows(docs.sparkSession)
    release(docs.sparkSession)
    own = [f"c{i}" for i in range(len(docs.columns))]
    known = [F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")]
    try:
        rows = docs.select("*", *known)
    except AnalysisException:  # not read from files, or with a column of that name
        rows = written(docs.toDF(*own), "rows").select("*", *known)
    rows = rows.toDF(*own, "file", "place")
    held, named = own[docs.columns.index(text)], own[docs.columns.index(doc_id)]
    sketches = written(_sketched(rows.select("file", "place", F.col(named).alias("doc_id"), F.xxhash64(held).alias("hash"), F.col(held).alias("text"))), "sketches")

    # the first row of each digest, found task by task first: copies of one text never meet
    firsts = written(sketches.groupBy("digest").agg(F.min(F.struct("file", "place")).alias("row")), "firsts")

    def texts(asked: DataFrame) -> DataFrame:
        """(digest, text) of the digests asked for: for each one row's."""
        chosen = firsts.join(asked, "digest", "left_semi")
        return located(rows.select("file", "place", F.col(held).alias("text")), chosen.select("digest", "row.*"))

    keyed = sketches.select("digest", "size", "keys").dropDuplicates(["digest"]).select("digest", "size", F.explode("keys").alias("key"))
    several = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(spread(keyed, several, "key").select("digest", "size", "key"), "shared")
    linked = roots = None
    for turn in range(ROUNDS + 1):
        release(docs.sparkSession)
        if turn < ROUNDS:
            pairs = written(_offers(shared, roots), "pairs")
            similar = None if pairs.isEmpty() else _similar(pairs, texts(_ends(pairs)))
        else:
            similar = _rest(shared, roots, texts)
        if similar is None:  # no key has members of several clusters
            break
        linked = similar if linked is None else linked.union(similar)
        roots = written(components(linked), "roots")
    cluster = F.col("digest")
    if roots is not None:
        copies = sketches.groupBy("digest").agg(F.count("*").alias("n"))
        owned = copies.join(roots.withColumnRenamed("u", "digest"), "digest", "left").select("digest", "n", F.coalesce("root", "digest").alias("cluster"))
        sketches, cluster = spread(sketches, owned, "digest"), F.col("cluster")
    return rows, sketches.select("file", "place", cluster.alias("cluster"), "doc_id", "hash")
