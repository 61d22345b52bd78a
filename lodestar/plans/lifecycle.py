"""Registered queries over the life of an index: evidence, manifest, build, resume, verification, searches, reports.

The evidence is a folder tree made of the suppliers: one file for each, in its region's and
nation's folders, holding a shade (sources/shades.py); the files of some are broken.
An index is built of it once for a session, part by part and with a resumption
in between; the queries read what is on disk then.  SQL says what must be there.
"""

from __future__ import annotations

import shutil
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.queries import Unchanged
from lodestar.plans import index, search
from lodestar.schemas import VALID
from lodestar.session import shared_dir, spread
from lodestar.sources import manifest, reports, shades, tree

#: Rows of a stretch, how many each model and query keep, and how many count in the evaluation.
STRETCH, KEPT, STRONG = 16, 9, 5
TEXTS = ("bright", "dark")
#: Shown instead of the folder that the evidence happens to lie in.
SHOWN = "E:\\"

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}
_made: dict[tuple[str, str], Path] = {}


def _query(sql: str):
    def add(f):
        _QUERIES[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items()}


def _folder(spark: SparkSession, sf_dir: str) -> Path:
    """The folder with evidence/ of the suppliers, made once for a session and table by the executors."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _made:
        url = urlparse(shared_dir(spark))
        if url.scheme not in ("", "file"):
            raise ValueError(f"evidence is a folder tree: name the shared folder {url.geturl()} as a file: path")
        root = Path(url.path, "lodestar", f"life-{abs(hash(key)):016x}")

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    file = root / "evidence" / r["path"]
                    file.parent.mkdir(parents=True, exist_ok=True)
                    file.write_text(r["content"])
                yield b.select(["path"])

        key_, nation = F.col("s_suppkey"), spark.read.parquet(f"{sf_dir}/nation.parquet")
        path = F.format_string("r%d/n%d/%s.png", "n_regionkey", "n_nationkey", "s_name")
        content = F.when(key_ % 10 == 7, "broken").otherwise((10 * (key_ % 26)).cast("string"))
        suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
        suppliers.select(path.alias("path"), content.alias("content")).repartition(spread(spark)).mapInArrow(write, "path string").agg(F.count("*")).collect()
        (root / "evidence/notes.txt").write_text("no image")
        _made[key] = root
    return _made[key]


def _index(spark: SparkSession, sf_dir: str) -> Path:
    """A complete index of the evidence, whose build was ended after the first job and resumed."""
    root = _folder(spark, sf_dir)
    if not (root / "index").exists():
        seen: list[int] = []

        def once(phase: str, done: int, total: int) -> None:
            seen.append(done)
            if len(seen) == 2:
                raise InterruptedError

        build = lambda **more: index.build(spark, root / "evidence", root / "index", shades.FACTORIES, STRETCH, 3, decoder=shades.decode, **more)
        try:
            build(progress=once, stretches=2)
        except InterruptedError:
            build(resume=True)
    return root / "index"


_FILES = f"""
    WITH files AS (SELECT 'r' || n_regionkey || '/n' || n_nationkey || '/' || s_name || '.png' AS path, s_suppkey % 10 <> 7 AS fine,
                          CASE WHEN s_suppkey % 10 = 7 THEN 'broken' ELSE (10 * (s_suppkey % 26))::VARCHAR END AS content, (10 * (s_suppkey % 26))::DOUBLE AS shade,
                          row_number() OVER (ORDER BY 'r' || n_regionkey, 'n' || n_nationkey, lower(s_name || '.png'), s_name) - 1 AS ordinal FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    models AS (SELECT * FROM (VALUES ('siglip2', 1.0::DOUBLE), ('clip', 2.0::DOUBLE)) m(model_id, depth)),
    queries AS (SELECT * FROM (VALUES ('q0001', 'bright', 0), ('q0002', 'dark', 1)) q(query_id, text, position)),
    vectors AS (SELECT model_id, ordinal, path, shade / sqrt(shade * shade + depth * depth * (255 - shade) * (255 - shade)) AS bright,
                       depth * (255 - shade) / sqrt(shade * shade + depth * depth * (255 - shade) * (255 - shade)) AS dark FROM files, models WHERE fine),
    scores AS (SELECT model_id, query_id, position, text, ordinal, path, CASE text WHEN 'bright' THEN bright ELSE dark END AS score FROM vectors, queries),
    all_ranked AS (SELECT *, row_number() OVER (PARTITION BY model_id, query_id ORDER BY score DESC, ordinal)::INTEGER AS rank FROM scores),
    ranked AS (SELECT * FROM all_ranked WHERE rank <= {KEPT}),
    summed AS (SELECT query_id, position, text, ordinal, path, sum(1.0::DOUBLE / (60 + rank)) AS score, count(*) AS n, min(rank) AS best,
                      max(CASE WHEN model_id = 'siglip2' THEN rank END) AS one, max(CASE WHEN model_id = 'clip' THEN rank END) AS two,
                      max(CASE WHEN model_id = 'siglip2' THEN ranked.score END) AS one_score, max(CASE WHEN model_id = 'clip' THEN ranked.score END) AS two_score FROM ranked GROUP BY ALL),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n DESC, best, one NULLS LAST, two NULLS LAST, ordinal)::INTEGER AS final_rank FROM summed),
    strong AS (SELECT ordinal, path, list(struct_pack(r := final_rank, p := position, q := query_id, t := text) ORDER BY final_rank, position) AS m FROM fused WHERE final_rank <= {STRONG} GROUP BY ordinal, path),
    judged AS (SELECT *, len(m) AS n, list_reduce(list_transform(m, lambda x: 1.0::DOUBLE / (60 + x.r)), lambda a, x: a + x) AS score FROM strong),
    final AS (SELECT *, row_number() OVER (ORDER BY n DESC, score DESC, m[1].r, ordinal) AS place FROM judged)"""
_COMMITTED = f"""
    , cuts AS (SELECT (ordinal // {STRETCH})::INTEGER AS sequence, min(ordinal) AS start, max(ordinal) + 1 AS stop, count(*) FILTER (fine) AS valid_count, count(*) FILTER (NOT fine) AS error_count FROM files GROUP BY ALL)"""


@_query(_FILES + " SELECT ordinal, path AS relative_path, length(content)::BIGINT AS size FROM files")
def life_discovery(spark, d):
    """Images of a folder tree in walk order."""
    found, _ = tree.discover(spark, _folder(spark, d) / "evidence")
    return found.select("ordinal", "relative_path", "size")


@_query(_FILES + " SELECT ordinal, path AS relative_path FROM files")
def life_manifest(spark, d):
    """A manifest as written and read again."""
    root = _folder(spark, d)
    path = f"file://{root}/manifest"
    if not (root / "manifest").exists():
        found, _ = tree.discover(spark, root / "evidence")
        manifest.write(found.select("ordinal", "relative_path", "source_path"), path, root / "evidence")
    return manifest.read(spark, path).select("ordinal", "relative_path")


@_query(_FILES + " SELECT ordinal, path AS relative_path, length(content)::BIGINT AS size, sha256(content) AS sha256 FROM files")
def life_index_manifest(spark, d):
    """An index's manifest, with content hashes."""
    return index.manifest(spark, _index(spark, d)).select("ordinal", "relative_path", "size", "sha256")


@_query(_FILES + " SELECT model_id, f.ordinal, CASE WHEN fine THEN 1 ELSE 2 END AS state, round(bright, 5) AS bright, round(dark, 5) AS dark, CASE WHEN NOT fine THEN 'ValueError' END AS error_type FROM files f CROSS JOIN models LEFT JOIN vectors USING (model_id, ordinal)")
def life_index_rows(spark, d):
    """The committed rows of both models: states, vectors of length one, faults."""
    rows = index.rows(spark, _index(spark, d))
    return rows.select("model_id", "ordinal", F.col("state").cast("int").alias("state"), *[F.round(F.get("embedding", F.lit(i)).cast("double"), 5).alias(n) for i, n in enumerate(("bright", "dark"))], "error_type")


@_query(_FILES + _COMMITTED + ' SELECT model_id, sequence, start, stop AS "end", valid_count, error_count FROM cuts, models')
def life_journal(spark, d):
    """The journal of a build that was ended and resumed."""
    return index.journal(spark, _index(spark, d)).select("model_id", "sequence", "start", "end", "valid_count", "error_count")


@_query(_FILES + ", found AS (SELECT count(*) FILTER (fine) AS valid, count(*) FILTER (NOT fine) AS decode_errors, count(*) AS images FROM files) SELECT model_id, valid, decode_errors, 0::BIGINT AS pending, images, 'COMPLETE' AS state FROM found, models")
def life_verified(spark, d):
    """What an index holds that a full verification finds no fault in."""
    path = _index(spark, d)
    index.verify(spark, path, full=True, require_complete=True)
    return index.counts(spark, path)


@_query(_FILES + f" SELECT model_id, ordinal FROM models, files WHERE ordinal >= {2 * STRETCH}")
def life_pending(spark, d):
    """What two committed stretches of each model leave to do."""
    path = _index(spark, d)
    held = index.journal(spark, path).where(F.col("end") <= 2 * STRETCH)
    return index.uncommitted(index.manifest(spark, path), index._committed(spark, index.Paths(path), held)).select("model_id", "ordinal")


def _copied(spark: SparkSession, path: Path, copy: Path) -> None:
    """A copy of an index; its stretches are copied by tasks."""
    shutil.copytree(path, copy, ignore=lambda folder, names: ["rows"] if Path(folder) == path else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for model_id, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = f"rows/model_id={model_id}/start={start}"
                shutil.copytree(path / own, copy / own, dirs_exist_ok=True)
            yield b

    index.journal(spark, path).select("model_id", "start").repartition(spread(spark)).mapInArrow(run, "model_id string, start long").agg(F.count("*")).collect()


_SPAN = f"(SELECT min(start) FROM cuts WHERE start >= {STRETCH} OR start = (SELECT max(start) FROM cuts))"


@_query(_FILES + _COMMITTED + f""" SELECT 'clip' AS model_id, start, stop AS "end" FROM cuts WHERE start = {_SPAN}""")
def life_damaged(spark, d):
    """The range of ordinals that a byte flipped in one of an index's files belongs to, found by the tree of digests."""
    path = _index(spark, d)
    copy = path.parent / "damaged"
    if not copy.exists():
        _copied(spark, path, copy)
        files = {int(p.parent.name.removeprefix("start=")): p for p in (copy / "rows/model_id=clip").glob("start=*/*.parquet")}
        hurt = files[min(s for s in files if s >= STRETCH or s == max(files))]
        data = bytearray(hurt.read_bytes())
        data[len(data) // 2] ^= 1
        hurt.write_bytes(data)
    return index.damaged(spark, copy)


@_query(_FILES + _COMMITTED + f" SELECT model_id, count(*) AS stretches FROM cuts, models WHERE start < {3 * STRETCH} AND stop > {STRETCH} GROUP BY model_id")
def life_proved(spark, d):
    """How many stretches of a part of the ordinals are proved against the index's roots, by their own files and the tree."""
    path = _index(spark, d)
    span = index.journal(spark, path).where((F.col("start") < 3 * STRETCH) & (F.col("end") > STRETCH))
    for model in shades.FACTORIES:
        index.verify_part(spark, path, model, STRETCH, 3 * STRETCH)
    return span.groupBy("model_id").agg(F.count("*").alias("stretches"))


def _cells(spark: SparkSession, path: Path, columns: tuple[str, ...], drop: tuple[str, ...]) -> DataFrame:
    """A report's cells as texts, as they stand in the file."""
    found = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"file://{path}")
    if tuple(found.columns) != columns:
        raise ValueError(f"columns of {path.name}: {found.columns}")
    return found.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns if c not in drop])


def _searched(spark: SparkSession, d: str, direct: bool) -> Path:
    root = _index(spark, d).parent
    out = root / ("direct" if direct else "indexed")
    if not out.exists():
        out.mkdir()
        settings = search.Settings(KEPT, evaluator_top_k=STRONG, display_root=SHOWN)
        asked = Unchanged().process(TEXTS)
        if direct:
            search.direct(spark, root / "evidence", out / "audit.csv", asked, shades.FACTORIES, settings, out / "final.csv", batch=3, decoder=shades.decode)
        else:
            search.indexed(spark, root / "index", out / "audit.csv", asked, shades.FACTORIES, settings, out / "final.csv")
    return out


_SQL_AUDIT = _FILES + """
    SELECT 'E:\\' || replace(path, '/', '\\') AS "FilePath", text AS "OriginalQuery", text AS "MatchedQuery", coalesce(printf('%.4f', one_score), '') AS "SigLIP2Score", coalesce(printf('%.4f', two_score), '') AS "CLIPCos",
           coalesce(one::VARCHAR, '') AS "SigLIP2Rank", coalesce(two::VARCHAR, '') AS "CLIPRank", CASE WHEN n = 2 THEN 'SigLIP2+CLIP' WHEN one IS NULL THEN 'CLIP' ELSE 'SigLIP2' END AS "ModelsMatched",
           final_rank::VARCHAR AS "FinalRank", printf('%.12f', score) AS "FusionScore", 'shades' AS "SigLIP2Model", '1' AS "SigLIP2Revision", 'shades' AS "CLIPModel", '1' AS "CLIPRevision" FROM fused"""


def _shorter(cells: DataFrame) -> DataFrame:
    """Scores to four places, where float32 and double agree."""
    short = lambda c: F.when(F.col(c) == "", "").otherwise(F.format_string("%.4f", F.col(c).cast("double"))).alias(c)
    return cells.select(*[short(c) if c in ("SigLIP2Score", "CLIPCos") else F.col(c) for c in cells.columns])


@_query(_SQL_AUDIT)
def life_indexed_audit(spark, d):
    """The audit report of a search of the index, as the file has it."""
    return _shorter(_cells(spark, _searched(spark, d, False) / "audit.csv", reports.AUDIT, ("ScanTimestamp",)))


@_query(_SQL_AUDIT)
def life_direct_audit(spark, d):
    """The same of a search of the folder tree."""
    return _shorter(_cells(spark, _searched(spark, d, True) / "audit.csv", reports.AUDIT, ("ScanTimestamp",)))


_SQL_FINAL = _FILES + f"""
    SELECT 'E:\\' || replace(path, '/', '\\') AS "FilePath", place::VARCHAR AS "EvaluatorRank", printf('%.12f', score) AS "EvaluatorScore", n::VARCHAR AS "StrongQueryCount", m[1].t AS "BestOriginalQuery", m[1].t AS "BestMatchedQuery", m[1].r::VARCHAR AS "BestQueryRank",
           list_aggregate(list_transform(m, lambda x: x.q || ':' || x.t || ':' || x.r), 'string_agg', ' ') AS "QueryMatches", '{STRONG}' AS "EvaluatorTopK", '60' AS "EvaluatorRRFConstant" FROM final"""


@_query(_SQL_FINAL)
def life_final_report(spark, d):
    """The final report as the file has it; each match's id, texts and rank, read from its JSON."""
    cells = _cells(spark, _searched(spark, d, False) / "final.csv", reports.FINAL, ("ScanTimestamp", "AuditReport"))
    kind = "array<struct<QueryId: string, OriginalQuery: string, MatchedQuery: string, FinalRank: int, ReciprocalContribution: double>>"
    return cells.withColumn("QueryMatches", F.array_join(F.transform(F.from_json("QueryMatches", kind), lambda x: F.concat_ws(":", x["QueryId"], x["MatchedQuery"], x["FinalRank"])), " "))


@_query(_FILES + """ SELECT 'E:\\' || replace(path, '/', '\\') AS "FilePath", text AS "Query", printf('%.4f', score) AS "SigLIP2Score", rank::VARCHAR AS "Rank", 'shades' AS "Model", '1' AS "Revision" FROM all_ranked WHERE model_id = 'siglip2'""")
def life_full_ranking(spark, d):
    """One model's ranking of every image, as the file has it."""
    root = _folder(spark, d)
    out = root / "all.csv"
    if not out.exists():
        search.all_results(spark, root / "evidence", out, Unchanged().process(TEXTS), shades.siglip2, 3, SHOWN, shades.decode)
    return _shorter(_cells(spark, out, reports.ALL_RESULTS, ()).withColumn("CLIPCos", F.lit(""))).drop("CLIPCos")


@_query(_FILES + " SELECT model_id, count(*) AS images, count(*) * (SELECT count(*) FROM queries) AS expected FROM vectors GROUP BY model_id")
def life_expected_rows(spark, d):
    """How many rows a full ranking of each model has."""
    rows = index.rows(spark, _index(spark, d)).where(F.col("state") == VALID)
    asked = spark.createDataFrame([(t,) for t in TEXTS], "text string").agg(F.count("*").alias("queries"))  # one row
    return rows.groupBy("model_id").agg(F.count("*").alias("images")).join(F.broadcast(asked)).select("model_id", "images", (F.col("images") * F.col("queries")).alias("expected"))
