"""The registered queries over the driver's tables, and the SQL each must agree with.

Vectors: the two halves of ``embeddings`` serve as the vectors of two models,
the first vector of each label (by vec_id) as a query.  Volume: customers are the
files, order priorities the queries; a customer's dearest order is one
model's score, the number of orders the other's, which ties a lot.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import checks, digests, merkle, paths
from lodestar.functions.queries import numbered
from lodestar.operators import fusion, metrics, ranking, relations, similarity
from lodestar.plans import lifecycle, search
from lodestar.schemas import MANIFEST, MODELS
from lodestar.session import materialized, shared_dir
from lodestar.sources import images, reports
from lodestar.sources import manifest as manifests
from lodestar.streaming import chain

#: How many are kept: of the vectors, of the customers, and for the evaluation.
K, K_ORDERS, K_STRONG = 50, 300, 100
STAMP = "1970-01-01T00:00:00+00:00"

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _query(sql: str):
    """Register the decorated function with the SQL it must agree with."""

    def add(f):
        _QUERIES[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _QUERIES.items()} | lifecycle.queries()


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items()} | lifecycle.oracle_sql()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _walked(found: DataFrame) -> DataFrame:
    """Paths with what sorts them into walk order, made once for each row."""
    return found.select("path", paths.walk_key(F.col("path")).alias("walk_key"))


# -------------------------------------------------------------------- vectors


def _halves(vector: str) -> Column:
    return F.array(F.struct(F.lit("siglip2").alias("model_id"), F.slice(vector, 1, 32).alias("embedding")), F.struct(F.lit("clip").alias("model_id"), F.slice(vector, 33, 32).alias("embedding")))


def _index(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "embeddings")
    return rows.select(F.col("vec_id").alias("file_id"), F.inline(_halves("embedding")))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """A query for each label, in the order of labels."""
    labels = _table(spark, d, "embeddings").select("label").distinct()
    return numbered(labels.select((F.row_number().over(Window.orderBy("label")) - 1).alias("position"), F.concat(F.lit("label "), F.col("label")).alias("text")), "position", "text")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    firsts = _table(spark, d, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    named = firsts.select(F.format_string("q%04d", F.row_number().over(Window.orderBy("label"))).alias("query_id"), "embedding")
    return named.select("query_id", F.inline(_halves("embedding")))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return similarity.score_pairs(_index(spark, d), _vectors(spark, d))


def _top(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_k(similarity.search(_index(spark, d), _vectors(spark, d), K), K)


_SQL_SCORES = """
    halves AS (SELECT vec_id AS file_id, label, 'siglip2' AS model_id, embedding[1:32]::DOUBLE[] AS e FROM embeddings
               UNION ALL SELECT vec_id, label, 'clip', embedding[33:64]::DOUBLE[] FROM embeddings),
    labels AS (SELECT label, min(vec_id) AS file_id, printf('q%04d', row_number() OVER (ORDER BY label)) AS query_id,
                      (row_number() OVER (ORDER BY label) - 1)::INTEGER AS position, 'label ' || label AS text FROM embeddings GROUP BY label),
    wanted AS (SELECT query_id, model_id, e FROM labels JOIN halves USING (file_id)),
    scores AS (SELECT h.model_id, w.query_id, h.file_id,
                      list_dot_product(h.e, w.e) / (sqrt(list_dot_product(h.e, h.e)) * sqrt(list_dot_product(w.e, w.e))) AS score
               FROM halves h JOIN wanted w USING (model_id))"""
_SQL_RANKED = f""",
    full_ranked AS (SELECT *, row_number() OVER (PARTITION BY model_id, query_id ORDER BY score DESC, file_id)::INTEGER AS rank FROM scores),
    ranked AS (SELECT * FROM full_ranked WHERE rank <= {K})"""


def _sql_fused(c: int = 60) -> str:
    return f""",
    summed AS (SELECT file_id, query_id, sum(1.0::DOUBLE / ({c} + rank)) AS fusion_score, count(*) AS n, min(rank) AS best,
                      max(CASE WHEN model_id = 'siglip2' THEN rank END) AS siglip2_rank, max(CASE WHEN model_id = 'clip' THEN rank END) AS clip_rank,
                      max(CASE WHEN model_id = 'siglip2' THEN score END) AS siglip2_score, max(CASE WHEN model_id = 'clip' THEN score END) AS clip_cos,
                      string_agg(CASE model_id WHEN 'siglip2' THEN 'SigLIP2' ELSE 'CLIP' END, '+' ORDER BY model_id DESC) AS models_matched
               FROM ranked GROUP BY file_id, query_id),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, n DESC, best, siglip2_rank NULLS LAST, clip_rank NULLS LAST, file_id)::INTEGER AS final_rank FROM summed)"""


def _sql_evaluated(k: int, c: int = 60) -> str:
    return f""",
    strong AS (SELECT file_id, list(struct_pack(r := final_rank, p := position, q := query_id) ORDER BY final_rank, position, query_id) AS m
               FROM fused JOIN places USING (query_id) WHERE final_rank <= {k} GROUP BY file_id),
    evaluated AS (SELECT file_id, m, list_reduce(list_transform(m, lambda x: 1.0::DOUBLE / ({c} + x.r)), lambda a, x: a + x) AS evaluator_score, len(m)::INTEGER AS strong_query_count,
                         m[1].q AS best_query_id, m[1].r AS best_query_rank FROM strong),
    final AS (SELECT *, row_number() OVER (ORDER BY strong_query_count DESC, evaluator_score DESC, best_query_rank, file_id)::INTEGER AS evaluator_rank FROM evaluated)"""


_SQL_VECTORS = "WITH " + _SQL_SCORES + _SQL_RANKED + _sql_fused() + ", places AS (SELECT query_id, position FROM labels)" + _sql_evaluated(K_STRONG)


def _rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


@_query("WITH" + _SQL_SCORES + " SELECT model_id, query_id, file_id, round(score, 12) AS score FROM scores")
def cosine_scores(spark, d):
    """Every vector against every query of its model, in Catalyst."""
    return _rounded(_scores(spark, d), score=12)


@_query(_SQL_VECTORS + " SELECT model_id, query_id, file_id, round(score, 9) AS score, rank FROM ranked")
def topk_per_model_query(spark, d):
    """The best K of each model and query: bounded heaps in the scan, then ranks."""
    return _rounded(_top(spark, d), score=9)


@_query(
    "WITH" + _SQL_SCORES.replace("wanted AS (SELECT query_id, model_id, e FROM labels JOIN halves USING (file_id))", "wanted AS (SELECT 'v' || file_id AS query_id, model_id, e FROM halves)")
    + " SELECT * FROM (SELECT model_id, query_id, file_id, round(score, 9) AS score, row_number() OVER (PARTITION BY model_id, query_id ORDER BY score DESC, file_id)::INTEGER AS rank FROM scores) WHERE rank <= 7"
)
def topk_many_queries(spark, d):
    """Every vector as a query to all of its model: a grid of blocks of queries past blocks of items."""
    rows = _index(spark, d)
    asked = rows.select("model_id", F.concat(F.lit("v"), "file_id").alias("query_id"), "embedding")
    return _rounded(ranking.top_k(similarity.grid(rows, asked, 7, 512, 128), 7), score=9)


@_query("WITH" + _SQL_SCORES + _SQL_RANKED + " SELECT model_id, query_id, file_id, round(score, 9) AS score, rank FROM full_ranked")
def full_ranking(spark, d):
    """All ranks, without limit."""
    return _rounded(ranking.full_ranking(_scores(spark, d)), score=9)


def _fused(spark, d) -> DataFrame:
    return fusion.fuse(_top(spark, d), queries=_texts(spark, d))


@_query(_SQL_VECTORS + " SELECT file_id, query_id, models_matched, round(fusion_score, 12) AS fusion_score, final_rank, round(siglip2_score, 9) AS siglip2_score, round(clip_cos, 9) AS clip_cos, siglip2_rank, clip_rank FROM fused")
def rrf_fusion(spark, d):
    """Both models' rankings fused, with the optional columns of each model."""
    out = fusion.model_columns(_fused(spark, d)).drop("scores", "ranks", "position")
    return _rounded(out, fusion_score=12, siglip2_score=9, clip_cos=9)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rrf_fusion(spark, sf_dir)


@_query(_SQL_VECTORS + " SELECT file_id, evaluator_rank, round(evaluator_score, 12) AS evaluator_score, strong_query_count, best_query_id, best_query_rank FROM final")
def evaluator_files(spark, d):
    """One row for each file that is strong for some query."""
    return _rounded(fusion.evaluate(_fused(spark, d), K_STRONG, queries=_texts(spark, d)).drop("query_matches"), evaluator_score=12)


@_query(_SQL_VECTORS + " SELECT file_id, u.i::INTEGER AS place, m[u.i].q AS query_id, m[u.i].r AS final_rank, round(1.0::DOUBLE / (60 + m[u.i].r), 12) AS reciprocal_contribution FROM final, unnest(generate_series(1, len(m))) AS u(i)")
def query_matches(spark, d):
    """The matches of each evaluated file, in their order."""
    out = fusion.evaluate(_fused(spark, d), K_STRONG, queries=_texts(spark, d))
    rows = out.select("file_id", F.posexplode("query_matches").alias("at", "m")).select("file_id", (F.col("at") + 1).alias("place"), "m.query_id", "m.final_rank", "m.reciprocal_contribution")
    return _rounded(rows, reciprocal_contribution=12)


@_query(_SQL_VECTORS + " SELECT count(*) AS candidates, count(*) FILTER (n = 2) AS in_both FROM fused")
def intersection_count(spark, d):
    """How many candidates both models ranked."""
    return fusion.in_both(_fused(spark, d))


@_query(_SQL_VECTORS + " SELECT models_matched, count(*) AS candidates FROM fused GROUP BY models_matched")
def models_matched(spark, d):
    """Candidates by the models that ranked them."""
    return _fused(spark, d).groupBy("models_matched").agg(F.count("*").alias("candidates"))


def _manifest(spark, d) -> DataFrame:
    name = F.concat(F.lit("v/"), F.col("label"), F.lit("/"), F.col("vec_id"), F.lit(".png"))
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("ordinal"), name.alias("relative_path"), F.concat(F.lit("/e/"), name).alias("source_path"))


_SQL_PATH = "'E:\\' || replace('v/' || e.label || '/' || e.vec_id || '.png', '/', '\\')"


@_query(
    _SQL_VECTORS + f""" SELECT {_SQL_PATH} AS "FilePath", l.text AS "OriginalQuery", l.text AS "MatchedQuery", round(siglip2_score, 9) AS "SigLIP2Score", round(clip_cos, 9) AS "CLIPCos",
    siglip2_rank AS "SigLIP2Rank", clip_rank AS "CLIPRank", models_matched AS "ModelsMatched", final_rank AS "FinalRank", round(fusion_score, 12) AS "FusionScore", 'half 1' AS "SigLIP2Model", 'a' AS "SigLIP2Revision",
    'half 2' AS "CLIPModel", 'b' AS "CLIPRevision", '{STAMP}' AS "ScanTimestamp" FROM fused f JOIN labels l USING (query_id) JOIN embeddings e ON e.vec_id = f.file_id"""
)
def audit_report(spark, d):
    """The audit report's fifteen columns."""
    rows = reports.audit_rows(_fused(spark, d), _manifest(spark, d), _texts(spark, d), {"siglip2": ("half 1", "a"), "clip": ("half 2", "b")}, STAMP, "E:\\", checked=False)
    return _rounded(rows.drop("_position", "_query_id"), SigLIP2Score=9, CLIPCos=9, FusionScore=12)


@_query(
    _SQL_VECTORS + f""" SELECT {_SQL_PATH} AS "FilePath", evaluator_rank AS "EvaluatorRank", round(evaluator_score, 12) AS "EvaluatorScore", strong_query_count AS "StrongQueryCount", l.text AS "BestOriginalQuery",
    l.text AS "BestMatchedQuery", best_query_rank AS "BestQueryRank", list_aggregate(list_transform(m, lambda x: x.q || ':' || x.r), 'string_agg', ',') AS "QueryMatches", {K_STRONG} AS "EvaluatorTopK", 60 AS "EvaluatorRRFConstant",
    'audit.csv' AS "AuditReport", '{STAMP}' AS "ScanTimestamp" FROM final f JOIN labels l ON l.query_id = f.best_query_id JOIN embeddings e ON e.vec_id = f.file_id"""
)
def final_report(spark, d):
    """The final report's twelve columns; matches shown as id:rank."""
    evaluated = fusion.evaluate(_fused(spark, d), K_STRONG, queries=_texts(spark, d))
    rows = reports.final_rows(evaluated, _manifest(spark, d), _texts(spark, d), K_STRONG, 60, "audit.csv", STAMP, "E:\\")
    shown = F.array_join(F.transform("QueryMatches", lambda x: F.concat_ws(":", x["QueryId"], x["FinalRank"])), ",")
    return _rounded(rows.withColumn("QueryMatches", shown), EvaluatorScore=12)


@_query(
    _SQL_VECTORS + """ SELECT 'v/' || e.label || '/' || e.vec_id || '.png' AS "FilePath", l.text AS "Query", round(score, 9) AS "SigLIP2Score", rank AS "Rank", 'half 1' AS "Model", 'a' AS "Revision"
    FROM full_ranked f JOIN labels l USING (query_id) JOIN embeddings e ON e.vec_id = f.file_id WHERE model_id = 'siglip2'"""
)
def all_results_report(spark, d):
    """The first model's full ranking, as reported."""
    ranked = ranking.full_ranking(similarity.score_pairs(_index(spark, d).where("model_id = 'siglip2'"), _vectors(spark, d)))
    listed = _manifest(spark, d).withColumn("source_path", F.col("relative_path"))
    return _rounded(reports.all_results_rows(ranked, listed, _texts(spark, d), "half 1", "a").drop("_position"), SigLIP2Score=9)


@_query(_SQL_VECTORS + " SELECT m.model_id, l.query_id, count(r.file_id) AS candidates FROM (VALUES ('siglip2'), ('clip'), ('other')) m(model_id) CROSS JOIN labels l LEFT JOIN ranked r ON r.model_id = m.model_id AND r.query_id = l.query_id GROUP BY ALL")
def candidate_counts(spark, d):
    """Candidates of each model and query, also of a model without any."""
    return ranking.candidate_counts(_top(spark, d), [*MODELS, "other"], _texts(spark, d))


@_query(_SQL_VECTORS + " SELECT vec_id AS ordinal, 'v/' || label || '/' || vec_id || '.png' AS relative_path FROM embeddings SEMI JOIN ranked ON ranked.file_id = embeddings.vec_id")
def semi_manifest(spark, d):
    """Manifest rows of candidates."""
    return relations.entries_of(_manifest(spark, d), _top(spark, d)).select("ordinal", "relative_path")


@_query("SELECT o_custkey AS file_id FROM orders GROUP BY o_custkey HAVING o_custkey NOT IN (SELECT vec_id FROM embeddings)")
def anti_missing(spark, d):
    """Candidates that the manifest doesn't have."""
    return relations.missing(_manifest(spark, d), _table(spark, d, "orders").select(F.col("o_custkey").alias("file_id")))


@_query("SELECT count(*) AS rows, min(vec_id) AS lowest, max(vec_id) AS highest, count(DISTINCT vec_id) AS distinct_ordinals, min(vec_id) = 0 AND max(vec_id) = count(*) - 1 AND count(DISTINCT vec_id) = count(*) AS contiguous FROM embeddings")
def ordinal_contiguity(spark, d):
    return checks.contiguity(_table(spark, d, "embeddings"), "vec_id")


@_query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS norm, abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 1.1e-5 AS unit FROM embeddings")
def norm_check(spark, d):
    """Each vector's length, and whether it is one."""
    return _rounded(checks.norms(_table(spark, d, "embeddings")).select("vec_id", "norm", "unit"), norm=9)


@_query("SELECT label, count(*) AS rows, count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0) AS finite FROM embeddings GROUP BY label")
def finite_check(spark, d):
    rows = _table(spark, d, "embeddings")
    return rows.groupBy("label").agg(F.count("*").alias("rows"), F.count_if(checks.all_finite("embedding")).alias("finite"))


@_query("""SELECT m.model_id, n AS sequence, min(vec_id) AS start, max(vec_id) + 1 AS "end", TRUE AS linked FROM (SELECT vec_id, (vec_id // 64)::INTEGER AS n FROM embeddings), (VALUES ('siglip2'), ('clip')) m(model_id) GROUP BY m.model_id, n""")
def commit_chain(spark, d):
    """Commits of 64 rows each, checked as a chain for each model."""
    return metrics.commit_chain(_commits(spark, d)).select("model_id", "sequence", "start", "end", "linked")


def _commits(spark, d) -> DataFrame:
    parts = _table(spark, d, "embeddings").groupBy((F.floor(F.col("vec_id") / 64)).cast("int").alias("sequence")).agg(F.min("vec_id").alias("start"), (F.max("vec_id") + 1).alias("end"), F.count("*").alias("valid_count"))
    models = spark.createDataFrame([(m,) for m in MODELS], "model_id string")
    return parts.withColumn("error_count", F.lit(0).cast("long")).join(F.broadcast(models))


@_query("SELECT m.model_id, count(DISTINCT vec_id // 64) AS commits, max(vec_id) + 1 AS committed_prefix, count(*)::BIGINT AS valid, 0::BIGINT AS errors, TRUE AS chain_ok FROM embeddings, (VALUES ('siglip2'), ('clip')) m(model_id) GROUP BY m.model_id")
def commit_totals(spark, d):
    return metrics.commit_totals(_commits(spark, d))


@_query(
    """SELECT label, sum(n)::BIGINT AS rows, sha256(string_agg(sha256(d), '' ORDER BY part)) AS digest
    FROM (SELECT label, vec_id // 256 AS part, count(*) AS n, sha256(string_agg(sha256(array_to_string(list_transform(embedding, lambda x: (floor(x::DOUBLE * 1048576))::BIGINT), ',')), '' ORDER BY vec_id)) AS d FROM embeddings GROUP BY ALL) GROUP BY label"""
)
def range_digest(spark, d):
    """The digest of each label's vectors, by their order and in ranges of 256: components as whole numbers, so that both engines print alike."""
    piece = F.array_join(F.transform("embedding", lambda x: F.floor(x.cast("double") * 1048576).cast("string")), ",").cast("binary")
    return digests.by_ranges(_table(spark, d, "embeddings"), ["label"], piece, F.col("vec_id"), 256)


_SPAN, _FANOUT = 256, 4
_SQL_TREE = f"""RECURSIVE pieces AS (SELECT o_orderstatus, o_orderkey, o_orderkey // {_SPAN} AS position, sha256(o_orderkey || ':' || o_custkey || ':' || o_orderpriority) AS d FROM orders),
    leaves AS (SELECT o_orderstatus, position, sha256(string_agg(d, '' ORDER BY o_orderkey)) AS digest FROM pieces GROUP BY ALL),
    tree(o_orderstatus, level, position, digest, highest) AS (
        SELECT o_orderstatus, 0, position, digest, (SELECT max(position) FROM leaves) FROM leaves
        UNION ALL SELECT o_orderstatus, level + 1, position // {_FANOUT}, sha256(string_agg(digest, '' ORDER BY position)), highest // {_FANOUT} FROM tree WHERE highest > 0 GROUP BY o_orderstatus, level, position // {_FANOUT}, highest)"""


def _order_leaves(orders: DataFrame) -> DataFrame:
    """Digests of ranges of orders, for each status."""
    piece = F.concat_ws(":", "o_orderkey", "o_custkey", "o_orderpriority").cast("binary")
    ranges = orders.groupBy("o_orderstatus", F.floor(F.col("o_orderkey") / _SPAN).cast("long").alias("position"))
    return ranges.agg(digests.in_order(piece, F.col("o_orderkey")).alias("digest"))


@_query("WITH " + _SQL_TREE + " SELECT o_orderstatus, level, position, digest FROM tree")
def merkle_tree(spark, d):
    """The orders of each status as a tree of digests over ranges of their keys."""
    return merkle.tree(_order_leaves(_table(spark, d, "orders")), ["o_orderstatus"], _FANOUT)


@_query(
    f"""WITH hurt AS (SELECT o_orderstatus, o_orderkey // {_SPAN} AS position FROM orders WHERE o_orderkey % 1013 = 5),
    highest AS (SELECT max(o_orderkey) // {_SPAN} AS h FROM orders),
    levels AS (SELECT i AS level FROM highest, unnest(generate_series(0, 40)) AS u(i) WHERE i = 0 OR floor(h / {_FANOUT} ** (i - 1)) > 0)
    SELECT DISTINCT o_orderstatus, level::INTEGER AS level, floor(position / {_FANOUT} ** level)::BIGINT AS position FROM hurt, levels"""
)
def damaged_ranges(spark, d):
    """The nodes, from the roots down, by which the trees of the orders and of a copy with other customers here and there differ."""
    orders = _table(spark, d, "orders")
    hurt = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 1013 == 5, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    ours, theirs = (merkle.tree(_order_leaves(t), ["o_orderstatus"], _FANOUT) for t in (orders, hurt))
    return merkle.differing(ours, theirs, ["o_orderstatus"], _FANOUT)


@_query("WITH " + _SQL_TREE + " SELECT o_orderstatus, digest FROM tree WHERE highest = 0")
def proved_roots(spark, d):
    """The roots that a part of the orders leads to, with no more than the digests beside its way."""
    nodes = materialized(merkle.tree(_order_leaves(_table(spark, d, "orders")), ["o_orderstatus"], _FANOUT))
    part = _order_leaves(_table(spark, d, "orders").where(F.floor(F.col("o_orderkey") / _SPAN) % 5 == 0))
    return merkle.climbed(part, merkle.proof(nodes, part, ["o_orderstatus"], _FANOUT), ["o_orderstatus"], nodes.agg(F.max("level")).first()[0], _FANOUT)


_SQL_MATRIX = "matrix AS (SELECT vec_id AS file_id, u.i, embedding[u.i]::DOUBLE AS score FROM embeddings, (SELECT unnest([1, 2, 3]) AS i) u)"


@_query("WITH " + _SQL_MATRIX + " SELECT 'siglip2' AS model_id, printf('q%04d', i) AS query_id, file_id, score FROM matrix")
def matrix_scores(spark, d):
    """A matrix of scores, a row for each file and a value for each query, as long rows."""
    wide = _table(spark, d, "embeddings").select(F.col("vec_id").alias("file_id"), F.slice("embedding", 1, 3).cast("array<double>").alias("scores"))
    return similarity.from_matrix(wide, "siglip2", ["q0001", "q0002", "q0003"])


def _row_states(spark, d) -> DataFrame:
    state = (F.col("vec_id") % 3).cast("byte")
    return _table(spark, d, "embeddings").select(F.lit("clip").alias("model_id"), F.col("vec_id").alias("ordinal"), state.alias("state"))


def _row_vectors(spark, d) -> DataFrame:
    return _table(spark, d, "embeddings").where("vec_id % 3 = 1").select(F.lit("clip").alias("model_id"), F.col("vec_id").alias("ordinal"), "embedding")


@_query("SELECT 'clip' AS model_id, vec_id AS ordinal, (vec_id % 3)::INTEGER AS state, CASE WHEN vec_id % 3 = 1 THEN round(embedding[1]::DOUBLE, 9) END AS first FROM embeddings")
def row_states(spark, d):
    """Rows of an index with their states: only valid ones have a vector."""
    out = relations.with_states(_row_vectors(spark, d), _row_states(spark, d))
    return out.select("model_id", "ordinal", F.col("state").cast("int").alias("state"), F.round(F.get("embedding", F.lit(0)).cast("double"), 9).alias("first"))


@_query("SELECT 'clip' AS model_id, vec_id AS file_id, len(embedding)::INTEGER AS dimension FROM embeddings WHERE vec_id % 3 = 1")
def valid_rows(spark, d):
    """The rows that a search looks at."""
    out = search.valid_rows(relations.with_states(_row_vectors(spark, d), _row_states(spark, d)))
    return out.select("model_id", "file_id", F.size("embedding").alias("dimension"))


@_query("SELECT 'clip' AS model_id, vec_id AS ordinal FROM embeddings WHERE vec_id >= 320 UNION ALL SELECT 'siglip2', vec_id FROM embeddings WHERE vec_id > (SELECT max(vec_id) FROM embeddings)")
def resume_offset(spark, d):
    """Where builds go on: one model's commits have a gap after the fifth, the other's are whole."""
    commits = _commits(spark, d).where("model_id = 'siglip2' or sequence <> 5")
    return metrics.beyond_prefix(_table(spark, d, "embeddings").select(F.col("vec_id").alias("ordinal")), commits)


_SQL_STREAM = """commits AS (SELECT o_orderstatus AS model_id, (row_number() OVER w - 1)::INTEGER AS sequence, o_orderkey AS start, lead(o_orderkey, 1, o_orderkey + 1) OVER w AS stop, o_custkey % 7 AS valid FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey)),
    firsts AS (SELECT model_id, min(start) AS first FROM commits GROUP BY model_id),
    moved AS (SELECT model_id, sequence, start - first AS start, stop - first AS stop, valid, CASE WHEN model_id = 'F' THEN 1000 WHEN model_id = 'O' THEN 5 END AS gap FROM commits JOIN firsts USING (model_id)),
    given AS (SELECT *, coalesce(sequence < gap, TRUE) AS linked FROM moved WHERE coalesce(sequence <> gap, TRUE))"""


@_query(
    "WITH " + _SQL_STREAM + """ SELECT model_id, sequence, start, stop AS "end", linked, max(CASE WHEN linked THEN stop END) OVER w AS prefix, sum(CASE WHEN linked THEN valid ELSE 0 END) OVER w::BIGINT AS valid, 0::BIGINT AS errors
    FROM given WINDOW w AS (PARTITION BY model_id ORDER BY sequence ROWS UNBOUNDED PRECEDING)"""
)
def journal_stream(spark, d):
    """Commits as a stream, some files at a time: the orders of each status, two of which lack one, told by a state for each."""
    order = Window.partitionBy("o_orderstatus").orderBy("o_orderkey")
    commits = _table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("model_id"), (F.row_number().over(order) - 1).cast("int").alias("sequence"), F.col("o_orderkey").alias("start"), F.lead("o_orderkey").over(order).alias("next"),
        (F.col("o_custkey") % 7).alias("valid_count"), F.lit(0).cast("long").alias("error_count"), F.lit("").alias("rows_sha256"), F.lit("").alias("committed_at"),
    )
    first = F.min("start").over(Window.partitionBy("model_id"))
    moved = commits.withColumn("end", F.coalesce("next", F.col("start") + 1) - first).withColumn("start", F.col("start") - first).drop("next")
    given = materialized(moved.where("not (model_id = 'F' and sequence = 1000) and not (model_id = 'O' and sequence = 5)"))
    at = f"{shared_dir(spark)}/lodestar/stream-{uuid.uuid4().hex}"
    third = max(1, -(-(given.agg(F.max("sequence")).first()[0] or 0) // 3))
    for n in range(3):  # a journal that grows: files arrive in the order of sequences, and the stream goes on from its checkpoint
        last = F.lit(True) if n == 2 else F.col("sequence") < (n + 1) * third
        given.where((F.col("sequence") >= n * third) & last).write.mode("append").json(f"{at}/in")
        chain.follow(spark, f"{at}/in", f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema(chain.LINKED).parquet(f"{at}/out")


@_query("SELECT DISTINCT event_type AS model_id FROM events WHERE event_type NOT IN ('click', 'view')")
def unknown_models(spark, d):
    """Names in a journal that aren't known."""
    return relations.unknown_models(_table(spark, d, "events").select(F.col("event_type").alias("model_id")), ["click", "view", "never"])


@_query("SELECT o_custkey, o_orderpriority, count(*) AS times FROM orders GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, d):
    """Keys that a table of unique rows wouldn't repeat."""
    return checks.repeated(_table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@_query(_SQL_VECTORS + " SELECT row_number() OVER (ORDER BY position, final_rank) - 1 AS line, f.file_id, f.query_id FROM fused f JOIN labels l USING (query_id)")
def output_order(spark, d):
    """The lines of the audit report: queries in their order, in each the candidates by final rank."""
    rows = _fused(spark, d).select("position", "query_id", "final_rank", "file_id")
    return ranking.ordinals(rows, F.col("position"), F.col("query_id"), F.col("final_rank"), name="line").select("line", "file_id", "query_id")


_SQL_CELL = "printf('%.{}f', {})"


@_query(
    f"""SELECT o_orderkey::VARCHAR AS "FilePath", {_SQL_CELL.format(6, 'o_totalprice / 7')} AS "SigLIP2Score", CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE {_SQL_CELL.format(6, 'o_totalprice / 1000003')} END AS "CLIPCos",
    {_SQL_CELL.format(12, '1.0::DOUBLE / (60 + o_custkey)')} AS "FusionScore", (o_custkey % 1000)::VARCHAR AS "FinalRank" FROM orders"""
)
def report_cells(spark, d):
    """Numbers as reports show them: so many places, missing ones empty."""
    o = _table(spark, d, "orders")
    price = F.col("o_totalprice")
    rows = o.select(F.col("o_orderkey").cast("string").alias("FilePath"), (price / 7).alias("SigLIP2Score"), F.when(F.col("o_orderkey") % 4 != 0, price / 1000003).alias("CLIPCos"), (F.lit(1.0) / (F.col("o_custkey") + 60)).alias("FusionScore"), (F.col("o_custkey") % 1000).cast("int").alias("FinalRank"))
    return reports.cells(rows, tuple(rows.columns))


@_query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS before, CASE WHEN vec_id % 7 = 0 THEN 4.0 ELSE 1.0 END::DOUBLE AS stretched, 1.0::DOUBLE AS after FROM embeddings")
def unit_vectors(spark, d):
    """Vectors stretched and brought back to length one, as encoders' vectors are."""
    rows = _table(spark, d, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, 2.0).otherwise(1.0).alias("by"))
    long = rows.withColumn("longer", F.transform("embedding", lambda x: (x * F.col("by")).cast("float")))
    square = lambda c: F.round(similarity.dot(F.col(c), F.col(c)), 5)
    out = images.normalized(long, "longer", "unit")
    return out.select("vec_id", square("embedding").alias("before"), (F.col("by") * F.col("by")).alias("stretched"), square("unit").alias("after"))


# --------------------------------------------------------------------- orders


def _order_scores(spark, d) -> DataFrame:
    groups = _table(spark, d, "orders").groupBy(F.col("o_custkey").alias("file_id"), F.col("o_orderpriority").alias("query_id")).agg(F.max("o_totalprice").alias("dearest"), F.count("*").cast("double").alias("orders"))
    both = F.array(F.struct(F.lit("siglip2").alias("model_id"), F.col("dearest").alias("score")), F.struct(F.lit("clip").alias("model_id"), F.col("orders").alias("score")))
    return groups.select("file_id", "query_id", F.inline(both))


def _order_top(spark, d) -> DataFrame:
    return ranking.top_k(_order_scores(spark, d), K_ORDERS)


_SQL_ORDERS = (
    f"""WITH groups AS (SELECT o_custkey AS file_id, o_orderpriority AS query_id, max(o_totalprice) AS dearest, count(*)::DOUBLE AS orders FROM orders GROUP BY ALL),
    scores AS (SELECT 'siglip2' AS model_id, query_id, file_id, dearest AS score FROM groups UNION ALL SELECT 'clip', query_id, file_id, orders FROM groups),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY model_id, query_id ORDER BY score DESC, file_id)::INTEGER AS rank FROM scores QUALIFY rank <= {K_ORDERS}),
    places AS (SELECT DISTINCT query_id, 0 AS position FROM scores)"""
    + _sql_fused()
    + _sql_evaluated(K_STRONG)
)


@_query(_SQL_ORDERS + " SELECT model_id, query_id, file_id, score, rank FROM ranked")
def topk_ties(spark, d):
    """The best customers by each score and priority; the second score ties a lot."""
    return _order_top(spark, d)


@_query(_SQL_ORDERS + " SELECT file_id, query_id, models_matched, round(fusion_score, 12) AS fusion_score, final_rank, siglip2_rank, clip_rank FROM fused")
def rrf_fusion_orders(spark, d):
    out = fusion.model_columns(fusion.fuse(_order_top(spark, d)))
    return _rounded(out.select("file_id", "query_id", "models_matched", "fusion_score", "final_rank", "siglip2_rank", "clip_rank"), fusion_score=12)


@_query(_SQL_ORDERS + " SELECT file_id, evaluator_rank, round(evaluator_score, 12) AS evaluator_score, strong_query_count, best_query_id, best_query_rank FROM final")
def evaluator_cutoff(spark, d):
    """The evaluation of the fused priorities: only the first K_STRONG of each count."""
    return _rounded(fusion.evaluate(fusion.fuse(_order_top(spark, d)), K_STRONG).drop("query_matches"), evaluator_score=12)


@_query(_SQL_ORDERS + " SELECT model_id, file_id, query_id, score, rank FROM ranked")
def dedupe_candidates(spark, d):
    """Candidates that occur twice, once with a worse rank, are one again."""
    top = _order_top(spark, d)
    worse = top.withColumns({"rank": F.col("rank") + 1, "score": F.col("score") + 1})
    return ranking.dedupe(top.unionByName(worse))


_SQL_MANY = """scored AS (SELECT 'm' || o_orderkey % 211 AS model_id, o_orderpriority AS query_id, o_custkey AS file_id, (o_orderkey % 5000 + 1)::INTEGER AS rank, (o_orderkey % 211) * 37 % 211 AS place FROM orders),
    once AS (SELECT model_id, query_id, file_id, min(rank) AS rank, any_value(place) AS place FROM scored GROUP BY ALL),
    listed AS (SELECT file_id, query_id, list(rank ORDER BY place) AS ranks FROM once GROUP BY ALL),
    summed AS (SELECT file_id, query_id, len(ranks)::INTEGER AS models, list_min(ranks) AS best_rank, list_reduce(list_transform(ranks, lambda r: 1.0::DOUBLE / (60 + r)), lambda a, x: a + x) AS fusion_score FROM listed)"""


@_query("WITH " + _SQL_MANY + " SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, models DESC, best_rank, file_id)::INTEGER AS final_rank FROM summed")
def fusion_of_many_models(spark, d):
    """Ranks of 211 models fused without a list of them; scores to the last bit."""
    key = F.col("o_orderkey")
    given = _table(spark, d, "orders").select(F.concat(F.lit("m"), key % 211).alias("model_id"), F.col("o_orderpriority").alias("query_id"), F.col("o_custkey").alias("file_id"), F.lit(0.0).alias("score"), (key % 5000 + 1).cast("int").alias("rank"))
    order = spark.range(211).select(F.concat(F.lit("m"), "id").alias("model_id"), (F.col("id") * 37 % 211).cast("int").alias("place"))
    return fusion.fuse_many(given, order)


@_query("SELECT file_id, query_id FROM (" + _SQL_ORDERS + " SELECT DISTINCT file_id, query_id FROM ranked)")
def set_union(spark, d):
    """Keys that any model ranked."""
    return relations.keys_of(_order_top(spark, d))


@_query("SELECT o_custkey AS file_id FROM orders WHERE o_custkey IS NOT NULL EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def set_difference(spark, d):
    """Customers with orders but those in debt."""
    ordered = _table(spark, d, "orders").select(F.col("o_custkey").alias("file_id"))
    return ordered.distinct().join(_table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("file_id")), "file_id", "left_anti")


@_query(_SQL_ORDERS + " SELECT count(*) AS pairs, max(abs(a.rank - b.rank)) AS largest FROM ranked a JOIN ranked b USING (file_id, query_id) WHERE a.model_id = 'siglip2' AND b.model_id = 'clip'")
def largest_difference(spark, d):
    """How far the two models' ranks of the same candidate lie apart."""
    top = _order_top(spark, d)
    return relations.largest_difference(top.where("model_id = 'siglip2'"), top.where("model_id = 'clip'"), ["file_id", "query_id"], "rank")


@_query("SELECT printf('q%04d', p + 1) AS query_id, p AS position, r_name AS original_query, r_name AS model_query FROM (SELECT r_name, r_regionkey::INTEGER AS p FROM region)")
def query_ids(spark, d):
    """Texts as queries: ids by place."""
    return numbered(_table(spark, d, "region"), "r_regionkey", "r_name")


# ------------------------------------------------------------------ documents


def _path() -> Column:
    kinds = F.array(*[F.lit(x) for x in (".JPG", ".png", ".txt", ".tif")])
    name = F.concat(F.lit("doc"), F.col("doc_id"), F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")))
    whole = F.concat_ws("/", F.col("lang"), F.col("source"), name)
    return F.when(F.col("doc_id") % 5 == 0, F.concat_ws("/", F.col("lang"), name)).otherwise(whole)


_SQL_NAME = "'doc' || doc_id || (['.JPG', '.png', '.txt', '.tif'])[doc_id % 4 + 1]"
_SQL_PATHS = f"""paths AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN lang || '/' || {_SQL_NAME} ELSE lang || '/' || source || '/' || {_SQL_NAME} END AS path FROM documents),
    keyed AS (SELECT doc_id, path, list_transform(string_split(path, '/'), lambda x, i: struct_pack(d := CASE WHEN i < len(string_split(path, '/')) THEN 1 ELSE 0 END, f := lower(x), n := x)) AS k FROM paths),
    walked AS (SELECT doc_id, path, row_number() OVER (ORDER BY k) - 1 AS ordinal FROM keyed)"""


def _paths(spark, d) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", _path().alias("path"))


@_query("WITH " + _SQL_PATHS + " SELECT ordinal, path FROM walked")
def dfs_order(spark, d):
    """Ordinals in walk order: in each folder the files first, then its folders."""
    return ranking.ordinals(_walked(_paths(spark, d)), F.col("walk_key"), keep=["path"])


_NAMES = ("Straße", "STRASSE", "strasse", "ÉTÉ", "été", "Οδός", "ΟΔΟΣ", "ﬁn", "FIN", "İz", "Ǆ", "ŉ")
_SQL_FOLDED = f"""named AS (SELECT doc_id, ({list(_NAMES)})[doc_id % {len(_NAMES)} + 1] AS folder, ({list(_NAMES)})[doc_id * 7 % {len(_NAMES)} + 1] || doc_id // 50 AS name FROM documents),
    texts AS (SELECT DISTINCT unnest([folder, name]) AS t FROM named),
    folds AS (SELECT t, replace(replace(replace(replace(replace(replace(lower(replace(replace(t, 'İ', 'i̇'), 'Ǆ', 'ǆ')), 'ß', 'ss'), 'ς', 'σ'), 'ﬁ', 'fi'), 'ŉ', 'ʼn'), 'É', 'é'), 'Σ', 'σ') AS f FROM texts),
    walked AS (SELECT folder || '/' || name AS path, a.f AS one, folder, b.f AS two, name FROM (SELECT DISTINCT folder, name FROM named) JOIN folds a ON a.t = folder JOIN folds b ON b.t = name)"""


@_query("WITH " + _SQL_FOLDED + " SELECT row_number() OVER (ORDER BY one, folder, two, name) - 1 AS ordinal, path FROM walked")
def folded_order(spark, d):
    """Names outside ASCII in walk order, by full case folding: sharp s, final sigma, ligatures, dotted capitals."""
    of = lambda n: F.element_at(F.array(*[F.lit(x) for x in _NAMES]), (n % len(_NAMES) + 1).cast("int"))
    name = F.concat(of(F.col("doc_id") * 7), F.floor(F.col("doc_id") / 50).cast("string"))
    found = _table(spark, d, "documents").select(F.concat_ws("/", of(F.col("doc_id")), name).alias("path")).distinct()
    return ranking.ordinals(_walked(found), F.col("walk_key"), keep=["path"])


@_query("WITH " + _SQL_PATHS + " SELECT path FROM walked WHERE ordinal < 100")
def limit_discovery(spark, d):
    """The first hundred in walk order: the feature of a partial scan."""
    return ranking.first_in_order(_walked(_paths(spark, d)), 100, F.col("walk_key")).select("path")


@_query("WITH " + _SQL_PATHS + " SELECT doc_id, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS suffix FROM paths WHERE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.jpg', '.jpeg', '.png', '.bmp', '.webp', '.tif', '.tiff')")
def extension_filter(spark, d):
    """Files of the known image types, whatever their case."""
    return _paths(spark, d).select("doc_id", paths.suffix(F.col("path")).alias("suffix")).where(F.col("suffix").isin(*paths.EXTENSIONS))


@_query("WITH " + _SQL_PATHS + " SELECT doc_id, 'E:\\case\\' || replace(path, '/', '\\') AS shown FROM paths")
def display_path(spark, d):
    """Paths below a root in Windows notation."""
    return _paths(spark, d).select("doc_id", paths.display(F.col("path"), F.col("path"), "E:/case/").alias("shown"))


@_query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_sha256(spark, d):
    """Content hashes of whole texts."""
    return _table(spark, d, "documents").select("doc_id", digests.content(F.col("text")).alias("sha256"))


def _states(spark, d) -> DataFrame:
    """Documents without a quality label are pending, good ones valid, bad ones failed."""
    labels = _table(spark, d, "labels")
    state = F.when(F.col("quality").isNull(), 0).when(F.col("quality") == 1, 1).otherwise(2)
    return _table(spark, d, "documents").select("doc_id", "source").join(labels, "doc_id", "left").select(F.col("source").alias("model_id"), F.col("doc_id").alias("ordinal"), state.alias("state"))


_SQL_STATES = "states AS (SELECT source AS model_id, d.doc_id AS ordinal, CASE WHEN quality IS NULL THEN 0 WHEN quality = 1 THEN 1 ELSE 2 END AS state FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


@_query("WITH " + _SQL_STATES + " SELECT model_id, count(*) FILTER (state = 1) AS valid, count(*) FILTER (state = 2) AS decode_errors, count(*) FILTER (state = 0) AS pending, 0::BIGINT AS unknown_states FROM states GROUP BY model_id")
def row_state_counts(spark, d):
    return metrics.state_counts(_states(spark, d))


def _passes(spark, d) -> DataFrame:
    status = F.when(F.col("state") == 1, "processed").when(F.col("state") == 2, "decode_error")
    return _states(spark, d).select("model_id", "ordinal", status.alias("status")).where("status is not null")


@_query("WITH " + _SQL_STATES + " SELECT model_id, count(DISTINCT ordinal) FILTER (state = 1) AS processed, count(DISTINCT ordinal) FILTER (state = 2) AS decode_errors FROM states WHERE state > 0 GROUP BY model_id")
def pass_metrics(spark, d):
    return metrics.pass_metrics(_passes(spark, d))


@_query("SELECT count(DISTINCT user_id) FILTER (event_type IN ('click', 'view')) AS processed, count(DISTINCT user_id) FILTER (event_type NOT IN ('click', 'view')) AS decode_errors FROM events")
def scan_metrics(spark, d):
    """Users that ever clicked or viewed, and users that did something else, over all passes."""
    kind = F.when(F.col("event_type").isin("click", "view"), "processed").otherwise("decode_error")
    return metrics.scan_metrics(_table(spark, d, "events").select(F.lit("m").alias("model_id"), F.col("user_id").alias("ordinal"), kind.alias("status")))


@_query("SELECT count(DISTINCT user_id) FILTER (event_type IN ('click', 'view')) AS processed, count(DISTINCT user_id) FILTER (event_type NOT IN ('click', 'view')) AS decode_errors FROM events")
def coverage_over_passes(spark, d):
    """The same from the stored bitmaps of one pass after another, a pass for each weekday; the events aren't looked at again."""
    kind = F.when(F.col("event_type").isin("click", "view"), "processed").otherwise("decode_error")
    seen = _table(spark, d, "events").select(F.col("event_type").alias("model_id"), F.col("user_id").alias("ordinal"), kind.alias("status"), (F.col("event_id") % 3).alias("pass"))
    path = f"{shared_dir(spark)}/lodestar/passes-{uuid.uuid4().hex}"
    for n in range(3):
        metrics.record_pass(seen.where(F.col("pass") == n), path)
    return metrics.covered(metrics.recorded(spark, path))


@_query("SELECT event_type AS model_id, 'processed' AS status, count(DISTINCT user_id) AS ordinals FROM events GROUP BY event_type")
def bitmap_counts(spark, d):
    """Distinct users of each event type, by bitmaps."""
    return metrics.bitmap_counts(_table(spark, d, "events").select(F.col("event_type").alias("model_id"), F.lit("processed").alias("status"), F.col("user_id").alias("ordinal")))


@_query("SELECT count(*) AS lines FROM documents WHERE trim(text) <> ''")
def line_count(spark, d):
    return metrics.lines(_table(spark, d, "documents").select(F.col("text").alias("value")))


_SQL_LINES = """given AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS number, doc_id FROM documents),
    kept AS (SELECT *, CASE WHEN doc_id % 97 = 3 THEN 'blank' WHEN doc_id % 89 = 7 THEN 'broken' WHEN doc_id % 83 = 11 THEN 'lacking' ELSE 'fine' END AS kind FROM given),
    placed AS (SELECT *, count(*) FILTER (kind <> 'blank') OVER (ORDER BY number ROWS UNBOUNDED PRECEDING) - 1 AS expected FROM kept)"""


@_query(
    "WITH " + _SQL_LINES + """ SELECT number, CASE kind WHEN 'broken' THEN 'isn''t a JSON object of the columns and types asked for' WHEN 'lacking' THEN 'lacks source_path'
        ELSE 'has ordinal ' || number || ' where a contiguous manifest has ' || expected END AS problem FROM placed WHERE kind IN ('broken', 'lacking') OR (kind = 'fine' AND number <> expected)"""
)
def bad_manifest_lines(spark, d):
    """The lines of a manifest that can't be read, with their places: some are broken, some lack a path, and blank ones put those behind them out of place."""
    numbered_ = ranking.ordinals(_table(spark, d, "documents").select("doc_id"), F.col("doc_id"), name="number")
    whole = F.to_json(F.struct(F.col("number").alias("ordinal"), F.col("doc_id").cast("string").alias("relative_path"), F.when(F.col("doc_id") % 83 != 11, "/x").alias("source_path")))
    line = F.when(F.col("doc_id") % 97 == 3, " \t").when(F.col("doc_id") % 89 == 7, F.substring(whole, 1, 9)).otherwise(whole)
    path = f"{shared_dir(spark)}/lodestar/lines-{uuid.uuid4().hex}"
    numbered_.orderBy("number").select(line.alias("value")).write.text(path)
    return manifests.faults(spark, path, MANIFEST).select("number", "problem")
