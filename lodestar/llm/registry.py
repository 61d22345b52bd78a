"""The queries of this package, with production parameters over whole tables.

The exact searches, the licence scan and the repair of conversations have SQL to agree with.
Fingerprints, trained models, tokenizers and trees of HTML are beyond SQL, and approximate
neighbours don't equal exact ones: their tests hold them against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import conversations, language, lexical, licenses, lm, nbest, neighbours, packing, simhash, token_counts, topk, toxicity, wrappers
from lodestar.llm.common import documents, table


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where("vec_id % 50 = 0"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(documents(spark, sf_dir))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(documents(spark, sf_dir))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_n_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.n_best(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), 3)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir), licenses.known(spark))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(conversations.damaged(table(spark, sf_dir, "conversations")))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    whole = "list_transform({}.embedding, lambda x: floor(256 * x::DOUBLE))"
    scored = f"list_dot_product({whole.format('q')}, {whole.format('e')})::BIGINT"
    return {
        "op4_top_k": f"""
            SELECT * FROM (
                SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
                FROM (SELECT q.vec_id AS query_id, e.vec_id, {scored} AS score
                      FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id))
            WHERE rank <= 5""",
        "op8_licenses": licenses.scan_sql(),
        "op11_ranked": lexical.ranked_sql(),
        "op12_repair": conversations.repaired_sql(),
    }
