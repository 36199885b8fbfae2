"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import read_table, spread
from loomspark.llm.oracles import ORACLE_SQL  # noqa: F401


def op7_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.mixing import document_rates

    return document_rates(spread(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "labels"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.media import media_digest

    return media_digest(spread(read_table(spark, sf_dir, "documents")))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.toxicity import score_toxicity, train_toxicity

    docs = spread(read_table(spark, sf_dir, "documents"))
    return score_toxicity(docs, train_toxicity(docs, read_table(spark, sf_dir, "labels")))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.pii import replace_entities

    return replace_entities(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.url_reputation import judge_pages

    return judge_pages(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))


def op4_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.ego_join import cosine_components

    return cosine_components(read_table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.language_id import identify_languages

    return identify_languages(spread(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "pages"))


def op6_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.shingle_join import shingle_components

    return shingle_components(spread(read_table(spark, sf_dir, "documents")), k=4, percent=85)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.token_counts import token_counts

    return token_counts(spread(read_table(spark, sf_dir, "documents")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.packing import pack_documents

    return pack_documents(spread(read_table(spark, sf_dir, "documents")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.merkle import merkle_manifest, tampered_text

    return merkle_manifest(spread(read_table(spark, sf_dir, "documents")), tampered_text())


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.substring import remove_repeated_passages

    return remove_repeated_passages(spread(read_table(spark, sf_dir, "documents")), texts=False)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.llm.hard_negatives import mine_hard_negatives, relabelled

    return mine_hard_negatives(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=relabelled())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_url_reputation": op3_url_reputation,
    "op4_epsilon_grid_join": op4_epsilon_grid_join,
    "op5_language_id": op5_language_id,
    "op6_shingle_join": op6_shingle_join,
    "op7_soft_mixing": op7_soft_mixing,
    "op8_media_columns": op8_media_columns,
    "op9_token_counts": op9_token_counts,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}
