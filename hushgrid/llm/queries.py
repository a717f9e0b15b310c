"""Queries of the ten operators, with production parameters over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, html_crf, langid, line_dedup, minhash, packing, pivots, prefix_counts, quality_fm
from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.copies(table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.count(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.copies(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


_ALL = (
    op1_best_fit_packing,
    op2_html_extraction,
    op3_embedding_near_dedup,
    op4_token_counts,
    op5_bpe,
    op6_line_dedup,
    op7_exact_dedup,
    op8_minhash_near_dedup,
    op9_quality_classifier,
    op10_language_id,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

ORACLE_SQL: dict[str, str] = {
    "op7_exact_dedup": """
        WITH numbered AS (
            SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS r
            FROM documents WHERE text IS NOT NULL)
        SELECT keep AS doc_id, CASE WHEN r > 1 THEN doc_id END AS copy_id FROM numbered
        UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL""",
}
