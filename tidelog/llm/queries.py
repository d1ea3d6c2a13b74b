"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import oracle
from tidelog.llm.common import load
from tidelog.llm.decontaminate import contamination
from tidelog.llm.html import extract_text
from tidelog.llm.imatch import fingerprints_and_edits
from tidelog.llm.lm import score_texts
from tidelog.llm.packing import pack
from tidelog.llm.pii import key_of, pseudonymize
from tidelog.llm.quality import quality_scores
from tidelog.llm.secrets import secret_scan
from tidelog.llm.simhash import near_duplicates
from tidelog.llm.tokens import public_path, token_counts

VOCABULARY = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality_scores(docs, load(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"), vocabulary=public_path(VOCABULARY))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(load(spark, sf_dir, "documents"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the session's key or, for a run by itself, one that nobody else knows."""
    key = key_of(spark) if spark.conf.get("tidelog.pii.key", None) else secrets.token_bytes(32)
    return pseudonymize(load(spark, sf_dir, "documents"), key=key)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(load(spark, sf_dir, "documents"), vocabulary=public_path(PIECES))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(load(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"), vocabulary=public_path(VOCABULARY))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_and_edits(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_benchmark_decontamination, op2_quality_classifier, op3_best_fit_packing, op4_secret_scans, op5_pii_surrogates, op6_lm_scoring, op7_html_extraction, op8_token_counts, op9_simhash_near_dedup, op10_document_fingerprints]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_benchmark_decontamination": oracle.OP1}
