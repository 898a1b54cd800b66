"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm import (bpe, decontaminate, html, langid, licenses, parsing, partcodes, perplexity, quality, simhash, suffix,
                         wavelet, whitening)
from lucerna.llm.common import table

TOKENIZERS = os.environ.get("LUCERNA_TOKENIZERS") or os.path.dirname(public_tokenizers.path("."))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality_rules(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_report(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.recognise(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_index(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


def op11_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partcodes.report(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


def op13_parsing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.compare_with_edits(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_suffix_dedup, op3_language_id, op4_license_scan, op5_simhash, op6_html_text, op7_decontamination, op8_bpe,
    op9_quality_classifier, op10_token_index, op11_part_codes, op12_whitening, op13_parsing_fingerprints)}
ORACLES = {"op4_license_scan": licenses.oracle()}
