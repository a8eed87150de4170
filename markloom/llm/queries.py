"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, divergence, language_model, line_dedup, pii, quality_classifier, quality_rules, role_repair, simhash, suffix_dedup, token_counts, warc
from .common import table

#: Stands for a secret of whoever runs this.
PII_KEY = "markloom demonstration key"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), PII_KEY)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.report(table(spark, sf_dir, "documents"))


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.report(table(spark, sf_dir, "documents"))


def op13_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_repair.report(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_suffix_dedup, op3_warc, op4_byte_bpe, op5_line_dedup, op6_token_counts, op7_quality_rules, op8_quality_classifier, op9_pii, op10_decontaminate, op11_divergence, op12_language_model, op13_role_repair)}
ORACLES: dict[str, str] = {"op3_warc": warc.SQL, "op7_quality_rules": quality_rules.SQL, "op10_decontaminate": decontaminate.SQL, "op11_divergence": divergence.SQL}
