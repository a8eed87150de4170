"""A cleaning pipeline over documents, counted as part of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet into the shared
folder and reads it back as the next stage's docs. All but the last return the columns of documents.

1. quality_rules: rejected documents go (short, repetitive, or depleted by frequent lines); the others lose their
   host's frequent lines.
2. line_dedup: lines that are near-copies of an earlier line go; documents left without a word go.
3. simhash: of each group of near-duplicates (Jaccard similarity of 5-word shingles of 0.8 or more, in steps)
   the document with the smallest doc_id stays.
4. decontamination: documents that hold a benchmark passage go.
5. byte_bpe: what is left is encoded, decoded again and reported.

A stage's working tables go when the next stage begins: by then its result has been written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.llm import byte_bpe, decontaminate, line_dedup, quality_rules, simhash
from markloom.llm.common import cut, discard, recorded, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The working tables of the stage that was called last.
_WORKING: list[str] = []


def stage(f: Stage) -> Stage:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _WORKING)
        with recorded(_WORKING):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(quality_rules.clean(docs))


@stage
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_dedup.deduplicate(docs))


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars as the texts are now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@stage
def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


@stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


@stage
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", token_stage),
]
#: Similar sets and edit distances over all lines aren't for SQL: tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
