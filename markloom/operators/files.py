"""Operators over chunks, pages and file versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def page_spans(texts: DataFrame, width: int = 1500) -> DataFrame:
    """(doc_id, page, start, end): pages of `width` characters, for texts that have no page marks."""
    n = F.greatest(F.length("text"), F.lit(1))
    return texts.select("doc_id", F.posexplode(F.sequence(F.lit(0), n - 1, F.lit(width))).alias("page", "start"), n.alias("n")).select("doc_id", (F.col("page") + 1).alias("page"), "start", F.least(F.col("start") + width, F.col("n")).alias("end"))


def page_occurrences(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages that a chunk lies on: an overlap join within each document, which is small."""
    c = chunks.select("doc_id", "chunk_index", F.col("start_character").alias("c_start"), (F.col("start_character") + F.length("text")).alias("c_end"))
    p = pages.select("doc_id", "page", F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    return c.join(p, "doc_id").where("c_start < p_end and c_end > p_start").select("doc_id", "chunk_index", "page")


def span_violations(pages: DataFrame) -> DataFrame:
    """Pages that don't begin where the one before ends."""
    w = W.partitionBy("doc_id").orderBy("page")
    return pages.withColumn("before", F.coalesce(F.lag("end").over(w), F.lit(0))).where("start <> before or end < start").select("doc_id", "page", "start", "before")


def neighbor_chunks(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The chunks beside wanted(doc_id, chunk_index): both keys are equality keys, one chunk off."""
    beside = wanted.select("doc_id", F.col("chunk_index").alias("of_chunk"), F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("chunk_index"))
    return beside.join(chunks, ["doc_id", "chunk_index"])


def file_census(files: DataFrame) -> DataFrame:
    """Per state of files(state, byte_count): how many, and their bytes."""
    return files.groupBy("state").agg(F.count("*").alias("files"), F.sum("byte_count").alias("bytes"))


def gone_paths(heads: DataFrame, seen: DataFrame) -> DataFrame:
    """Heads whose path a scan no longer saw."""
    return heads.join(seen.select("scope", "path").distinct(), ["scope", "path"], "left_anti")


def version_conflicts(materials: DataFrame, identity: list[str], version: str) -> DataFrame:
    """Identities that come with several versions."""
    return materials.groupBy(*identity).agg(F.count_distinct(version).alias("versions")).where("versions > 1")


def publish(heads: DataFrame, ready: DataFrame) -> DataFrame:
    """Heads moved to the newest ready version of each path: (scope, path, source_id)."""
    newest = ready.groupBy("scope", "path").agg(F.max_by("source_id", F.struct("created_at", "source_id")).alias("new_id"))
    both = heads.join(newest, ["scope", "path"], "full_outer")
    return both.select("scope", "path", F.coalesce("new_id", "source_id").alias("source_id"))
