"""Files as sources and sinks: directory scans, snapshots, JSON lines, zipped JSON lines, publication."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.session import shared_folder

SUFFIXES = ["md", "markdown", "txt", "pdf"]
MAX_BYTES = 16 << 20


def saved(df: DataFrame, label: str) -> DataFrame:
    """df as a derived table in the shared folder: later plans read it instead of deriving it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/markloom/{label}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def scan(spark: SparkSession, root: str, max_files: int | None = None, reserved: str = "/[._][^/]*/") -> DataFrame:
    """(path, digest, byte_count, text, state): files with a known suffix below root; reserved folders are passed over.

    More than max_files is an error for the whole scan: nothing is published from a part of it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    wanted = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(SUFFIXES) & ~F.col("path").rlike(reserved))
    if max_files is not None and wanted.select("path").limit(max_files + 1).count() > max_files:
        raise ValueError(f"more than {max_files} files")
    return snapshots(wanted)


def snapshots(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """binaryFile rows as versions: digest of the bytes, text without a byte-order mark, and what is wrong if anything."""
    text = F.try_validate_utf8(F.col("content").cast("string")) if hasattr(F, "try_validate_utf8") else F.col("content").cast("string")
    pdf = F.lower("path").endswith(".pdf")
    state = F.when(F.col("length") > max_bytes, "too_large").when(pdf, "needs_conversion").when(text.isNull(), "not_utf8").otherwise("ready")
    return files.select("path", F.sha2("content", 256).alias("digest"), F.col("length").alias("byte_count"), state.alias("state"), F.when(state == "ready", F.regexp_replace(text, "^﻿", "")).alias("text"), F.col("modificationTime").alias("modified"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a log; lines that aren't a record keep their text in `broken`."""
    schema = "version int, sequence long, timestamp string, event string, fields string, previous_hash string, hash string"
    raw = spark.read.text(path)
    parsed = F.from_json("value", schema)
    return raw.select(parsed.alias("r"), "value").select("r.*", F.when(F.col("r.sequence").isNull() | F.col("r.hash").isNull(), F.col("value")).alias("broken"))


def write_log(rows: DataFrame, path: str) -> None:
    rows.select("sequence", "timestamp", "event", "fields", "previous_hash", "hash").withColumn("version", F.lit(1)).write.mode("append").json(path)


def read_zipped_lines(spark: SparkSession, path: str, digests: dict[str, str] | None = None, max_bytes: int = 1 << 28) -> DataFrame:
    """(archive, member, line_no, line) of zip archives of JSON lines; members must have the given SHA-256, if any.

    An archive is one task's work, member by member and line by line."""
    pinned = digests or {}

    def unpack(parts):
        import hashlib

        for pdf in parts:
            for archive, content in zip(pdf.path, pdf.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if info.file_size > max_bytes:
                            raise ValueError(f"{info.filename} is too large")
                        with z.open(info) as f:
                            sha, rows = hashlib.sha256(), []
                            for i, line in enumerate(f):
                                sha.update(line)
                                rows.append((archive, info.filename, i, line.decode("utf-8").rstrip("\n")))
                                if len(rows) == 10_000:
                                    yield pd.DataFrame(rows, columns=["archive", "member", "line_no", "line"])
                                    rows = []
                        if pinned.get(info.filename, sha.hexdigest()) != sha.hexdigest():
                            raise ValueError(f"{info.filename} isn't the pinned one")
                        yield pd.DataFrame(rows, columns=["archive", "member", "line_no", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "archive string, member string, line_no long, line string")


def publish_texts(texts: DataFrame, path: str) -> None:
    """Markdown texts into a new managed folder; an existing one is never overwritten."""
    texts.select("text").write.mode("errorifexists").text(path)


def save_snapshot(df: DataFrame, path: str, version: int) -> None:
    """A new immutable version of a table, partitioned by scope."""
    df.write.mode("errorifexists").partitionBy("scope").parquet(f"{path}/v{version}")
