"""What the operators share: tables, the shared scratch folder, Arrow helpers, components."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.session import shared_folder, ship_package

#: Rows that one Arrow batch hands to a Python worker; texts are a few kB, some much longer.
BATCH_ROWS = 256
#: Texts of a batch are worked on in slices of about so many bytes.
SLICE_BYTES = 4 << 20
_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keeps what a Python worker gets at once small (a batch of long texts must fit in its memory), and
    sends this package to executors that don't have it on their path.

    Spark knows the size of a batch for a session only. It is lowered, never raised, so that no caller undoes another's
    bound; it decides memory, not results."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    ship_package(spark)


def bounded(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    bounded_batches(df.sparkSession, rows)
    return df


#: Lists that get the folders made while they are here.
_RECORDERS: list[list[str]] = []


@contextmanager
def recorded(into: list[str]) -> Iterator[None]:
    """Meanwhile, scratch folders are noted in `into`."""
    _RECORDERS.append(into)
    try:
        yield
    finally:
        _RECORDERS.remove(into)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch folders that nothing reads any more."""
    while paths:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
    release(spark)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, removed when the session's file systems close."""
    path = f"{shared_folder(spark).rstrip('/')}/markloom/{label}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    for into in _RECORDERS:
        into.append(path)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: its lineage ends there, and executors may be lost.

    The shuffle files that went into it are released as soon as the driver's garbage is collected.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of plans that nothing refers to."""
    gc.collect()
    spark._jvm.System.gc()


def map_rows(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, size: int = SLICE_BYTES) -> DataFrame:
    """df.mapInArrow for a function of one batch; long batches come in slices of about `size` bytes."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for piece in slices(batch, size):
                if (out := f(piece)) is not None and out.num_rows:
                    yield out

    return df.mapInArrow(over, schema)


def give_back() -> None:
    """Returns to the system what earlier tasks of this Python worker have freed; workers are reused, and share an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every system's C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    if not n:
        return
    step = max(1, n // max(1, -(-batch.nbytes // size)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def blocks(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """data in pieces of about `size` bytes that part at ASCII white space, so that a long text's words are never all held at once."""
    at = 0
    while len(data) - at > size:
        found = _BREAK.search(data, at + size)
        end = found.start() if found else len(data)
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def components(links: DataFrame, label: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of links(a, b) reaches; long columns.

    Alternates large-star and small-star (Kiveris et al., 2014), each a pair of joins, until the
    links stop changing. Every round's links are written to the shared folder; only a count and a
    checksum reach the driver.
    """
    pair = lambda a, b: F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    now = cut(links.select(pair(F.col("a"), F.col("b")).alias("p")).select("p.*").where("lo <> hi").distinct(), label)
    mark = None
    for _ in range(max_rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(floor, "hi").select(F.col("lo").alias("a"), "m", "hi")
        after = small.select(F.col("a").alias("hi"), F.col("m").alias("lo")).union(small.select("hi", F.col("m").alias("lo"))).where("hi <> lo").distinct()
        now = cut(after, label)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).head()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"links still change after {max_rounds} rounds")
    roots = now.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("node"), "root").union(roots)
