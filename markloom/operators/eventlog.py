"""An append-only log with a hash chain: verification, retention, traces, call lifecycles."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType

from markloom.operators import ranges

RETENTION_SECONDS = 86_400
ZERO = "0" * 64


def canonical(record: dict) -> str:
    """JSON with sorted keys and no spaces; NaN is refused."""
    return json.dumps(record, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def record_hash(sequence: int, timestamp: str, event: str, fields: str, previous: str) -> str:
    body = {"version": 1, "sequence": sequence, "timestamp": timestamp, "event": event, "fields": json.loads(fields), "previous_hash": previous}
    return hashlib.sha256(canonical(body).encode()).hexdigest()


def chained(rows: DataFrame, log: str = "log_id") -> DataFrame:
    """rows(log_id, sequence, timestamp, event, fields) with previous_hash and hash.

    A log is what one writer appended; logs are independent. A log's rows are folded in order, each hash carried to the
    next row, so a task holds a batch and one hash, however long a log is."""

    def step(previous: str | None, r: dict) -> tuple[str, list[tuple]]:
        previous = previous or ZERO
        digest = record_hash(r["sequence"], r["timestamp"], r["event"], r["fields"], previous)
        return digest, [(r[log], r["sequence"], r["timestamp"], r["event"], r["fields"], previous, digest)]

    schema = f"{log} string, sequence long, timestamp string, event string, fields string, previous_hash string, hash string"
    own = rows.select(F.col(log).cast("string"), F.col("sequence").cast("long"), "timestamp", "event", "fields")
    return ranges.carried(own, [log], ["sequence"], step, schema)


@F.pandas_udf(StringType())
def _expected(sequence: pd.Series, timestamp: pd.Series, event: pd.Series, fields: pd.Series, previous: pd.Series) -> pd.Series:
    def one(*r):
        try:
            return record_hash(*r)
        except ValueError:
            return None

    return pd.Series([one(*r) for r in zip(sequence.tolist(), timestamp, event, fields, previous, strict=True)])


def chain_violations(rows: DataFrame, log: str = "log_id") -> DataFrame:
    """Rows whose number, time, link or hash is wrong, with the reason; every row is checked on its own."""
    w = W.partitionBy(log).orderBy("sequence")
    first = F.row_number().over(w) == 1
    checked = rows.withColumn("before", F.lag("hash").over(w)).withColumn("number", F.lag("sequence").over(w)).withColumn("time", F.lag("timestamp").over(w)).withColumn("first", first)
    expected = _expected("sequence", "timestamp", "event", "fields", "previous_hash")
    reason = (
        F.when(~F.col("first") & (F.col("sequence") != F.col("number") + 1), "sequence")
        .when(~F.col("first") & (F.col("previous_hash") != F.col("before")), "link")
        .when(F.col("first") & (F.col("sequence") == 1) & (F.col("previous_hash") != ZERO), "link")
        .when(~F.col("first") & (F.col("timestamp") < F.col("time")), "time")
        .when(F.coalesce(expected != F.col("hash"), F.lit(True)), "hash")
    )
    return checked.withColumn("reason", reason).where("reason is not null").select(log, "sequence", "reason")


def retained(rows: DataFrame, now, seconds: int = RETENTION_SECONDS, time: str = "ts") -> DataFrame:
    """Rows after the cutoff and not after now; a row exactly at the cutoff is gone."""
    cutoff = F.lit(now) - F.expr(f"interval {seconds} seconds")
    return rows.where((F.col(time) > cutoff) & (F.col(time) <= F.lit(now)))


def retention_split(rows: DataFrame, now, seconds: int = RETENTION_SECONDS, time: str = "ts", trace: str = "trace_id") -> DataFrame:
    """Per trace: rows that go and that stay, and whether the cut runs through it."""
    gone = F.col(time) <= F.lit(now) - F.expr(f"interval {seconds} seconds")
    return rows.groupBy(trace).agg(F.count_if(gone).alias("removed"), F.count_if(~gone).alias("kept")).withColumn("partial", (F.col("removed") > 0) & (F.col("kept") > 0))


def trace_summary(rows: DataFrame, terminal: str = "purchase", start: str = "signup", time: str = "ts", trace: str = "trace_id") -> DataFrame:
    """Per trace: its number of events, their distinct names by first appearance, its last time and its status."""
    names = rows.groupBy(trace, "event").agg(F.min(F.struct(time, "event_id")).alias("at"))
    listed = names.groupBy(trace).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "event"))), lambda s: s["event"]), ",").alias("events"))
    counted = rows.groupBy(trace).agg(F.count("*").alias("event_count"), F.max(time).alias("last_ts"), F.max(F.when(F.col("event") == terminal, F.struct(time, "event_id", F.col("k").alias("k")))).alias("end"), F.max((F.col("event") == start).cast("int")).alias("started"))
    status = F.when(F.col("end").isNotNull() & (F.col("end.k") % 2 == 0), "delivered").when(F.col("end").isNotNull(), "failed").when(F.col("started") == 1, "incomplete").otherwise("passive")
    return counted.join(listed, trace).select(trace, "event_count", "events", "last_ts", status.alias("status"))


def last_rows(rows: DataFrame, n: int, trace: str = "trace_id", time: str = "ts") -> DataFrame:
    """The newest n rows of each trace."""
    w = W.partitionBy(trace).orderBy(F.col(time).desc(), F.col("event_id").desc())
    return rows.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def lifecycle_violations(rows: DataFrame, opens: str, closes: str, trace: str = "trace_id", time: str = "ts") -> DataFrame:
    """Closing events of a trace that no opening one precedes, and opening ones while one is open."""
    w = W.partitionBy(trace).orderBy(time, "event_id")
    own = rows.where(F.col("event").isin(opens, closes))
    before = F.lag("event").over(w)
    reason = F.when((F.col("event") == closes) & (before.isNull() | (before == closes)), "not_open").when((F.col("event") == opens) & (before == opens), "open_already")
    return own.withColumn("reason", reason).where("reason is not null").select(trace, "event_id", "event", "reason")


def usage(rows: DataFrame) -> DataFrame:
    """Usage by event: calls, sums, and how many had none told."""
    return rows.groupBy("event").agg(F.count("*").alias("calls"), F.sum(F.col("k")).alias("tokens"), F.round(F.sum("value"), 4).alias("seconds"), F.count_if(F.col("k").isNull()).alias("unknown"))


def replayed(events: DataFrame) -> DataFrame:
    """Events that came again: the same input is a replay, another input under the same id an error."""
    return events.groupBy("scope", "event_id").agg(F.count("*").alias("copies"), F.min("query").alias("lo"), F.max("query").alias("hi")).where("copies > 1").select("scope", "event_id", "copies", F.when(F.col("lo") == F.col("hi"), "replay").otherwise("conflict").alias("kind"))
