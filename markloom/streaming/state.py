"""Structured Streaming forms of the stateful operators; the batch forms in operators/ are their oracles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from markloom.functions.text import lazy_decay
from markloom.operators.conversation import ROUND_LIMIT
from markloom.operators.dynamics import DECAY, ETA
from markloom.sources.files import snapshots


def watch_files(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """New files below root as versions, as they appear."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)
    return snapshots(files)


def gate_bots(messages: DataFrame, limit: int = ROUND_LIMIT) -> DataFrame:
    """messages(scope, seq, message_id, author_id, author_is_bot): the gate's decisions, state by scope."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rounds = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(parts)).sort_values("seq")
        out = []
        for r in rows.itertuples(index=False):
            n = None
            if r.author_is_bot:
                n = rounds[r.author_id] = min(limit + 1, rounds.get(r.author_id, 0) + 1)
            else:
                rounds.clear()
            out.append((key[0], r.seq, r.message_id, n if n is None else int(n), n is None or n <= limit))
        state.update((list(rounds), list(rounds.values())))
        yield pd.DataFrame(out, columns=["scope", "seq", "message_id", "round", "allowed"])

    once = messages.dropDuplicates(["message_id"])
    return once.groupBy("scope").applyInPandasWithState(step, "scope string, seq long, message_id string, round int, allowed boolean", "authors array<string>, rounds array<int>", "append", GroupStateTimeout.NoTimeout)


def dynamic_weights(changes: DataFrame) -> DataFrame:
    """changes(scope, a, b, number): reinforcements of edges at event numbers; each edge's weight after its latest.

    An edge's weight decays by the events between, so its state is its weight and the number of its last event."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        weight, at = state.get if state.exists else (None, 0)
        for n in sorted(int(x) for p in parts for x in p.number):
            weight = round((0.0 if weight is None else lazy_decay(weight, n - at, DECAY)) + ETA, 6)
            at = n
        state.update((weight, at))
        yield pd.DataFrame([(*key, weight, at)], columns=["scope", "a", "b", "weight", "at"])

    return changes.groupBy("scope", "a", "b").applyInPandasWithState(step, "scope string, a string, b string, weight double, at long", "weight double, at long", "update", GroupStateTimeout.NoTimeout)


def recent_traces(log: DataFrame, retention: str = "24 hours", window: str = "1 hour") -> DataFrame:
    """Counts of events by hour and kind; state older than the retention is dropped by the watermark."""
    return log.withWatermark("ts", retention).groupBy(F.window("ts", window), "event").agg(F.count("*").alias("events"))


def version_states(changes: DataFrame) -> DataFrame:
    """changes(source_id, at, status): the latest status of each version; failed and superseded ones are final."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (now,) = state.get if state.exists else ("pending",)
        for r in pd.concat(list(parts)).sort_values("at").itertuples(index=False):
            if now not in ("failed", "superseded"):
                now = r.status
        state.update((now,))
        yield pd.DataFrame([(key[0], now)], columns=["source_id", "status"])

    return changes.groupBy("source_id").applyInPandasWithState(step, "source_id string, status string", "status string", "update", GroupStateTimeout.NoTimeout)
