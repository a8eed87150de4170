"""Maintenance batches: blocks of several documents, worked in order under caps for a call, a document and a batch at once.

The first blocks of each document (the pilot) come before all others. A block runs if its reservation keeps to the call's caps and, with
what ran or runs before it, to its document's and its batch's caps; the first that doesn't stops its batch, and nothing after it starts.
As nothing is skipped, what is used before a block is a running sum; sums run by ranges, so a batch may be of any size. Blocks that a run
has ended already count by what they used, whatever the caps say now, so that a batch goes on where it was cut off.

Defined results: a block without a reservation, or with one below zero, stops its batch with `unknown_cost`; an ended block of unknown use
counts as its reservation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.operators import ranges

RESOURCES = ["input_tokens", "output_tokens", "seconds"]
#: Blocks of a document's pilot, and the caps.
PILOT = 3
CAPS = {
    "call": {"input_tokens": 4096, "output_tokens": 512, "seconds": 45},
    "document": {"input_tokens": 65536, "output_tokens": 16384, "seconds": 1800},
    "batch": {"input_tokens": 262144, "output_tokens": 65536, "seconds": 7200},
}


def admitted(blocks: DataFrame, caps: dict[str, dict[str, int]] = CAPS, pilot: int = PILOT) -> DataFrame:
    """blocks(batch_id, document_id, block, input_tokens, output_tokens, seconds, ended) with place, state and the reason of a stop.

    ended is null for a block that has not run, else a struct of what it used by resource. state is ended, runs, stops or waits."""
    phase = F.when(F.col("block") < pilot, 0).otherwise(1)
    known = F.lit(True)
    for r in RESOURCES:
        known = known & F.coalesce(F.col(r) >= 0, F.lit(False))
    costs = {r: F.coalesce(F.col(f"ended.{r}"), F.col(r), F.lit(0)) for r in RESOURCES}
    rows = blocks.withColumns({"phase": phase, "known": known})
    order = ["phase", "document_id", "block"]
    by_document = ranges.running(rows, ["batch_id", "document_id"], ["phase", "block"], **{f"document_{r}": c for r, c in costs.items()})
    summed = ranges.running(by_document, ["batch_id"], order, place=F.lit(1), **{f"batch_{r}": c for r, c in costs.items()})
    over = F.when(~F.col("known"), "unknown_cost")
    for level, column in (("call", "{}"), ("document", "document_{}"), ("batch", "batch_{}")):
        for r in RESOURCES:
            over = over.when(F.col(column.format(r)) > caps[level][r], f"{level}_{r}")
    judged = summed.withColumn("over", F.when(F.col("ended").isNull(), over))
    stop = judged.where("over is not null").groupBy(F.col("batch_id").alias("_b")).agg(F.min("place").alias("stop"))
    met = judged.join(stop, F.col("batch_id").eqNullSafe(F.col("_b")), "left").drop("_b")
    state = F.when(F.col("ended").isNotNull(), "ended").when(F.col("stop").isNull() | (F.col("place") < F.col("stop")), "runs").when(F.col("place") == F.col("stop"), "stops").otherwise("waits")
    return met.withColumn("state", state).select("batch_id", "document_id", "block", "place", "state", F.when(F.col("state") == "stops", F.col("over")).alias("reason"), *[f"document_{r}" for r in RESOURCES], *[f"batch_{r}" for r in RESOURCES])


def batch_states(judged: DataFrame) -> DataFrame:
    """(batch_id, ended, runs, waits, status, reason): whether each batch comes to its end, and what stops it."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    sums = judged.groupBy("batch_id").agg(n("ended"), n("runs"), n("waits"), F.max("reason").alias("reason"))
    return sums.withColumn("status", F.when(F.col("reason").isNotNull(), "stopped").otherwise("whole"))
