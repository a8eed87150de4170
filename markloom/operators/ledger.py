"""Reservation ledgers: what is spent, what is pending, what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def budget_state(calls: DataFrame, ceilings: DataFrame, key: str = "session_id") -> DataFrame:
    """calls(session_id, status, reserved, cost), ceilings(session_id, ceiling): settled calls count with their cost,
    open ones with what they reserved; the state halts where nothing is left."""
    spent = calls.groupBy(key).agg(F.sum(F.when(F.col("status") == "settled", F.col("cost")).otherwise(F.lit(0))).alias("spent"), F.sum(F.when(F.col("status") != "settled", F.col("reserved")).otherwise(F.lit(0))).alias("pending"), F.count_if(F.col("status") != "settled").alias("open_calls"))
    left = ceilings.join(spent, key, "left").na.fill(0, ["spent", "pending", "open_calls"])
    return left.withColumn("remaining", F.col("ceiling") - F.col("spent") - F.col("pending")).withColumn("halted", F.col("remaining") <= 0)


def ledger_violations(calls: DataFrame) -> DataFrame:
    """Settled calls that cost more than they reserved."""
    return calls.where((F.col("status") == "settled") & (F.col("cost") > F.col("reserved")))
