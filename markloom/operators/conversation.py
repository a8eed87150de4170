"""Conversation rules: turns, what to compact, who may speak, checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from markloom.operators import ranges

ROUND_LIMIT = 5
WATERMARK = 0.7


def turn_groups(messages: DataFrame, conversation: str = "conv_id", order: str = "seq", turn: str = "turn_id") -> DataFrame:
    """messages with `group_no`: consecutive rows of one turn form a group."""
    w = W.partitionBy(conversation).orderBy(order)
    new = F.coalesce((F.lag(turn).over(w) != F.col(turn)).cast("int"), F.lit(1))
    return messages.withColumn("_new", new).withColumn("group_no", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def history_cost():
    """Bytes of a message in the history, and 64 for its row."""
    return F.octet_length("content") + 64


def compaction_prefix(messages: DataFrame, capacity: int, watermark: float = WATERMARK, conversation: str = "conv_id") -> DataFrame:
    """Per conversation over capacity: the oldest groups whose removal brings it to the watermark."""
    groups = turn_groups(messages).groupBy(conversation, "group_no").agg(F.sum(history_cost()).alias("cost"), F.count("*").alias("rows"))
    w = W.partitionBy(conversation)
    total = F.sum("cost").over(w)
    before = F.coalesce(F.sum("cost").over(w.orderBy("group_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return groups.withColumn("total", total).withColumn("left_before", total - before).where((F.col("total") > capacity) & (F.col("left_before") > int(capacity * watermark))).select(conversation, "group_no", "rows", "cost", "left_before")


def bot_gate(messages: DataFrame, limit: int = ROUND_LIMIT) -> DataFrame:
    """messages(scope, seq, message_id, author_id, author_is_bot) with the gate's decision.

    A repeated message id is a duplicate; people always pass and reset their scope; a bot has `limit` rounds
    between two people's messages."""
    first = W.partitionBy("message_id").orderBy("scope", "seq")
    seen = messages.withColumn("copy", F.row_number().over(first))
    counts = lambda own: F.when(own & (F.col("copy") == 1), 1).otherwise(0)
    epochs = ranges.running(seen, ["scope"], ["seq", "message_id"], epoch=counts(~F.col("author_is_bot")))
    counted = ranges.running(epochs, ["scope", "epoch", "author_id"], ["seq", "message_id"], rounds=counts(F.col("author_is_bot")))
    judged = counted.withColumn("round", F.when(F.col("author_is_bot"), F.col("rounds")))
    reason = F.when(F.col("copy") > 1, "duplicate").when(F.col("author_is_bot") & (F.col("round") > limit), "round_limit")
    return judged.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull()).select("scope", "seq", "message_id", "author_id", "author_is_bot", "round", "reason", "allowed")


def contiguous_checkpoint(checkpoints: DataFrame, messages: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """checkpoints(conv_id, through_seq) that cover an unbroken prefix of their conversation's rows."""
    covered = messages.join(checkpoints, conversation).where("seq <= through_seq").groupBy(conversation, "through_seq").agg(F.count("*").alias("rows"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    return covered.withColumn("contiguous", (F.col("lo") == 0) & (F.col("hi") == F.col("through_seq")) & (F.col("rows") == F.col("hi") + 1))


def deduplicated_turns(messages: DataFrame) -> DataFrame:
    """The first row of each message id, by seq."""
    return messages.withColumn("_rn", F.row_number().over(W.partitionBy("message_id").orderBy("seq"))).where("_rn = 1").drop("_rn")


def with_previous_user_message(messages: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """User messages with the user's message before, which follow-up questions lean on."""
    users = messages.where("role = 'user'")
    return users.withColumn("context", F.lag("content").over(W.partitionBy(conversation).orderBy("seq")))
