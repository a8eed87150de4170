"""Edges of frozen retrieval rounds: which of them the round's own texts bear out, and the graph that these make over all rounds.

An edge is borne out in a round by a record that was frozen in the same round, bears both marks, isn't a bibliography or a
publication's notice, and literally has both marks in its text. A weight alone never qualifies an edge, and a text of a later round
doesn't either. Texts are judged once each, before they meet the edges; what comes together by edge are counts and a handful of reasons.

Defined results: a frozen record without text has none of its marks; repeated support rows count each; support without any frozen
record leaves its edge unqualified, with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom.functions import rules
from markloom.functions import text as T

NOT_FROZEN, NONE_QUALIFIES = "not_frozen_in_round", "no_qualified_support"


REASONS = (NOT_FROZEN, "marks_conflict", "bibliography_or_metadata", "endpoint_absent")


def _judged(frozen: DataFrame) -> DataFrame:
    """frozen without texts: whether a record is unfit, and which of its marks literally stand in its text, in lower case."""
    text = F.coalesce("text", F.lit(""))
    unfit = T.stands(text, f"(?imd){rules.REFERENCE_HEADING}") | (T.metadata_kind(text) != rules.OTHER_KIND)
    return frozen.select("scope", "round", "record_id", "marks", unfit.alias("unfit"), T.standing(F.col("marks"), text).alias("there"))


def _reason() -> Column:
    """Why a record doesn't bear an edge out; `there` is null for one that isn't frozen."""
    a, b = F.col("a"), F.col("b")
    marked = F.array_contains("marks", a) & F.array_contains("marks", b)
    there = F.array_contains("there", F.lower(a)) & F.array_contains("there", F.lower(b))
    return F.when(F.col("there").isNull(), REASONS[0]).when(~F.coalesce(marked, F.lit(False)), REASONS[1]).when(F.col("unfit"), REASONS[2]).when(~there, REASONS[3])


def judged_support(support: DataFrame, frozen: DataFrame) -> DataFrame:
    """support(scope, round, a, b, record_id) with the reason why a record doesn't bear its edge out, null if it does; frozen(scope, round, record_id, marks, text)."""
    met = support.join(_judged(frozen), ["scope", "round", "record_id"], "left")
    return met.select("scope", "round", "a", "b", "record_id", _reason().alias("reason"))


def judged_records(sets: DataFrame, frozen: DataFrame) -> DataFrame:
    """judged_support of every pair a < b of m, for sets(scope, round, record_id, m): a record meets its text's judgement once, then its pairs come."""
    met = sets.join(_judged(frozen), ["scope", "round", "record_id"], "left")
    first = met.select("*", F.posexplode(F.array_sort("m")).alias("i", "a")).withColumn("m", F.array_sort("m"))
    pairs = first.select("scope", "round", "record_id", "marks", "unfit", "there", "a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b"))
    return pairs.select("scope", "round", "a", "b", "record_id", _reason().alias("reason"))


def qualified_edges(judged: DataFrame) -> DataFrame:
    """(scope, round, a, b): how many records support an edge, bear it out, or weren't frozen in the round, and all reasons met."""
    met = [F.count_if(F.col("reason") == r).alias(f"n{k}") for k, r in enumerate(REASONS)]
    sums = judged.groupBy("scope", "round", "a", "b").agg(F.count("*").alias("support"), F.count_if(F.col("reason").isNull()).alias("bindings"), *met)
    reasons = F.array_compact(F.array(*[F.when(F.col(f"n{k}") > 0, r) for k, r in enumerate(REASONS)], F.when(F.col("bindings") == 0, NONE_QUALIFIES)))
    return sums.select("scope", "round", "a", "b", "support", "bindings", F.col("n0").alias("unresolved"), (F.col("bindings") > 0).alias("qualified"), F.array_join(F.array_sort(reasons), ",").alias("reasons"))


def union_graph(qualified: DataFrame) -> DataFrame:
    """(scope, a, b): the edges that any round bears out, with their rounds and bindings."""
    return qualified.where("qualified").groupBy("scope", "a", "b").agg(F.count("*").alias("rounds"), F.min("round").alias("first_round"), F.sum("bindings").alias("bindings"))
