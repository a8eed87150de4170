"""Dynamic weights: seeded once from static edges, decayed by every event, reinforced by pairs of hits.

Each step is rounded to 6 places as Python rounds, which neither engine's round() does at exact halves; so
an edge's events are folded in order in Arrow batches. An edge decays with every event of its scope, so
the fold needs only how many events passed between those that reinforce the edge: what is grouped for an
edge are its own reinforcements, not all events.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.functions.text import lazy_decay
from markloom.operators import ranges

ETA, DECAY = 1.0, 0.99
#: A decay takes up to a thousand steps. Seeds have 4 places and an edge without reinforcement decays by its scope's last number, so a
#: task meets few different decays however many edges it has.
decayed = lru_cache(1 << 17)(lazy_decay)


def numbered_events(events: DataFrame) -> DataFrame:
    """events(scope, event_id, observed_at) with their number in the scope; a repeated event counts once."""
    once = events.dropDuplicates(["scope", "event_id"])
    return ranges.running(once, ["scope"], ["observed_at", "event_id"], number=F.lit(1))


def fold(seed: float | None, numbers: list[int], last: int) -> float:
    """The weight after event `last` of an edge seeded with `seed` (None: made by its first reinforcement) and reinforced at `numbers`."""
    weight, at = seed, 0
    for n in numbers:
        if weight is None:
            weight = 0.0  # a new edge isn't decayed by the event that makes it
        else:
            weight = decayed(weight, n - at, DECAY)
        weight, at = round(weight + ETA, 6), n
    return decayed(weight or 0.0, last - at, DECAY)


def dynamic_weights(static: DataFrame, events: DataFrame, hits: DataFrame) -> DataFrame:
    """(scope, a, b, weight, reinforcements) after all events; hits(scope, event_id, mark) of each event."""
    numbered = numbered_events(events).select("scope", "event_id", "number")
    own = hits.select("scope", "event_id", "mark").distinct()
    pairs = own.withColumnRenamed("mark", "a").join(own.withColumnRenamed("mark", "b"), ["scope", "event_id"]).where("a < b")
    up = pairs.join(numbered, ["scope", "event_id"]).groupBy("scope", "a", "b").agg(F.array_sort(F.collect_list("number")).alias("numbers"))
    last = numbered.groupBy("scope").agg(F.max("number").alias("last"))
    seeds = static.select("scope", "a", "b", F.col("weight").alias("seed"))
    every = seeds.join(up, ["scope", "a", "b"], "full_outer").join(last, "scope")

    @F.pandas_udf("double")
    def folded(seed: pd.Series, numbers: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([fold(None if s != s or s is None else s, [] if n is None else list(map(int, n)), int(x)) for s, n, x in zip(seed, numbers, last, strict=True)])

    return every.select("scope", "a", "b", folded("seed", "numbers", "last").alias("weight"), F.coalesce(F.size("numbers"), F.lit(0)).alias("reinforcements"))


def unseeded(static: DataFrame, dynamic: DataFrame) -> DataFrame:
    """Static edges that have no dynamic row yet."""
    return static.join(dynamic.select("scope", "a", "b"), ["scope", "a", "b"], "left_anti")
