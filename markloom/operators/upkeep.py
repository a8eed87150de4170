"""Upkeep of a graph from what changed: records that come and records that go are merged as signed partial counts into a new version.

A version keeps what counts need and no record: active records, frequencies, support of pairs, marks beside pairs. A delta reads its own
records only; the earlier version's tables are merged by one grouping each. Which records show a pair, and which marks stand beside it, is
known by two sums of hashes each (128 bits), which add up under deltas as counts do; they decide nothing but `last_updated`.

`last_updated` never goes back: an edge whose weight, support, records or context changed gets the later one of its own time and the
delta's, an edge that stayed keeps its own. An edge that is no longer one stays as inactive with its last values, and if it returns with
just these, its time stays, too.

Defined results: a record among those that come and those that go with the same marks changes nothing; a record without marks counts as
active; archiving a record that the version doesn't have fails the job instead of giving counts below zero.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom.functions import text as T
from markloom.sources.files import saved

_PAIR = ["scope", "a", "b"]
_PRINT = ["e1", "e2", "c1", "c2"]
_HAD = {"had_co_count": "bigint", "weight": "double", **{f"had_{p}": "bigint" for p in _PRINT}, "active": "boolean", "last_updated": "double"}


@dataclass(frozen=True)
class Version:
    """counts(scope, n), frequency(scope, mark, frequency), beside(scope, a, b, c, seen), pairs.

    beside has the marks a < b < c of records. pairs(scope, a, b, co_count, prints) has in the same row what the pair has, or last had, as an
    edge, so that no version joins its edges to the ones before; also pairs that no record shows any more (co_count 0) as long as they
    have prints or were an edge."""

    counts: DataFrame
    frequency: DataFrame
    beside: DataFrame
    pairs: DataFrame

    @property
    def edges(self) -> DataFrame:
        """(scope, a, b, co_count, weight, active, last_updated)."""
        return self.pairs.where("last_updated is not null").select(*_PAIR, F.col("had_co_count").alias("co_count"), "weight", "active", "last_updated")


def signed(come: DataFrame, go: DataFrame) -> DataFrame:
    return come.withColumn("sign", F.lit(1)).unionByName(go.withColumn("sign", F.lit(-1)))


def _whole(total: Column, what: str) -> Column:
    return F.when(total >= 0, total).otherwise(F.raise_error(F.lit(f"{what}: more goes than there is")).cast("bigint"))


def _hash(column: str, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), column)


def _merged(before: DataFrame | None, delta: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Counts of before and delta together, those of zero left out."""
    every = delta if before is None else before.unionByName(delta)
    return every.groupBy(*keys).agg(F.sum(count).alias(count)).withColumn(count, _whole(F.col(count), count)).where(F.col(count) > 0)


def _pairs(sets: DataFrame) -> DataFrame:
    """(scope, record_id, a, b, rest, sign): every pair a < b of a record, and its marks after b."""
    first = sets.select("scope", "record_id", "sign", "m", F.posexplode("m").alias("i", "a")).select("scope", "record_id", "sign", "a", F.expr("slice(m, i + 2, size(m))").alias("after"))
    return first.select("scope", "record_id", "sign", "a", "after", F.posexplode("after").alias("j", "b")).select("scope", "record_id", "a", "b", F.expr("slice(after, j + 2, size(after))").alias("rest"), "sign")


def _beside(before: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """(scope, a, b, c, seen, was): three marks of a record, in how many records now, and before."""
    delta = pairs.select(*_PAIR, F.explode("rest").alias("c"), F.col("sign").cast("bigint").alias("seen"), F.lit(0).cast("bigint").alias("was"))
    every = delta if before is None else delta.unionByName(before.withColumn("was", F.col("seen")))
    sums = every.groupBy(*_PAIR, "c").agg(F.sum("seen").alias("seen"), F.sum("was").alias("was"))
    return sums.withColumn("seen", _whole(F.col("seen"), "context"))


def _merged_pairs(before: DataFrame | None, pairs: DataFrame, beside: DataFrame) -> DataFrame:
    """(scope, a, b, co_count, prints, and what the pair had as an edge) now; before is a version's pairs."""
    zero, come = F.lit(0).cast("bigint"), pairs.select(*_PAIR, F.col("sign").cast("bigint").alias("co_count"))
    if before is None:
        first = come.groupBy(*_PAIR).agg(F.sum("co_count").alias("co_count")).withColumn("co_count", _whole(F.col("co_count"), "support")).where("co_count > 0")
        return first.select("*", *[zero.alias(p) for p in _PRINT], *[F.lit(None).cast(t).alias(c) for c, t in _HAD.items()])
    shown = pairs.select(*_PAIR, F.col("sign").cast("bigint").alias("co_count"), *[_hash("record_id", k).alias(f"e{k}") for k in (1, 2)], zero.alias("c1"), zero.alias("c2"))
    turns = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.col(z).alias("mark")) for x, y, z in ("abc", "acb", "bca")])
    crossed = beside.where((F.col("seen") > 0) != (F.col("was") > 0)).select("scope", F.explode(turns).alias("t")).select("scope", "t.a", "t.b", zero.alias("co_count"), zero.alias("e1"), zero.alias("e2"), *[_hash("t.mark", k).alias(f"c{k}") for k in (1, 2)])
    every = shown.unionByName(crossed).unionByName(before, allowMissingColumns=True)
    # a pair has one row before at most, whose edge is the only one in its group
    sums = every.groupBy(*_PAIR).agg(F.sum("co_count").alias("co_count"), *[F.bit_xor(p).alias(p) for p in _PRINT], *[F.max(c).alias(c) for c in _HAD])
    return sums.withColumn("co_count", _whole(F.col("co_count"), "support"))


def _judged(pairs: DataFrame, frequency: DataFrame, counts: DataFrame, at: float) -> DataFrame:
    """pairs with what each has as an edge after this version; those without records, prints and edge are left out."""
    f = lambda end: frequency.select("scope", F.col("mark").alias(end), F.col("frequency").alias(f"f{end}"))
    met = pairs.join(f("a"), ["scope", "a"], "left").join(f("b"), ["scope", "b"], "left").join(counts, "scope", "left")
    raw = F.when(F.col("co_count") > 0, T.npmi(F.col("co_count"), F.col("fa"), F.col("fb"), F.col("n")))
    met = met.withColumn("raw", raw).withColumn("fresh", F.when(F.col("raw") > 0, F.round("raw", 4)))
    now, known, time = F.col("fresh").isNotNull(), F.col("last_updated").isNotNull(), F.lit(float(at))
    new = {"had_co_count": F.col("co_count"), "weight": F.col("fresh"), **{f"had_{p}": F.col(p) for p in _PRINT}}
    same = F.lit(True)
    for c, value in new.items():
        same = same & (F.col(c) == value)
    updated = F.when(now & ~known, time).when(now & ~same, F.greatest(F.col("last_updated"), time)).otherwise(F.col("last_updated"))
    kept = (F.col("co_count") > 0) | now | known
    for p in _PRINT:
        kept = kept | (F.col(p) != 0)
    values = [F.when(now, value).otherwise(F.col(c)).alias(c) for c, value in new.items()]
    return met.where(kept).select(*_PAIR, "co_count", *_PRINT, *values, F.when(now | known, now).alias("active"), updated.alias("last_updated"))


def advanced(version: Version | None, records: DataFrame, marks: DataFrame, at: float) -> Version:
    """The next version after a delta of records(scope, record_id, sign) and marks(scope, record_id, mark, sign), published `at`.

    sign is 1 for what comes and -1 for what goes; a record whose marks change goes with the old and comes with the new ones.
    Without an earlier version it is the full rebuild."""
    v = version
    pairs = _pairs(saved(marks.groupBy("scope", "record_id", "sign").agg(F.array_sort(F.collect_set("mark")).alias("m")), "delta-sets"))
    counts = saved(_merged(v and v.counts, records.select("scope", F.col("sign").cast("bigint").alias("n")), ["scope"], "n"), "counts")
    frequency = saved(_merged(v and v.frequency, marks.select("scope", "mark", F.col("sign").cast("bigint").alias("frequency")), ["scope", "mark"], "frequency"), "frequency")
    beside = saved(_beside(v and v.beside, pairs), "beside")
    merged = saved(_judged(_merged_pairs(v and v.pairs, pairs, beside), frequency, counts, at), "pairs")
    return Version(counts, frequency, beside.where("seen > 0").drop("was"), merged)
