"""The co-occurrence graph of marks: frequencies, support, NPMI edges, and the indexes derived from them.

Input everywhere: marks(scope, record_id, mark[, source_id]), one row for each mark of an active record,
and the number of active records of each scope. What belongs to a pair without a bound (the records that
show it, the marks beside it) stays in long tables instead of arrays, so that a frequent pair is no large row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from markloom.functions import text as T
from markloom.sources.files import saved

#: So many pairs that are asked for are sent to every task, as a hash of 8 bytes each.
MAX_SENT = 1_000_000


def record_counts(records: DataFrame) -> DataFrame:
    """(scope, n): active records, those without marks too."""
    return records.groupBy("scope").agg(F.count("*").alias("n"))


def mark_frequency(marks: DataFrame) -> DataFrame:
    return marks.groupBy("scope", "mark").agg(F.count("*").alias("frequency"))


def _sets(marks: DataFrame) -> DataFrame:
    """One row for each record, its marks sorted: a record has few (8 by rule), so pairs come from the array without a self-join."""
    return marks.groupBy("scope", "record_id").agg(F.array_sort(F.collect_set("mark")).alias("m"))


def pairs(marks: DataFrame) -> DataFrame:
    """(scope, record_id, a, b, m): every pair a < b of a record."""
    return pairs_of(_sets(marks))


def pairs_of(sets: DataFrame, *more: str) -> DataFrame:
    """pairs of sets(scope, record_id, m), m sorted and without repeats, and `more` of its columns."""
    first = sets.select("scope", "record_id", *more, "m", F.posexplode("m").alias("i", "a"))
    return first.select("scope", "record_id", *more, "a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b"), "m")


def pair_support(marks: DataFrame) -> DataFrame:
    return supported(pairs(marks))


def supported(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("scope", "a", "b").agg(F.count("*").alias("co_count"), F.min("record_id").alias("first_record"), F.max("record_id").alias("last_record"))


def pair_evidence(marks: DataFrame) -> DataFrame:
    return pairs(marks).select("scope", "a", "b", "record_id")


def pair_context(marks: DataFrame) -> DataFrame:
    """(scope, a, b, mark): the other marks of the records that show the pair.

    Three marks of a record are three rows here, so they meet as one: a third of the rows is compared."""
    first = pairs(marks).select("scope", "a", "b", F.explode(F.expr("filter(m, x -> x > b)")).alias("c")).distinct()
    turns = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.col(z).alias("mark")) for x, y, z in ("abc", "acb", "bca")])
    return first.select("scope", F.explode(turns).alias("t")).select("scope", "t.a", "t.b", "t.mark")


def records_of(marks: DataFrame, asked: DataFrame) -> DataFrame:
    """(scope, a, b, record_id, m): the records that show the pairs asked(scope, a, b), a < b, with all their marks.

    Pairs of all records meet those asked for by a hash of theirs alone, without texts; what met by chance is put out after. The hashes
    are sent to the records if they are few. Pairs of records never are: they look to Spark as small as the records' written marks."""
    return _met(marks, saved(asked.select("scope", "a", "b").distinct(), "asked-pairs"))


def _met(marks: DataFrame, asked: DataFrame, most: int = MAX_SENT) -> DataFrame:
    pair, key = ["scope", "a", "b"], F.xxhash64("scope", "a", "b").alias("key")
    sets = saved(_sets(marks), "sets")
    if asked.count() <= most:
        found = pairs_of(sets).select("*", key).join(F.broadcast(asked.select(key).distinct()), "key", "left_semi")
        return found.join(asked.hint("merge"), pair, "left_semi").select(*pair, "record_id", "m")
    slim = pairs_of(sets).select("record_id", key)
    met = slim.join(asked.select(*pair, key).hint("merge"), "key").drop("key")
    return met.join(sets.hint("merge"), ["scope", "record_id"]).where(F.array_contains("m", F.col("a")) & F.array_contains("m", F.col("b"))).select(*pair, "record_id", "m")


def context_of(marks: DataFrame, asked: DataFrame) -> DataFrame:
    """pair_context of the pairs asked(scope, a, b) alone."""
    return records_of(marks, asked).select("scope", "a", "b", F.explode(F.array_except("m", F.array("a", "b"))).alias("mark")).distinct()


def weighed(support: DataFrame, f: DataFrame, n: DataFrame) -> DataFrame:
    """Pairs of positive NPMI with their weight, rounded to 4 places after the test; support's other columns stay."""
    fa, fb = f.select("scope", F.col("mark").alias("a"), F.col("frequency").alias("fa")), f.select("scope", F.col("mark").alias("b"), F.col("frequency").alias("fb"))
    scored = support.join(fa, ["scope", "a"]).join(fb, ["scope", "b"]).join(n, "scope").withColumn("raw", T.npmi(F.col("co_count"), F.col("fa"), F.col("fb"), F.col("n")))
    return scored.where("raw > 0").withColumn("weight", F.round("raw", 4)).drop("raw", "fa", "fb", "n")


def npmi_edges(marks: DataFrame, counts: DataFrame) -> DataFrame:
    """Pairs of positive NPMI: (scope, a, b, co_count, weight).

    Marks bring their frequencies into their records, so that pairs, of which there are many more, are grouped once and joined with none."""
    known = marks.select("scope", "record_id", "mark").join(mark_frequency(marks), ["scope", "mark"])
    first = known.groupBy("scope", "record_id").agg(F.array_sort(F.collect_set(F.struct("mark", "frequency"))).alias("m")).select("scope", "m", F.posexplode("m").alias("i", "x"))
    both = first.select("scope", "x", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("y")).select("scope", F.col("x.mark").alias("a"), F.col("y.mark").alias("b"), F.col("x.frequency").alias("fa"), F.col("y.frequency").alias("fb"))
    met = both.groupBy("scope", "a", "b").agg(F.count("*").alias("co_count"), F.max("fa").alias("fa"), F.max("fb").alias("fb")).join(counts, "scope")
    raw = met.withColumn("raw", T.npmi(F.col("co_count"), F.col("fa"), F.col("fb"), F.col("n"))).where("raw > 0")
    return raw.select("scope", "a", "b", "co_count", F.round("raw", 4).alias("weight"))


def scope_meta(counts: DataFrame, marks: DataFrame, edges: DataFrame) -> DataFrame:
    live = counts.withColumnRenamed("n", "active_records")
    known = mark_frequency(marks).groupBy("scope").agg(F.count("*").alias("known_marks"))
    positive = edges.where("weight > 0").groupBy("scope").agg(F.count("*").alias("live_edges"))
    return live.join(known, "scope", "left").join(positive, "scope", "left").na.fill(0)


def directed_edges(edges: DataFrame) -> DataFrame:
    """Each positive edge from both ends, neighbours ranked by weight."""
    order = W.partitionBy("scope", "mark").orderBy(F.col("weight").desc(), "neighbor")
    return _both_ways(edges).withColumn("neighbor_order", F.row_number().over(order))


def _both_ways(edges: DataFrame) -> DataFrame:
    live = edges.where("weight > 0")
    both = live.select("scope", F.col("a").alias("mark"), F.col("b").alias("neighbor"), "a", "b", "weight", "co_count", F.lit(True).alias("primary_edge"))
    return both.unionByName(live.select("scope", F.col("b").alias("mark"), F.col("a").alias("neighbor"), "a", "b", "weight", "co_count", F.lit(False).alias("primary_edge")))


def nearest_edges(edges: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """The first `limit` rows of directed_edges of each mark in asked(scope, mark)."""
    order = W.partitionBy("scope", "mark").orderBy(F.col("weight").desc(), "neighbor")
    near = _both_ways(edges).join(asked.select("scope", "mark").distinct(), ["scope", "mark"], "left_semi")
    return near.withColumn("neighbor_order", F.row_number().over(order)).where(F.col("neighbor_order") <= limit)


def mark_dictionary(marks: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """(label, id): ids are kept from an earlier dictionary; new labels get the next ones in their order.

    Labels are dealt by ranges, numbered within each range, and offset by what the ranges before it hold: one row a
    range is all that meets in one place."""
    labels = marks.select(F.col("mark").alias("label")).distinct()
    base = 0
    if earlier is not None:
        labels = labels.join(earlier, "label", "left_anti")
        base = earlier.agg(F.max("id")).head()[0] or 0
    in_part = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    numbered = saved(labels.repartitionByRange("label").sortWithinPartitions("label").select("label", F.spark_partition_id().alias("part"), in_part.alias("k")), "labels")
    offsets = numbered.groupBy("part").agg(F.count("*").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    fresh = numbered.join(F.broadcast(offsets), "part").select("label", (F.col("k") + F.col("before") + 1 + base).alias("id"))
    return fresh if earlier is None else earlier.select("label", "id").unionByName(fresh)


def prefix_trie(marks: DataFrame) -> DataFrame:
    """(scope, prefix, below, terminal): how many marks have the prefix, and whether it is one."""
    known = marks.select("scope", "mark").distinct()
    nodes = known.select("scope", "mark", F.explode(F.sequence(F.lit(1), F.length("mark"))).alias("k"))
    return nodes.groupBy("scope", F.expr("substring(mark, 1, k)").alias("prefix")).agg(F.count("*").alias("below"), F.max((F.length("mark") == F.col("k")).cast("int")).alias("terminal"))


def concept_edges(marks: DataFrame, members: DataFrame, counts: DataFrame) -> DataFrame:
    """NPMI over merged concepts: a record has a concept if it has one of its members(mark, cid)."""
    merged = marks.join(members, "mark").select("scope", "record_id", F.col("cid").cast("string").alias("mark")).distinct()
    return npmi_edges(merged, counts)


def insert_new(stored: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts that aren't stored: one for each (scope, source_id, fingerprint), never an archived one again."""
    keyed = facts.withColumn("fingerprint", T.fingerprint(F.col("text"), F.col("quote"))).dropDuplicates(["scope", "source_id", "fingerprint"])
    return keyed.join(stored.select("scope", "source_id", "fingerprint"), ["scope", "source_id", "fingerprint"], "left_anti")


def deactivate(stored: DataFrame, sources: DataFrame, at: float) -> DataFrame:
    """stored with the active records of sources(scope, source_id) archived."""
    gone = sources.select("scope", "source_id").distinct().withColumn("gone", F.lit(True))
    off = F.col("gone").isNotNull() & F.col("active")
    return stored.join(gone, ["scope", "source_id"], "left").withColumn("archived_at", F.when(off, F.lit(at)).otherwise(F.col("archived_at"))).withColumn("active", F.col("active") & ~off).drop("gone")
