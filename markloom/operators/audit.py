"""Checks that recompute what was stored, reasons for what was chosen, and the small joins and listings of an audit.

A check returns its violations as rows: none means valid. What is compared is joined on its key; nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from markloom.operators.dynamics import DECAY, ETA, numbered_events


def graph_violations(computed: DataFrame, stored: DataFrame, support: DataFrame) -> DataFrame:
    """(scope, a, b, kind): stored edges(scope, a, b, weight) against those computed anew from active records."""
    key = ["scope", "a", "b"]
    c, s = computed.select(*key, F.col("weight").alias("right")), stored.select(*key, "weight", F.lit(True).alias("held"))
    both = c.join(s, key, "full_outer").join(support.select(*key, F.lit(True).alias("supported")), key, "left")
    kind = F.when(F.col("a") >= F.col("b"), "wrong_order").when(F.col("held").isNull(), "missing").when(F.col("supported").isNull(), "unsupported").when(F.col("right").isNull(), "not_positive").when(F.abs(F.col("right") - F.col("weight")) > 1e-9, "wrong_weight")
    return both.select(*key, kind.alias("kind")).where("kind is not null")


def invalid(rows: DataFrame, texts: list[str], numbers: list[str]) -> DataFrame:
    """rows with the columns among them that aren't usable: blank or missing texts, numbers that aren't finite."""
    blank = [F.when(F.col(c).isNull() | (F.trim(c) == ""), F.lit(f"{c}:blank")) for c in texts]
    odd = [F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(f"{c}:not_finite")) for c in numbers]
    return rows.withColumn("problems", F.array_join(F.filter(F.array(*blank, *odd), lambda x: x.isNotNull()), ",")).where("problems <> ''")


def decided(ranked: DataFrame, limit: int = 3) -> DataFrame:
    """ranked(query_id, record_id, direct, score[, rank]) with rank, and selected or the reason why not."""
    order = W.partitionBy("query_id").orderBy(F.col("direct").desc(), F.col("score").desc(), F.col("record_id").desc())
    reason = F.when(F.col("rank") <= limit, F.lit(None).cast("string")).when(F.col("direct") == 0, "no_direct_mark").otherwise("beyond_limit")
    placed = ranked if "rank" in ranked.columns else ranked.withColumn("rank", F.row_number().over(order))
    return placed.withColumn("reason", reason).withColumn("selected", F.col("reason").isNull())


def partition_violations(candidates: DataFrame, selected: DataFrame, excluded: DataFrame, key: list[str]) -> DataFrame:
    """(key, kind): selected and excluded must be disjoint and together all candidates."""
    flag = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    every = flag(candidates, "c").join(flag(selected, "s"), key, "full_outer").join(flag(excluded, "e"), key, "full_outer")
    kind = F.when(F.col("c").isNull(), "unknown").when(F.col("s") & F.col("e"), "both").when(F.col("s").isNull() & F.col("e").isNull(), "neither")
    return every.select(*key, kind.alias("kind")).where("kind is not null")


def transitions(static: DataFrame, dynamic: DataFrame, event_hits: DataFrame, support: DataFrame) -> DataFrame:
    """What one event a scope does to its edges: dynamic(scope, a, b, weight) before it, event_hits(scope, mark) of it.

    Every edge decays; pairs of hits are reinforced, and made if they are new."""
    key = ["scope", "a", "b"]
    hit = event_hits.select("scope", "mark").distinct()
    pairs = hit.withColumnRenamed("mark", "a").join(hit.withColumnRenamed("mark", "b"), "scope").where("a < b").withColumn("reinforced", F.lit(True))
    scopes = hit.select("scope").distinct()
    before = dynamic.join(scopes, "scope", "left_semi").select(*key, F.col("weight").alias("before_weight"))
    both = before.join(pairs, key, "full_outer").join(support.select(*key, "co_count"), key, "left").join(static.select(*key, F.col("weight").alias("static_score")), key, "left")
    decayed = F.round(F.col("before_weight") * DECAY, 6)
    added = F.when(F.col("reinforced"), F.lit(ETA)).otherwise(0.0)
    return both.select(
        *key, F.when(F.col("before_weight").isNull(), "direct_reinforcement").alias("created_by"), "before_weight", decayed.alias("after_decay"), added.alias("reinforcement_added"),
        F.round(F.coalesce(decayed, F.lit(0.0)) + added, 6).alias("after_weight"), F.col("co_count").isNotNull().alias("active_source_support"), F.coalesce("co_count", F.lit(0)).alias("co_count"), F.coalesce("static_score", F.lit(0.0)).alias("static_score"),
    )


def first_events(events: DataFrame) -> DataFrame:
    return numbered_events(events).where("number = 1").select("scope", "event_id")


def frozen(selected: DataFrame, versions: DataFrame) -> DataFrame:
    """References bound to their source's version, with a citation and a digest of what was bound."""
    bound = selected.join(versions.select("scope", "source_id", "digest"), ["scope", "source_id"])
    said = F.concat_ws("|", "scope", "source_id", "digest", F.col("record_id").cast("string"), "text")
    return bound.withColumn("citation", F.concat(F.lit("M"), F.col("rank").cast("string"))).withColumn("bound", F.sha2(said, 256))


def retrieval_violations(rows: DataFrame, records: DataFrame, versions: DataFrame) -> DataFrame:
    """(query_id, rank, kind): frozen references against the records and versions of today."""
    now = rows.join(records.select("scope", "record_id", F.col("text").alias("full")), ["scope", "record_id"], "left").join(versions.select("scope", "source_id", F.col("digest").alias("digest_now")), ["scope", "source_id"], "left")
    body = F.when(F.col("truncated"), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    said = F.concat_ws("|", "scope", "source_id", "digest", F.col("record_id").cast("string"), "text")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    kind = F.when(F.col("full").isNull(), "record_gone").when(~F.col("full").startswith(body), "text_differs").when(~F.col("digest").eqNullSafe(F.col("digest_now")), "version_changed").when(F.sha2(said, 256) != F.col("bound"), "digest_differs").when(F.col("rank") != F.col("place"), "rank_gap")
    return now.withColumn("place", place).select("query_id", "rank", kind.alias("kind")).where("kind is not null")


def counter_mismatches(counted: DataFrame, receipt: DataFrame, key: str = "scope") -> DataFrame:
    """(key, stage, counted, told) where a receipt's counters(key, stage, told) aren't what was counted(key, stage, counted)."""
    return counted.join(receipt, [key, "stage"], "full_outer").where(~F.col("counted").eqNullSafe(F.col("told"))).select(key, "stage", "counted", "told")


def bucket_digests(rows: DataFrame, group: str, number: str, body: Column, width: int = 1000) -> DataFrame:
    """A digest for each run of `width` numbers of a group: unchanged rows keep theirs. No digest covers an unbounded list."""
    held = rows.select(group, F.floor(F.col(number) / width).alias("bucket"), number, F.sha2(body, 256).alias("own"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number, "own"))), lambda s: s["own"]), "")
    return held.groupBy(group, "bucket").agg(F.count("*").alias("rows"), F.sha2(ordered, 256).alias("digest"))


def page_with_total(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """A page of rows in a total order, with the number of all rows and the next page's offset (null at the end)."""
    total = rows.agg(F.count("*").alias("total"))
    next_offset = F.when(F.col("total") > offset + limit, F.lit(offset + limit).cast("bigint"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total), F.col("total") >= 0).withColumn("next_offset", next_offset)


def newest(rows: DataFrame, newest_rows: int, matching: Column, limit: int, order: list[Column]) -> DataFrame:
    """Of the newest rows those that match, `limit` at most."""
    return rows.orderBy(*order).limit(newest_rows).where(matching).orderBy(*order).limit(limit)


def best_batch(documents: DataFrame, batches: DataFrame, key: list[str]) -> DataFrame:
    """Each document with one batch of its key: one of its own source first, then the latest."""
    both = documents.join(batches.withColumnRenamed("source_id", "batch_source"), key)
    order = W.partitionBy(*key, "source_id").orderBy((F.col("batch_source") == F.col("source_id")).desc(), F.col("batch_id").desc())
    return both.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def latest_by_json(events: DataFrame, path: str, rows: DataFrame, key: str) -> DataFrame:
    """rows(key) with the latest event(seq, body) whose JSON has the key at `path`."""
    told = events.select(F.get_json_object("body", path).alias("told"), "seq").where("told is not null").groupBy("told").agg(F.max("seq").alias("seq"))
    return rows.join(told, F.col(key).cast("string") == F.col("told")).drop("told")


def resolved_seeds(seeds: DataFrame, members: DataFrame) -> DataFrame:
    """seeds(case_id, mark) with their concept from members(mark, cid); a seed without one is an error of its case."""
    return seeds.join(members, "mark", "left").withColumn("error", F.when(F.col("cid").isNull(), "unknown_seed"))


def shown_and_omitted(rows: DataFrame, key: str, order: list[Column], item: str, limit: int) -> DataFrame:
    """Per key the first `limit` items and how many are left out."""
    ranked = rows.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    totals = rows.groupBy(key).agg(F.count("*").alias("n"))
    few = ranked.where(F.col("rn") <= limit).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col(item).alias("x")))), lambda s: s["x"]), ",").alias("shown"))
    return few.join(totals, key).select(key, "shown", F.greatest(F.col("n") - limit, F.lit(0)).alias("omitted"))


def unique_bindings(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """candidates(candidate_id, source_id, digest, places) bound to the one record of the same source, digest and set of places."""
    norm = lambda df: df.withColumn("places", F.sort_array(F.array_distinct("places")))
    met = norm(candidates).join(norm(records).select("record_id", "source_id", "digest", "places"), ["source_id", "digest", "places"])
    return met.groupBy("candidate_id").agg(F.count("*").alias("n"), F.min("record_id").alias("record_id")).where("n = 1").select("candidate_id", "record_id")


def utc_time(text: Column) -> Column:
    """A time in UTC, written as such; null for any other form or zone."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?(Z|\+00:00)$"), F.to_timestamp(F.regexp_replace(text, r"(Z|\+00:00)$", "Z")))


def guarded(value: Column, size: int) -> Column:
    """value, if it isn't longer than `size` characters."""
    return F.when(F.length(value) <= size, value)


def concept_violations(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, key): what breaks a graph of concepts(cid, members, frequency) and edges(a, b, co_count, npmi)."""
    cid = F.col("cid").cast("string")
    bad = F.filter(
        F.array(
            F.when((F.size("members") == 0) | F.exists("members", lambda m: m < 1), "members_not_positive"),
            F.when(F.col("members") != F.array_sort(F.array_distinct("members")), "members_not_sorted"),
            F.when(F.array_min("members") != F.col("cid"), "cid_not_least_member"),
        ),
        lambda x: x.isNotNull(),
    )
    own = concepts.select(F.explode(bad).alias("kind"), cid.alias("key"))
    shared = concepts.select("cid", F.explode("members").alias("member")).groupBy("member").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo <> hi").select(F.lit("member_shared").alias("kind"), F.col("member").cast("string").alias("key"))
    end = lambda k: concepts.select(F.col("cid").alias(k), F.col("frequency").alias(f"frequency_{k}"))
    met = edges.join(end("a"), "a", "left").join(end("b"), "b", "left")
    unknown = F.col("frequency_a").isNull() | F.col("frequency_b").isNull()
    kind = F.when(unknown, "unknown_endpoint").when(F.col("a") >= F.col("b"), "wrong_order").when(F.isnan("npmi") | (F.col("npmi") <= 0) | (F.col("npmi") > 1), "npmi_out_of_range").when(F.col("co_count") > F.least("frequency_a", "frequency_b"), "co_count_too_large")
    return own.unionByName(shared).unionByName(met.select(kind.alias("kind"), F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")).alias("key")).where("kind is not null"))


def native_order(ranked: DataFrame, bindings: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, record_id, place): candidates by the best rank of a concept that they are bound to, then by their own rank."""
    # both kinds of rows are grouped by query and record instead of joined: exploded rows look small to Spark, which broadcast them whole
    void = F.lit(None)
    bound = ranked.select("query_id", "cid", F.col("rank").alias("cid_rank")).join(bindings.select("cid", "record_id"), "cid").select("query_id", "record_id", "cid_rank", void.cast(dict(candidates.dtypes)["native_rank"]).alias("native_rank"), F.lit(False).alias("own"))
    own = candidates.select("query_id", "record_id", void.cast(dict(ranked.dtypes)["rank"]).alias("cid_rank"), "native_rank", F.lit(True).alias("own"))
    rows = bound.unionByName(own).where("query_id is not null and record_id is not null").repartition("query_id")
    best = rows.groupBy("query_id", "record_id").agg(F.min("cid_rank").alias("cid_rank"), F.min("native_rank").alias("native_rank"), F.bool_or("own").alias("c"), F.bool_or(~F.col("own")).alias("b")).where("b and c")
    order = W.partitionBy("query_id").orderBy("cid_rank", "native_rank", "record_id")
    return best.select(F.col("query_id").cast(dict(ranked.dtypes)["query_id"]), F.col("record_id").cast(dict(bindings.dtypes)["record_id"]), F.row_number().over(order).alias("place"))
