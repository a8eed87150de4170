"""Whole-graph diagnostics, bounded listings and progress views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from markloom.functions import text as T
from markloom.operators import graph
from markloom.sources.files import saved

MAX_NODES, MAX_EDGES = 500, 1000


def pair_sources(evidence: DataFrame, records: DataFrame) -> DataFrame:
    """(scope, a, b, sources): distinct sources of the active records that show a pair."""
    own = records.select("scope", "record_id", "source_id")
    return evidence.join(own, ["scope", "record_id"]).groupBy("scope", "a", "b", "source_id").agg(F.lit(1).alias("one")).groupBy("scope", "a", "b").agg(F.sum("one").alias("sources"))


def sources_of_pairs(sets: DataFrame) -> DataFrame:
    """pair_sources of sets(scope, record_id, source_id, m): records come together by source with their marks, so that neither they nor their
    pairs meet a table of records, and a source's pairs are told apart where they are. A source's rows are one task's, spilled if need be."""
    dealt = sets.select("scope", "source_id", "record_id", "m").repartition("scope", "source_id")
    one = graph.pairs_of(dealt, "source_id").groupBy("scope", "source_id", "a", "b").agg(F.lit(1).alias("one"))
    return one.groupBy("scope", "a", "b").agg(F.sum("one").alias("sources"))


def npmi_diagnostics(records: DataFrame, marks: DataFrame, support: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """One row a scope: sizes of the vocabulary, of the supported and the positive pairs, and their weights."""
    key = ["scope", "a", "b"]
    supported = support.select(*key, "co_count").join(edges.select(*key, "weight"), key, "left").join(sources, key)
    positive = F.col("weight") > 0
    of_pairs = supported.groupBy("scope").agg(
        F.count("*").alias("supported_pairs"), F.count_if(positive).alias("positive_edges"), F.count_if(F.coalesce(~positive, F.lit(True))).alias("supported_without_positive"),
        F.count_if(positive & (F.col("co_count") == 1)).alias("single_support_positive_edges"), F.count_if(positive & (F.col("sources") == 1)).alias("single_source_positive_edges"), F.count_if(F.col("weight") == 1).alias("unit_weight_edges"),
        F.min(F.when(positive, F.col("weight"))).alias("min_positive_weight"), F.max(F.when(positive, F.col("weight"))).alias("max_positive_weight"), F.round(F.percentile(F.when(positive, F.col("weight")), 0.5), 6).alias("median_positive_weight"),
    )
    ends = supported.select("scope", F.explode(F.array("a", "b")).alias("mark"), positive.alias("positive")).groupBy("scope", "mark").agg(F.max(F.coalesce("positive", F.lit(False))).alias("positive"))
    of_marks = marks.groupBy("scope", "mark").agg(F.count("*").alias("f")).join(ends, ["scope", "mark"], "left").groupBy("scope").agg(F.count("*").alias("active_marks"), F.sum("f").alias("annotation_occurrences"), F.count_if(F.col("positive").isNull()).alias("isolated_marks"), F.count_if(~F.coalesce("positive", F.lit(False))).alias("marks_without_positive_edges"))
    versions = records.groupBy("scope", "source_id").agg(F.count("*").alias("c")).groupBy("scope").agg(F.sum("c").alias("active_records"), F.count("*").alias("active_source_versions"))
    return versions.join(of_marks, "scope", "left").join(of_pairs, "scope", "left").na.fill(0, ["active_marks", "annotation_occurrences", "isolated_marks", "marks_without_positive_edges", "supported_pairs", "positive_edges", "supported_without_positive", "single_support_positive_edges", "single_source_positive_edges", "unit_weight_edges"])


def node_listing(marks: DataFrame, endpoints: DataFrame | None = None, limit: int = MAX_NODES) -> DataFrame:
    """Per scope the most frequent marks; endpoints of edges that no active record has count 0 (edges of these marks themselves have none such)."""
    f = marks.groupBy("scope", "mark").agg(F.count("*").alias("frequency"))
    order = W.partitionBy("scope").orderBy(F.col("frequency").desc(), "mark")
    if endpoints is None:
        return f.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    ids = f.select("scope", "mark").union(endpoints.select("scope", F.explode(F.array("a", "b")).alias("mark"))).distinct()
    return ids.join(f, ["scope", "mark"], "left").na.fill(0, ["frequency"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def edge_listing(support: DataFrame, edges: DataFrame, nodes: DataFrame, limit: int = MAX_EDGES) -> DataFrame:
    """Per scope the edges between listed nodes, heavy ones first."""
    key = ["scope", "a", "b"]
    known = nodes.select("scope", "mark")
    shown = support.join(known.withColumnRenamed("mark", "a"), ["scope", "a"], "left_semi").join(known.withColumnRenamed("mark", "b"), ["scope", "b"], "left_semi")
    weighed = shown.select(*key, "co_count").join(edges.select(*key, "weight"), key, "left")
    order = W.partitionBy("scope").orderBy(F.coalesce(F.col("weight") > 0, F.lit(False)).desc(), F.col("weight").desc_nulls_last(), "a", "b")
    return weighed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def listed_edges(marks: DataFrame, counts: DataFrame, limit: int = MAX_EDGES) -> DataFrame:
    """edge_listing between the listed nodes of these marks' own graph: only their pairs are counted and weighed, at most 500 marks' a scope."""
    nodes = saved(node_listing(marks), "listed-nodes")
    own = marks.join(F.broadcast(nodes.select("scope", "mark")), ["scope", "mark"], "left_semi")
    support = saved(graph.pair_support(own), "listed-support")
    return edge_listing(support, graph.weighed(support, nodes.select("scope", "mark", "frequency"), counts), nodes, limit)


def byte_capped(rows: DataFrame, group: str, order: str, body: str, cap: int) -> DataFrame:
    """The rows of each group, in order, as long as their bodies fit in `cap` bytes."""
    total = F.sum(F.octet_length(body)).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("bytes_so_far", total).where(F.col("bytes_so_far") <= cap)


def edge_details(marks: DataFrame, counts: DataFrame, support: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Each supported pair with its counts and the NPMI computed anew from them."""
    key = ["scope", "a", "b"]
    f = marks.groupBy("scope", "mark").agg(F.count("*").alias("f"))
    joined = support.select(*key, "co_count").join(f.select("scope", F.col("mark").alias("a"), F.col("f").alias("frequency_a")), ["scope", "a"]).join(f.select("scope", F.col("mark").alias("b"), F.col("f").alias("frequency_b")), ["scope", "b"]).join(counts, "scope").join(edges.select(*key, F.col("weight").alias("static_weight")), key, "left").join(sources, key, "left")
    return joined.withColumn("recomputed_npmi", F.round(T.npmi(F.col("co_count"), F.col("frequency_a"), F.col("frequency_b"), F.col("n")), 4)).select(*key, "co_count", "frequency_a", "frequency_b", F.col("n").alias("active_records"), "static_weight", "recomputed_npmi", "sources")


def label_progress(chunks: DataFrame, marks: DataFrame) -> DataFrame:
    """Per source: chunks, and how many of them are labelled."""
    done = marks.groupBy("scope", "record_id").agg(F.count("*").alias("marks"))
    return chunks.join(done, ["scope", "record_id"], "left").groupBy("scope", "source_id").agg(F.count("*").alias("total"), F.count("marks").alias("labelled"), F.coalesce(F.sum("marks"), F.lit(0)).alias("occurrences"))


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """A page of rows in a total order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def file_state(published: str, desired: str, status: str):
    """State of a file from its heads and its version's status."""
    p, d, s = F.col(published), F.col(desired), F.col(status)
    return F.when(p.isNotNull() & (p == d) & (s == "ready"), "complete").when(d.isNotNull() & (s == "ready"), "ready_unpublished").when(s == "failed", "failed").when(p.isNotNull() & d.isNull(), "pointer_invalid").otherwise("pending")


def file_progress(desired: DataFrame, published: DataFrame, versions: DataFrame) -> DataFrame:
    """Every path that a head knows, with both heads, the wanted version's status and the state that follows."""
    paths = desired.select("scope", "path").union(published.select("scope", "path")).distinct()
    d = desired.select("scope", "path", F.col("source_id").alias("desired_id"))
    p = published.select("scope", "path", F.col("source_id").alias("published_id"))
    v = versions.select(F.col("source_id").alias("desired_id"), "status")
    out = paths.join(d, ["scope", "path"], "left").join(p, ["scope", "path"], "left").join(v, "desired_id", "left")
    return out.select("scope", "path", "desired_id", "published_id", "status", file_state("published_id", "desired_id", "status").alias("state"))


def orphans(records: DataFrame, versions: DataFrame, published: DataFrame) -> DataFrame:
    """Active records whose version is missing, not ready, or not the published one."""
    v = versions.select("source_id", "status")
    p = published.select("scope", "source_id", F.lit(True).alias("head"))
    return records.where("active").join(v, "source_id", "left").join(p, ["scope", "source_id"], "left").where(F.col("status").isNull() | (F.col("status") != "ready") | F.col("head").isNull()).select("scope", "record_id", "source_id", "status")


def status_histogram(rows: DataFrame, column: str = "status") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("rows"))


#: The words of an error and the stage that they point to.
ERROR_STAGES = [("decode|utf-8|snapshot|size", "snapshot"), ("pdf|convert", "conversion"), ("label|mark|schema", "labelling"), ("publish|head", "publication")]


def error_stage(error):
    out = F.when(error.isNull(), F.lit(None).cast("string"))
    for words, stage in ERROR_STAGES:
        out = out.when(error.rlike(f"(?i){words}"), stage)
    return out.otherwise("other")
