"""Typed paths that meet: a demand's path and a data path as one chain, and everything that speaks against it.

edges(path_id, side, position, source, target, relation, polarity, since, until, scope, evidence), side 0 for the demand's path and 1 for
the data path; needs(path_id, source, target, relation, polarity, since, until, scope), what single edges must state. A chain without any
issue is a hypothesis that waits for judgement, never a proof. A path's edges and needs, few by the
limit, come together as arrays of one row, in which issues are told; a path over the limit of edges or needs is told as such first, and its rows never meet.

Defined results: null or empty names, over-long ones, polarities other than positive and negative, half-open or reversed windows and
missing evidence are issues of the edge, and end the judgement of its path; a null window or scope is unknown, an issue that doesn't; a
path of paths(path_id) without edges is empty; repeated paths and needs count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MAX_EDGES, MAX_NAME = 16, 200
HYPOTHESIS, INSUFFICIENT, STOPPED = "pending_hypothesis", "insufficient", "budget_stop"


def _named(column: str) -> Column:
    return F.coalesce(F.length(column).between(1, MAX_NAME), F.lit(False))


def _names() -> Column:
    return _named("source") & _named("target") & _named("relation")


def _scoped() -> Column:
    return F.col("scope").isNull() | _named("scope")


def _signed() -> Column:
    """A polarity of the two, and a window that is unknown or sound."""
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))
    unknown = F.col("since").isNull() & F.col("until").isNull()
    sound = finite("since") & finite("until") & F.coalesce(F.col("since") <= F.col("until"), F.lit(False))
    return F.coalesce(F.col("polarity").isin("positive", "negative"), F.lit(False)) & (unknown | sound)


_EDGE = ["source", "target", "relation", "polarity", "since", "until", "scope"]
#: Of a path's edges, whether one states a relation and another its opposite, of scopes and windows that may agree.
_CONTRADICTED = """exists(own, p -> p.polarity = 'positive' and exists(own, n -> n.polarity = 'negative' and n.source = p.source and n.target = p.target and n.relation = p.relation
    and coalesce(p.scope = n.scope, true) and (p.since is null or n.since is null or greatest(p.since, n.since) <= least(p.until, n.until))))"""
#: What the edges between each need's ends lack; each step asks the edges that passed the one before.
_NEED_STEPS = (
    "transform(wants, w -> struct(w, filter(own, e -> e.source = w.source and e.target = w.target) as e, exists(own, e -> e.source = w.target and e.target = w.source) as back))",
    "transform({}, x -> struct(x.w, x.back, size(x.e) > 0 as edge, filter(x.e, e -> e.relation = x.w.relation) as e))",
    "transform({}, x -> struct(x.w, x.back, x.edge, size(x.e) > 0 as rel, filter(x.e, e -> e.polarity = x.w.polarity) as e))",
    "transform({}, x -> struct(x.w, x.back, x.edge, x.rel, size(x.e) > 0 as pol, filter(x.e, e -> x.w.scope is null or coalesce(e.scope = x.w.scope, false)) as e))",
    "transform({}, x -> struct(x.w, x.back, x.edge, x.rel, x.pol, size(x.e) > 0 as scope, exists(x.e, e -> coalesce(e.since <= x.w.since and e.until >= x.w.until, false)) as time))",
    """flatten(transform({}, x -> array_compact(array(
    case when not x.edge then if(x.back, 'direction_mismatch', 'required_edge_missing') when not x.rel then 'relation_mismatch' end,
    case when x.rel and not x.pol then 'negation_mismatch' end,
    case when x.rel and x.w.scope is not null and not x.scope then 'scope_mismatch_or_unknown' end,
    case when x.rel and x.w.since is not null and not x.time then 'time_mismatch_or_unknown' end))))""",
)
_LACKS = reduce(lambda inner, step: step.replace("{}", inner), _NEED_STEPS)


def path_meetings(paths: DataFrame, edges: DataFrame, needs: DataFrame, limit: int = MAX_EDGES) -> DataFrame:
    """(path_id, status, issues, meeting): issues sorted, and the node in which the two paths meet if there are none.

    Edges and needs are shuffled once, by path. A path's rows beyond the limit are dropped in the order they come in, so what comes together
    of a path is one row more than the limit at most, which tells that it is over."""
    by_path = W.partitionBy("path_id")
    supported = F.coalesce((F.size("evidence") >= 1) & (F.size("evidence") <= limit) & F.forall("evidence", lambda x: F.coalesce(F.length(x).between(1, MAX_NAME), F.lit(False))), F.lit(False))
    judged = edges.select("path_id", "side", "position", *_EDGE, _names().alias("named"), _signed().alias("signed"), _scoped().alias("scoped"), supported.alias("borne")).withColumn("valid", F.expr("named and signed and scoped and borne"))
    ordered = by_path.orderBy("side", "position")
    chain = judged.withColumn("n", F.row_number().over(ordered)).withColumn("next", F.lead("source").over(ordered)).where(F.col("n") <= limit + 1)
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    own = chain.groupBy("path_id").agg(
        F.count("*").alias("edges"),
        F.count_if(F.col("side") == 0).alias("asked"),
        F.count_if(F.col("side") == 1).alias("given"),
        F.max_by("target", F.when(F.col("side") == 0, F.col("position"))).alias("meeting"),
        some(~F.col("valid")).alias("broken"),
        *[some(~F.col(c)).alias(f"not_{c}") for c in ("named", "signed", "scoped", "borne")],
        some(F.col("valid") & F.col("since").isNull()).alias("no_time"),
        some(F.col("valid") & F.col("scope").isNull()).alias("no_scope"),
        F.coalesce(F.min("scope") < F.max("scope"), F.lit(False)).alias("scopes"),
        F.coalesce(F.max("since") > F.min("until"), F.lit(False)).alias("times"),
        some(F.col("next") != F.col("target")).alias("apart"),
        F.coalesce(F.min("polarity") < F.max("polarity"), F.lit(False)).alias("mixed"),
        F.collect_list(F.struct(*_EDGE)).alias("own"),
    )
    named = _names() & _signed() & _scoped()
    first = needs.select("path_id", *_EDGE, named.alias("named"), F.row_number().over(by_path.orderBy("path_id")).alias("n")).where(F.col("n") <= limit + 1)
    wanted = first.groupBy("path_id").agg(F.count("*").alias("needs"), some(~F.col("named")).alias("unsound"), F.collect_set(F.when(F.col("named"), F.struct(*_EDGE))).alias("wants"))
    met = paths.select("path_id").distinct().join(own, "path_id", "left").join(wanted, "path_id", "left").na.fill(0, ["edges", "asked", "given", "needs"])
    met = met.select(*[F.coalesce(c, F.lit(False)).alias(c) if kind == "boolean" else F.coalesce(c, F.array().cast(met.schema[c].dataType)).alias(c) if kind.startswith("array") else F.col(c) for c, kind in met.dtypes])
    told = lambda **issues: F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in issues.items()]))
    flag = F.col
    at_once = told(
        invalid_identity_or_relation=flag("not_named"),
        invalid_polarity_or_time=flag("not_signed"),
        invalid_scope=flag("not_scoped"),
        missing_or_invalid_evidence=flag("not_borne"),
        time_unknown=flag("no_time"),
        scope_unknown=flag("no_scope"),
        empty_path=(F.col("asked") == 0) | (F.col("given") == 0),
    )
    later = told(
        path_scope_conflict=flag("scopes"),
        path_time_conflict=flag("times"),
        disconnected_or_direction_mismatch=flag("apart"),
        contradictory_polarity=flag("mixed") & F.expr(_CONTRADICTED),
        invalid_requirement=flag("unsound"),
    )
    over = (F.col("edges") > limit) | (F.col("needs") > limit)
    # a null path is nobody's: no issue is told of it
    issues = F.when(over, F.array(F.lit("path_edges"))).when(F.col("path_id").isNull(), F.expr("cast(array() as array<string>)")).when(F.col("broken"), at_once).otherwise(F.concat(at_once, later, F.expr(_LACKS)))
    status = F.when(over, STOPPED).when(F.size("found") == 0, HYPOTHESIS).otherwise(INSUFFICIENT)
    judged = met.withColumn("found", F.array_sort(F.array_distinct(issues))).withColumn("status", status)
    return judged.select("path_id", "status", F.array_join("found", ",").alias("issues"), F.when(F.col("status") == HYPOTHESIS, F.col("meeting")).alias("meeting"))
