"""Typed paths over orders and their lines, and grounded questions on parts, with planted faults and their DuckDB twins; catalog.py imports this module.

The inputs are plain expressions that both engines read alike; how issues are found is written twice."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from markloom.catalog import query
from markloom.operators import grounding, meetings
from markloom.sources import adapters as A

_ASK = {
    "source": "'c' || o_custkey",
    "target": "'o' || o_orderkey",
    "relation": "'made'",
    "since": "cast(case when o_orderkey % 17 = 0 then null else day end as double)",
    "until": "cast(case when o_orderkey % 17 = 0 then null when o_orderkey % 19 = 0 then day - 1 else day + 4000 end as double)",
    "scope": "case when o_orderkey % 23 = 0 then null when o_orderkey % 41 = 0 then '' else 'trade' end",
}
_GIVE = {
    "source": "case when qty = 50 then 'x' when before is null then 'o' || l_orderkey else 'p' || before end",
    "target": "'p' || part",
    "relation": "'holds'",
    "polarity": "case when qty = 48 then 'maybe' when flag = 'R' then 'negative' else 'positive' end",
    "since": "cast(day - 2000 as double)",
    "until": "cast(day + 2000 as double)",
    "scope": "case when qty = 49 then 'other' else 'trade' end",
}
_NEED = {
    "source": "case when o_orderkey % 13 = 0 then 'o' || o_orderkey else 'c' || o_custkey end",
    "target": "case when o_orderkey % 13 = 0 then 'c' || o_custkey when o_orderkey % 31 = 0 then 'z' else 'o' || o_orderkey end",
    "relation": "case when o_orderkey % 5 = 0 then 'paid' when o_orderkey % 43 = 0 then '' else 'made' end",
    "polarity": "case when o_orderkey % 11 = 0 then 'negative' else 'positive' end",
    "since": "cast(case when o_orderkey % 9 = 0 then null when o_orderkey % 3 = 0 then day - 5 else day + 10 end as double)",
    "until": "cast(case when o_orderkey % 9 = 0 then null else day + 20 end as double)",
    "scope": "case when o_orderkey % 6 = 0 then null when o_orderkey % 4 = 0 then 'other' else 'trade' end",
}
_COPIES = "case when o_orderkey % 37 = 0 then 17 else 1 end"
_SIDES = "case when o_orderkey % 7 = 0 then 2 else 1 end"


def _sql(columns: dict) -> str:
    return ", ".join(f"{e} as {c}" for c, e in columns.items())


_INPUTS = f"""o as (select *, date_diff('day', timestamp '1990-01-01', o_orderdate) as day from orders),
l0 as (select l_orderkey, l_linenumber, min(l_partkey) as part, max(l_quantity)::int as qty, max(l_returnflag) as flag, date_diff('day', timestamp '1990-01-01', min(l_shipdate)) as day from lineitem group by all),
l1 as (select *, lag(part) over (partition by l_orderkey order by l_linenumber) as before from l0),
e as (select o_orderkey as path_id, 0 as side, k as position, {_sql(_ASK)}, case k when 1 then 'positive' else 'negative' end as polarity, o_orderkey % 29 <> 0 as borne from (select *, unnest(range(1, {_SIDES} + 1)) as k from o)
  union all by name select l_orderkey as path_id, 1 as side, l_linenumber as position, {_sql(_GIVE)}, true as borne from l1),
nd as (select o_orderkey as path_id, {_sql(_NEED)}, {_COPIES} as copies from o)"""
_ISSUES = """size as (select path_id, count(*) as n, count(*) filter (side = 0) as n0, count(*) filter (side = 1) as n1, arg_max(target, position) filter (side = 0) as last from e group by all),
p as (select path_id, coalesce(n0, 0) as n0, coalesce(n1, 0) as n1, last, copies > 16 or coalesce(n, 0) > 16 as over from nd left join size using (path_id)),
f as (select e.*, polarity in ('positive', 'negative') and (since is null or since <= until) as signed, coalesce(scope, 'x') <> '' as scoped from e join p using (path_id) where not over),
v as (select *, signed and scoped and borne as valid from f),
bad as (select distinct path_id from v where not valid),
s as (select * from v anti join bad using (path_id)),
w as (select * from nd semi join (select path_id from p where not over) using (path_id) anti join bad using (path_id)),
wv as (select * from w where relation <> ''),
q as (select wv.*, exists (select 1 from s where s.path_id = wv.path_id and s.source = wv.source and s.target = wv.target) as has_edge,
  exists (select 1 from s where s.path_id = wv.path_id and s.source = wv.target and s.target = wv.source) as has_back,
  exists (select 1 from s where s.path_id = wv.path_id and s.source = wv.source and s.target = wv.target and s.relation = wv.relation) as has_relation,
  exists (select 1 from s where s.path_id = wv.path_id and s.source = wv.source and s.target = wv.target and s.relation = wv.relation and s.polarity = wv.polarity) as has_polarity,
  exists (select 1 from s where s.path_id = wv.path_id and s.source = wv.source and s.target = wv.target and s.relation = wv.relation and s.polarity = wv.polarity and (wv.scope is null or s.scope = wv.scope)) as has_scope,
  exists (select 1 from s where s.path_id = wv.path_id and s.source = wv.source and s.target = wv.target and s.relation = wv.relation and s.polarity = wv.polarity and (wv.scope is null or s.scope = wv.scope) and s.since <= wv.since and s.until >= wv.until) as has_time from wv),
i as (select path_id, 'empty_path' as issue from p where not over and (n0 = 0 or n1 = 0)
  union all select path_id, 'invalid_polarity_or_time' from v where not signed union all select path_id, 'invalid_scope' from v where not scoped union all select path_id, 'missing_or_invalid_evidence' from v where not borne
  union all select path_id, 'time_unknown' from v where valid and since is null union all select path_id, 'scope_unknown' from v where valid and scope is null
  union all select path_id, 'path_scope_conflict' from s group by path_id having count(distinct scope) > 1
  union all select path_id, 'path_time_conflict' from s group by path_id having max(since) > min(until)
  union all select path_id, 'disconnected_or_direction_mismatch' from (select path_id, target, lead(source) over (partition by path_id order by side, position) as nxt from s) where nxt <> target
  union all select a.path_id, 'contradictory_polarity' from s a join s b on a.path_id = b.path_id and a.source = b.source and a.target = b.target and a.relation = b.relation and a.polarity < b.polarity where coalesce(a.scope = b.scope, true) and coalesce(greatest(a.since, b.since) <= least(a.until, b.until), true)
  union all select path_id, 'invalid_requirement' from w where relation = ''
  union all select path_id, case when has_back then 'direction_mismatch' else 'required_edge_missing' end from q where not has_edge
  union all select path_id, 'relation_mismatch' from q where has_edge and not has_relation
  union all select path_id, 'negation_mismatch' from q where has_relation and not has_polarity
  union all select path_id, 'scope_mismatch_or_unknown' from q where has_relation and scope is not null and not has_scope
  union all select path_id, 'time_mismatch_or_unknown' from q where has_relation and since is not null and not has_time),
g as (select path_id, array_to_string(list_sort(list(distinct issue)), ',') as issues from i group by path_id)"""


@query(f"with {_INPUTS},\n{_ISSUES}\nselect path_id, case when over then 'budget_stop' when issues is null then 'pending_hypothesis' else 'insufficient' end as status, case when over then 'path_edges' else coalesce(issues, '') end as issues, case when not over and issues is null then last end as meeting from p left join g using (path_id)")
def path_meetings(spark, d):
    """Of each order whether the path from its customer and the path along its lines' parts meet."""
    day = lambda c: F.datediff(c, F.lit("1990-01-01").cast("date"))
    orders = A.read(spark, d, "orders").withColumn("day", day("o_orderdate"))
    # by order alone, as the window below needs them
    lines = A.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.max("l_quantity").cast("int").alias("qty"), F.max("l_returnflag").alias("flag"), day(F.min("l_shipdate")).alias("day"))
    lines = lines.withColumn("before", F.lag("part").over(W.partitionBy("l_orderkey").orderBy("l_linenumber")))  # an order's distinct line numbers
    made = lambda columns: [F.expr(e).alias(c) for c, e in columns.items()]
    asked = orders.withColumn("k", F.explode(F.sequence(F.lit(1), F.expr(_SIDES)))).select(F.col("o_orderkey").alias("path_id"), F.lit(0).alias("side"), F.col("k").alias("position"), *made(_ASK), F.when(F.col("k") == 1, "positive").otherwise("negative").alias("polarity"), F.expr("if(o_orderkey % 29 <> 0, array('o' || o_orderkey), cast(array() as array<string>))").alias("evidence"))
    given = lines.select(F.col("l_orderkey").alias("path_id"), F.lit(1).alias("side"), F.col("l_linenumber").alias("position"), *made(_GIVE), F.array(F.concat(F.lit("l"), F.col("l_linenumber").cast("string"))).alias("evidence"))
    needs = orders.withColumn("k", F.explode(F.sequence(F.lit(1), F.expr(_COPIES)))).select(F.col("o_orderkey").alias("path_id"), *made(_NEED))
    return meetings.path_meetings(orders.select(F.col("o_orderkey").alias("path_id")), asked.unionByName(given), needs)


#: A question on each part, of eight kinds; names of parts are concepts, some of them double, some without members.
_QUESTION = "case p_partkey % 8 when 0 then 'Which fine: ' || fine || ' is a ' || name || '?' when 1 then 'Is a ' || name || ' of ' || coarse || 's?' when 2 then 'Is a ' || name || ' of ' || coarse || ' or fine: ' || fine || '?' when 3 then 'Is a ' || name || ' of ' || coarse || ' or of ' || fine || '?' when 4 then 'Which ' || name || ' is it?' when 5 then 'Which fine: ' || fine || ' is it?' when 6 then 'Which fine: none is a ' || name || '?' else ' ' end"


@query(f"""with c as (select p_name as name, min(p_partkey) as cid, min('kind_' || lower(p_type)) as fine, min(p_brand) as coarse from part group by all),
q as (select p_partkey as question_id, p_partkey % 8 as k, c.*, {_QUESTION} as text from part join c on name = p_name),
j as (select *, case when k = 7 then 'invalid_question' when k = 5 then 'no_grounded_vocabulary' when cid % 7 = 0 then 'ambiguous_name' when cid % 5 = 0 then 'missing_original_member' when k = 3 then 'ambiguous_target' when k in (4, 6) then 'no_explicit_target' end as reason from q),
t as (select *, case k when 1 then coarse else fine end as label, case k when 1 then coarse || 's' else 'fine: ' || fine end as words from j)
select question_id, reason, case when reason is null then name || '@' || (strpos(text, name) - 1) || '=' || cid end as terms, case when reason is null then case k when 1 then 'coarse ' else 'fine ' end || label || '@' || (strpos(text, words) - 1) || '-' || (strpos(text, words) - 1 + length(words)) end as targets from t""")
def question_grounding(spark, d):
    parts = A.read(spark, d, "part")
    named = parts.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("cid"), F.min(F.concat(F.lit("kind_"), F.lower("p_type"))).alias("fine"), F.min("p_brand").alias("coarse"))
    double = named.where("cid % 7 = 0").withColumn("cid", -1 - F.col("cid"))
    of = parts.join(named, F.col("name") == F.col("p_name"))
    asked = of.select(F.col("p_partkey").alias("question_id"), F.expr(_QUESTION).alias("text"))
    found = grounding.question_grounding(asked, named.unionByName(double), of.where("cid % 5 <> 0").select(F.col("p_partkey").alias("member"), "cid"))
    terms = F.transform("terms", lambda t: F.concat(t["term"], F.lit("@"), t["start"].cast("string"), F.lit("="), t["cid"].cast("string")))
    targets = F.transform("targets", lambda t: F.concat(t["level"], F.lit(" "), t["target"], F.lit("@"), t["start"].cast("string"), F.lit("-"), t["end"].cast("string")))
    return found.select("question_id", "reason", F.array_join(terms, "|").alias("terms"), F.array_join(targets, "|").alias("targets"))
