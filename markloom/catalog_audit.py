"""The queries of operators/audit.py, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from markloom.catalog import _BASKET, _FILES, _RETRIEVE, _TEXT, _heads, _versions, query
from markloom.operators import audit, graph
from markloom.operators import retrieval as R
from markloom.plans.batch import BasketGraph, TextGraph
from markloom.sources import adapters as A


@query(f"""{_BASKET}, stored as (select scope, a, b, case when co_count % 3 = 0 then weight + 0.01 else weight end as weight from edges where co_count % 5 <> 1
  union all select scope, b, a, weight from edges where co_count = 7 union all select scope, a, b || '!', weight from edges where co_count = 6),
j as (select scope, a, b, e.weight as r, s.weight as w, s.a is not null as held, u.a is not null as supported from (select * from edges) e full join (select *, true as h from stored) s using (scope, a, b) left join sup u using (scope, a, b)),
k as (select scope, a, b, case when a >= b then 'wrong_order' when w is null then 'missing' when not exists (select 1 from sup u where u.scope = j.scope and u.a = j.a and u.b = j.b) then 'unsupported' when r is null then 'not_positive' when abs(r - w) > 1e-9 then 'wrong_weight' end as kind from j)
select scope, a, b, kind from k where kind is not null""")
def audit_violations(spark, d):
    """The edges recomputed from the records, against a copy in which rows were changed, left out, turned and made up."""
    g = BasketGraph.opened(spark, d)
    e = g.edges
    changed = e.where("co_count % 5 <> 1").select("scope", "a", "b", F.when(F.col("co_count") % 3 == 0, F.col("weight") + 0.01).otherwise(F.col("weight")).alias("weight"))
    turned = e.where("co_count = 7").select("scope", F.col("b").alias("a"), F.col("a").alias("b"), "weight")
    made_up = e.where("co_count = 6").select("scope", "a", F.concat("b", F.lit("!")).alias("b"), "weight")
    return audit.graph_violations(e, changed.unionByName(turned).unionByName(made_up), graph.pair_support(g.marks))


@query("""select event_id, problems from (select event_id, array_to_string(list_filter([case when scope is null or trim(scope) = '' then 'scope:blank' end, case when moment is null or isnan(moment) or isinf(moment) then 'moment:not_finite' end], lambda x: x is not null), ',') as problems
  from (select event_id, case when event_id % 40 = 0 then ' ' when event_id % 41 = 0 then null else event_type end as scope, case when event_id % 50 = 0 then 'nan'::double when event_id % 51 = 0 then 'inf'::double else value end as moment from events)) where problems <> ''""")
def invalid_rows(spark, d):
    scope = F.when(F.col("event_id") % 40 == 0, " ").when(F.col("event_id") % 41 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type"))
    at = F.when(F.col("event_id") % 50 == 0, F.lit(float("nan"))).when(F.col("event_id") % 51 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return audit.invalid(A.read(spark, d, "events").select("event_id", scope.alias("scope"), at.alias("moment")), ["scope"], ["moment"]).select("event_id", "problems")


_DECIDED = f"""{_RETRIEVE}, decided as (select query_id, record_id, row_number() over (partition by query_id order by direct desc, score desc, record_id desc) as rank, direct from ranked),
decided2 as (select *, case when rank <= 3 then null when direct = 0 then 'no_direct_mark' else 'beyond_limit' end as reason from decided)"""


@query(f"{_DECIDED} select query_id, record_id, rank, reason, reason is null as selected from decided2")
def selection_reasons(spark, d):
    return audit.decided(TextGraph.opened(spark, d).placed).select("query_id", "record_id", "rank", "reason", "selected")


@query(f"""{_DECIDED} select query_id, record_id, case when rank = 2 then 'both' when rank = 5 then 'neither' end as kind from decided2 where rank in (2, 5) union all select query_id, -1, 'unknown' from decided2 where rank = 1""")
def partition_violations(spark, d):
    """A decision whose second place is also excluded, whose fifth is in neither part, and that knows a record too many."""
    rows = audit.decided(TextGraph.opened(spark, d).placed)
    more = rows.where("rank = 1").select("query_id", F.lit(-1).cast("bigint").alias("record_id"))
    excluded = rows.where("rank = 2 or (not selected and rank <> 5)").select("query_id", "record_id")
    return audit.partition_violations(rows, rows.where("selected").select("query_id", "record_id").unionByName(more), excluded, ["query_id", "record_id"])


@query(f"""{_BASKET}, sc as (select scope, min(a) as x, max(b) as y from edges group by scope), hit as (select scope, x as mark from sc union select scope, y from sc),
hp as (select l.scope, l.mark as a, r.mark as b from hit l join hit r on l.scope = r.scope and l.mark < r.mark), dy as (select scope, a, b, weight from edges where co_count % 2 = 0)
select scope, a, b, case when dy.weight is null then 'direct_reinforcement' end as created_by, dy.weight as before_weight, round(dy.weight * 0.99, 6) as after_decay, case when hp.a is not null then 1.0 else 0.0 end::double as reinforcement_added,
  round(coalesce(round(dy.weight * 0.99, 6), 0) + case when hp.a is not null then 1.0 else 0.0 end, 6)::double as after_weight, sup.co_count is not null as active_source_support, coalesce(sup.co_count, 0) as co_count, coalesce(e.weight, 0)::double as static_score
from dy full join (select *, true from hp) hp using (scope, a, b) left join sup using (scope, a, b) left join edges e using (scope, a, b)""")
def edge_transitions(spark, d):
    """One event, whose hits are the first and the last mark of a scope's edges, on the edges of even support."""
    g = BasketGraph.opened(spark, d)
    ends = g.edges.groupBy("scope").agg(F.min("a").alias("x"), F.max("b").alias("y"))
    hits = ends.select("scope", F.explode(F.array("x", "y")).alias("mark"))
    return audit.transitions(g.edges, g.edges.where("co_count % 2 = 0"), hits, graph.pair_support(g.marks))


_FROZEN = f"""{_RETRIEVE}, top as (select *, row_number() over (partition by query_id order by direct desc, score desc, record_id desc) as rank from ranked qualify rank <= 3),
vers as (select lang as scope, source as source_id, sha256(max(doc_id)::varchar || ':' || count(*)) as digest from documents group by all),
fro0 as (select t.query_id, t.scope, t.record_id, rank, source_id, case when length(text) <= 110 then text else substring(text, 1, 109) || '…' end as text, length(text) > 110 as truncated from top t join records r on r.scope = t.scope and r.record_id = t.record_id),
fro as (select f.*, digest, 'M' || rank as citation, sha256(concat_ws('|', f.scope, f.source_id, digest, record_id, f.text)) as bound from fro0 f join vers v on v.scope = f.scope and v.source_id = f.source_id)"""


def _version_digests(spark, d):
    docs = A.read(spark, d, "documents")
    return docs.groupBy(F.col("lang").alias("scope"), F.col("source").alias("source_id")).agg(F.sha2(F.concat(F.max("doc_id").cast("string"), F.lit(":"), F.count("*").cast("string")), 256).alias("digest"))


@query(f"{_FROZEN} select query_id, rank, citation, record_id, digest, bound from fro")
def frozen_references(spark, d):
    g = TextGraph.opened(spark, d)
    return audit.frozen(R.references(g.best, g.records), _version_digests(spark, d)).select("query_id", "rank", "citation", "record_id", "digest", "bound")


@query(f"{_FROZEN} select query_id, case when query_id % 5 = 3 and rank = 3 then 4 else rank end as rank, case when query_id % 5 = 0 then 'text_differs' when query_id % 5 = 1 then 'record_gone' when query_id % 5 = 2 then 'digest_differs' else 'rank_gap' end as kind from fro where query_id % 5 <= 2 or query_id % 5 = 3 and rank = 3")
def retrieval_violations(spark, d):
    """Frozen references of which some had their text, record, digest or rank changed."""
    g = TextGraph.opened(spark, d)
    rows = audit.frozen(R.references(g.best, g.records), _version_digests(spark, d))
    k = F.col("query_id") % 5
    rows = rows.withColumn("text", F.when(k == 0, F.concat(F.lit("~"), "text")).otherwise(F.col("text"))).withColumn("record_id", F.when(k == 1, -F.col("record_id") - 1).otherwise(F.col("record_id"))).withColumn("bound", F.when(k == 2, F.lit("forged")).otherwise(F.col("bound"))).withColumn("rank", F.when((k == 3) & (F.col("rank") == 3), 4).otherwise(F.col("rank")))
    return audit.retrieval_violations(rows, g.records, _version_digests(spark, d))


@query(f"""{_RETRIEVE}, counted as (select scope, 'matches' as stage, count(*) as counted from matches group by scope union all select scope, 'hits', count(*) from hits group by scope union all select scope, 'candidates', count(*) from cand group by scope union all select scope, 'expanded', count(*) from expanded group by scope)
select scope, stage, counted, counted + 1 as told from counted where stage in ('hits', 'expanded')""")
def counter_mismatches(spark, d):
    g = TextGraph.opened(spark, d)
    stages = {"matches": g.matches, "hits": g.hits, "candidates": g.candidates, "expanded": g.expanded}
    counted = None
    for name, rows in stages.items():
        one = rows.groupBy("scope").agg(F.count("*").alias("counted")).withColumn("stage", F.lit(name))
        counted = one if counted is None else counted.unionByName(one)
    told = F.col("counted") + F.when(F.col("stage").isin("hits", "expanded"), 1).otherwise(0)
    return audit.counter_mismatches(counted, counted.select("scope", "stage", told.alias("told")))


@query("select o_orderstatus, bucket, count(*) as rows, sha256(string_agg(own, '' order by o_orderkey)) as digest from (select o_orderstatus, o_orderkey // 1000 as bucket, o_orderkey, sha256(o_orderkey || '|' || o_orderpriority) as own from orders) group by all")
def bucket_digests(spark, d):
    return audit.bucket_digests(A.read(spark, d, "orders"), "o_orderstatus", "o_orderkey", F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority"))


@query("select s_suppkey, s_name, (select count(*) from supplier) as total, case when (select count(*) from supplier) > 15 then 15::bigint end as next_offset from supplier order by s_name, s_suppkey limit 10 offset 5")
def page_with_total(spark, d):
    return audit.page_with_total(A.read(spark, d, "supplier").select("s_suppkey", "s_name"), ["s_name", "s_suppkey"], 5, 10)


@query("select event_id, event_type from (select * from events order by ts desc, event_id desc limit 1000) where event_type = 'purchase' order by ts desc, event_id desc limit 100")
def edge_history(spark, d):
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    return audit.newest(A.read(spark, d, "events"), 1000, F.col("event_type") == "purchase", 100, order).select("event_id", "event_type")


@query(f"with {_FILES}, b as (select page_id as batch_id, 's' || (page_id % 3) as scope, regexp_replace(url, '\\?.*$', '') as path, (page_id - page_id % 2)::varchar as batch_source from pages) select source_id, batch_id, batch_source from versions v join b using (scope, path) qualify row_number() over (partition by scope, path, source_id order by batch_source = source_id desc, batch_id desc) = 1")
def match_first(spark, d):
    batches = _versions(spark, d).select("scope", "path", F.col("created_at").alias("batch_id"), (F.col("created_at") - F.col("created_at") % 2).cast("string").alias("source_id"))
    return audit.best_batch(_versions(spark, d).select("scope", "path", "source_id"), batches, ["scope", "path"]).select("source_id", "batch_id", "batch_source")


@query("select n_nationkey, max(event_id) as seq from nation join events on json_extract_string(props, '$.k') = n_nationkey::varchar group by 1")
def latest_reingest(spark, d):
    events = A.read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("props").alias("body"))
    return audit.latest_by_json(events, "$.k", A.read(spark, d, "nation").select("n_nationkey"), "n_nationkey")


@query(f"with {_FILES} select v.scope, v.path, v.source_id, h.bytes from published p join versions v on v.scope = p.scope and v.source_id = p.source_id join desired dd on dd.scope = p.scope and dd.path = p.path and dd.source_id = p.source_id join (select page_id::varchar as source_id, octet_length(encode(html))::bigint as bytes from pages) h on h.source_id = p.source_id join (select page_id::varchar as source_id from pages where page_id % 4 <> 0) c on c.source_id = p.source_id")
def certified_publications(spark, d):
    """Published heads that are also wanted, with their version, document and certificate: five tables, all by equality."""
    v = _versions(spark, d)
    pages = A.read(spark, d, "pages")
    body = pages.select(F.col("page_id").cast("string").alias("source_id"), F.octet_length("html").cast("bigint").alias("bytes"))
    certificates = pages.where("page_id % 4 <> 0").select(F.col("page_id").cast("string").alias("source_id"))
    heads = _heads(v.where("status = 'ready'")).join(_heads(v), ["scope", "path", "source_id"])
    return heads.join(v.select("scope", "source_id"), ["scope", "source_id"]).join(body, "source_id").join(certificates, "source_id").select("scope", "path", "source_id", "bytes")


@query("select o_custkey, o_orderkey, l_linenumber from orders join lineitem on l_orderkey = o_orderkey qualify row_number() over (partition by o_custkey order by o_orderkey desc, l_linenumber desc) <= 5")
def event_audits(spark, d):
    """The five newest audits of each customer with their events."""
    from pyspark.sql import Window as W

    both = A.read(spark, d, "orders").join(A.read(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = W.partitionBy("o_custkey").orderBy(F.col("o_orderkey").desc(), F.col("l_linenumber").desc())
    return both.withColumn("rn", F.row_number().over(order)).where("rn <= 5").select("o_custkey", "o_orderkey", "l_linenumber")


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 7 <> 0)")
def headless_audits(spark, d):
    headers = A.read(spark, d, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return A.read(spark, d, "lineitem").join(headers, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("select case_id, mark, cid, case when cid is null then 'unknown_seed' end as error from (select c_custkey as case_id, 'n' || c_nationkey as mark from customer) s left join (select 'n' || n_nationkey as mark, n_regionkey as cid from nation where n_nationkey % 6 <> 0) m using (mark)")
def resolved_seeds(spark, d):
    seeds = A.read(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("mark"))
    members = A.read(spark, d, "nation").where("n_nationkey % 6 <> 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("mark"), F.col("n_regionkey").alias("cid"))
    return audit.resolved_seeds(seeds, members).select("case_id", "mark", "cid", "error")


@query("select c_nationkey, string_agg(c_custkey::varchar, ',' order by c_custkey) filter (rn <= 3) as shown, greatest(count(*) - 3, 0) as omitted from (select *, row_number() over (partition by c_nationkey order by c_custkey) as rn from customer) group by 1")
def shown_and_omitted(spark, d):
    return audit.shown_and_omitted(A.read(spark, d, "customer"), "c_nationkey", [F.col("c_custkey")], "c_custkey", 3)


_BIND = "r as (select l_orderkey as record_id, (l_orderkey % 50)::varchar as source_id, 'd' || (l_orderkey % 7) as digest, list_sort(list_distinct(list(l_linenumber))) as places from lineitem group by l_orderkey)"


@query(f"with {_BIND}, c as (select record_id as candidate_id, source_id, digest, places from r) select candidate_id, min(record_id) as record_id from c join r using (source_id, digest, places) group by candidate_id having count(*) = 1")
def unique_bindings(spark, d):
    rows = A.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("places"))
    rows = rows.select(F.col("l_orderkey").alias("record_id"), (F.col("l_orderkey") % 50).cast("string").alias("source_id"), F.concat(F.lit("d"), (F.col("l_orderkey") % 7).cast("string")).alias("digest"), "places")
    return audit.unique_bindings(rows.withColumnRenamed("record_id", "candidate_id").withColumn("places", F.reverse("places")), rows)


@query("select event_id, case when event_id % 3 = 0 then null else epoch(date_trunc('second', ts))::bigint end as seconds from events")
def utc_times(spark, d):
    written = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 3 == 0, "+02:00").when(F.col("event_id") % 3 == 1, "Z").otherwise("+00:00"))
    return A.read(spark, d, "events").select("event_id", audit.utc_time(written).cast("bigint").alias("seconds"))


@query(f"{_TEXT} select c.scope, count(*) as all_occurrences, count(distinct c.mark) as all_marks, count(a.mark) as active_occurrences, count(distinct a.mark) as active_marks from rm c left join am a on a.scope = c.scope and a.record_id = c.record_id and a.mark = c.mark group by c.scope")
def occurrence_counts(spark, d):
    by_mark = A.told_marks(spark, d).groupBy("scope", "mark").agg(F.count("*").alias("n"), F.count_if("active").alias("live"))
    return by_mark.groupBy("scope").agg(F.sum("n").alias("all_occurrences"), F.count("*").alias("all_marks"), F.sum("live").alias("active_occurrences"), F.count_if(F.col("live") > 0).alias("active_marks"))


@query("select p_partkey, case when length(p_name) <= 12 then p_name end as short_name, p_type like 'STANDARD%' or p_brand like 'Brand#1%' as wanted from part")
def guarded_projection(spark, d):
    wanted = F.col("p_type").startswith("STANDARD") | F.col("p_brand").like("Brand#1%")
    return A.read(spark, d, "part").select("p_partkey", audit.guarded(F.col("p_name"), 12).alias("short_name"), wanted.alias("wanted"))


_CONCEPT_GRAPH = """c as (select l_partkey as cid, list_sort(list_distinct(list(case when l_orderkey % 97 = 0 then 0 else l_partkey + l_linenumber - 1 - (l_orderkey % 53 = 0)::int end))) as members, count(*) as frequency from lineitem group by 1),
g as (select o_custkey as a, o_custkey + o_orderkey % 9 - 1 as b, o_orderkey % 60 as co_count, (o_orderkey % 110) / 100.0::double as npmi from orders)"""


@query(f"""with {_CONCEPT_GRAPH}, k as (select unnest(list_filter([case when len(list_filter(members, lambda m: m < 1)) > 0 then 'members_not_positive' end, case when list_min(members) <> cid then 'cid_not_least_member' end], lambda x: x is not null)) as kind, cid::varchar as key from c
  union all select 'member_shared', member::varchar from (select cid, unnest(members) as member from c) group by member having min(cid) <> max(cid)
  union all select case when x.cid is null or y.cid is null then 'unknown_endpoint' when a >= b then 'wrong_order' when npmi <= 0 or npmi > 1 then 'npmi_out_of_range' when co_count > least(x.frequency, y.frequency) then 'co_count_too_large' end, a || '-' || b from g left join c x on x.cid = a left join c y on y.cid = b)
select kind, key from k where kind is not null""")
def concept_violations(spark, d):
    member = F.when(F.col("l_orderkey") % 97 == 0, 0).otherwise(F.col("l_partkey") + F.col("l_linenumber") - 1 - (F.col("l_orderkey") % 53 == 0).cast("int"))
    concepts = A.read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("cid")).agg(F.array_sort(F.collect_set(member)).alias("members"), F.count("*").alias("frequency"))
    edges = A.read(spark, d, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + F.col("o_orderkey") % 9 - 1).alias("b"), (F.col("o_orderkey") % 60).alias("co_count"), ((F.col("o_orderkey") % 110) / 100.0).alias("npmi"))
    return audit.concept_violations(concepts, edges)


_REDUCE = """k as (select c_custkey as query_id, (c_custkey + i) % 25 as cid, i as rank from customer, (values (1), (2), (3)) t(i)), b as (select n_nationkey as cid, (n_nationkey * 7 + j) % 40 as record_id from nation, (values (0), (1), (2), (3)) u(j)),
cd as (select c_custkey as query_id, (c_custkey * 3 + j * 5) % 40 as record_id, j as native_rank from customer, (values (1), (2), (3), (4), (5)) u(j))"""


@query(f"with {_REDUCE} select query_id, record_id, row_number() over (partition by query_id order by min(rank), min(native_rank), record_id) as place from k join b using (cid) join cd using (query_id, record_id) group by query_id, record_id")
def native_order(spark, d):
    who = A.read(spark, d, "customer").select(F.col("c_custkey").alias("query_id"))
    ranked = who.select("query_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("rank")).withColumn("cid", (F.col("query_id") + F.col("rank")) % 25)
    bindings = A.read(spark, d, "nation").select(F.col("n_nationkey").alias("cid"), F.explode(F.array(*map(F.lit, range(4)))).alias("j")).select("cid", ((F.col("cid") * 7 + F.col("j")) % 40).alias("record_id"))
    own = who.select("query_id", F.explode(F.array(*map(F.lit, range(1, 6)))).alias("native_rank")).withColumn("record_id", (F.col("query_id") * 3 + F.col("native_rank") * 5) % 40)
    return audit.native_order(ranked, bindings, own)
