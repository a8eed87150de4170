"""Queries over phrases, aliases, typed facts, actions and the edges of rounds, with their DuckDB twins; catalog.py imports this module."""

from __future__ import annotations

from pyspark.sql import functions as F

from markloom.catalog import _KIND, query
from markloom.functions import rules
from markloom.operators import feedback, phrases, structured
from markloom.sources import adapters as A
from markloom.sources.files import saved

# Classes of characters, as DuckDB's patterns have them.
_ON = r"[\p{L}\p{N}\p{M}\p{Cf}\p{Pc}\p{Sm}\p{Pd}+\-−⁺⁻₊₋^•·/*]"
_WORD = r"[\p{L}\p{N}\p{M}_‌‍]"
_COMPACT = r"[\p{L}\p{N}\p{M}\p{Sm}\p{Pd}_‌‍+\-*./·()\[\]⁺⁻₊₋‐‑‒–—−]"


def _spans(name: str, text: str) -> str:
    """Marks are runs of a-z, so one stands in a text at most where such a run begins and ends."""
    return rf"""{name}_cells as (select record_id, {text} as text, unnest(range(1, length({text}) + 1)) as i from chunks),
{name}_runs as (select record_id, i, left(text, i - 1) as l, regexp_extract(substring(text, i), '^[a-z]+') as w, text from {name}_cells where regexp_matches(substring(text, i, 1), '[a-z]') and not regexp_matches(substring(text, i - 1, 1), '^[a-z]$')),
{name} as (select record_id, w as phrase, (i - 1)::int as start, (i - 1 + length(w))::int as "end", l, substring(text, i + length(w)) as r from {name}_runs semi join (select distinct mark from rm) m on m.mark = w)"""


_ALONE = rf"""not regexp_matches(l, '({_ON}|[)\]}}])$') and not regexp_matches(r, '^({_ON}|[(\[{{])') and not regexp_matches(l, '{_ON}[(\[{{]+$') and not regexp_matches(r, '^[)\]}}]+({_ON}|[(\[{{])')
  and not regexp_matches(r, '^\.{_ON}') and not regexp_matches(l, '{_ON}\.$')"""


@query(rf'with {A.CHUNKS},{chr(10)}{A.MARKS},{chr(10)}{_spans("spans", "lower(text)")} select record_id, phrase, start, "end" from spans where {_ALONE}')
def phrase_spans(spark, d):
    """Where the marks stand alone, over all chunks in lower case."""
    texts = A.chunks(spark, d).select("record_id", F.lower("text").alias("text"))
    return phrases.phrase_spans(texts, A.record_marks(spark, d).select(F.col("mark").alias("phrase")))


_NAMED = "nm as (select mark as name, min(record_id) as cid from rm group by mark)"


@query(rf"""with {A.CHUNKS},{chr(10)}{A.MARKS}, {_NAMED}, {_spans("folded", "replace(lower(text), 'ß', 'ss')")}, {_spans("written", "text")}
select distinct record_id, name, cid, 'folded' as how from folded join nm on name = phrase where length(name) > 4 and not regexp_matches(l, '{_WORD}$') and not regexp_matches(r, '^{_WORD}')
union all select distinct record_id, name, cid, 'exact' from written join nm on name = phrase where length(name) <= 4 and not regexp_matches(l, '{_COMPACT}$') and not regexp_matches(r, '^{_COMPACT}')""")
def protected_matches(spark, d):
    """Marks as names of concepts in all chunks: long ones in any case, short ones as they are written."""
    names = A.record_marks(spark, d).groupBy(F.col("mark").alias("name")).agg(F.min("record_id").alias("cid"))
    return phrases.protected_matches(A.chunks(spark, d).select("record_id", "text"), names)


@query(f"""with {A.CHUNKS},\n{A.MARKS}, k as (select distinct mark as name from rm),
s as (select name, case when length(name) <= 4 then name when name like '%ies' and length(name) > 5 then left(name, -3) || 'y' when name like '%sses' then left(name, -2)
  when name like '%s' and not regexp_matches(name, '(ss|us|is)$') then left(name, -1) else name end as one from (select regexp_replace(regexp_replace(name, '^centre$', 'center'), '^(ioni|polari)sation$', '\\1zation') as name from k)),
v as (select k.name, regexp_replace(regexp_replace(k.name, '^centre$', 'center'), '^(ioni|polari)sation$', '\\1zation') as value from k)
select v.name, case when s.one <> s.name and s.one in (select value from v) and not (s.one like '%s' and left(s.one, -1) in (select value from v)) then s.one else v.value end as canonical from v join (select distinct * from s) s on s.name = v.value""")
def alias_canon(spark, d):
    """The marks' canonical aliases, the marks themselves being the corpus."""
    marks = saved(A.record_marks(spark, d).select(F.col("mark").alias("name")).distinct(), "names")
    return phrases.alias_canon(marks, marks)


#: Orders as notes with a line of facts in the form that is read, broken in one way or another by the order's number.
_FACT = """'{"facts":[{"subject":"c' || o_custkey || '","object":"o' || o_orderkey || '","relation":"made","polarity":"positive","time":"' || o_orderdate::date || '"},{"object":"' || o_orderstatus || '","subject":"o' || o_orderkey || '","relation":"has","polarity":"negative","conditions":["now","here"]}]}'"""
_BREAKS = [
    ('{"facts":', '{"facts', "not_json"),
    ('"polarity":"negative"', '"polarity":"maybe"', "not_a_fact"),
    ('"relation":"has",', "", "not_a_fact"),
    ('"relation":"has"', '"relation":"has","relation":"had"', "duplicate_key"),
    ('{"facts":', '{"version":NaN,"facts":', "not_json"),
    ('{"facts":', '{"version":1,"facts":', "not_the_contract"),
    ('"time":"', '"time":"","scope":"', "bad_qualifier"),
    ('["now","here"]', '["now",7]', "bad_conditions"),
    ('"subject":"o', '"certainty":1,"subject":"o', "not_a_fact"),
    ('{"facts":', '[{"facts":', "not_json"),
]
_BROKEN = " ".join(f"when {k} then replace(j, '{old}', '{new}')" for k, (old, new, _) in enumerate(_BREAKS))
_PROBLEM = " ".join(f"when {k} then '{why}'" for k, (_, _, why) in enumerate(_BREAKS))
_NOTES = f"""j as (select *, {_FACT} as j from orders),
notes as (select *, o_orderkey // 32 % 16 as k, 'order ' || o_orderkey || chr(10) as head, 'typed_facts_v1: ' || case o_orderkey // 32 % 16 {_BROKEN} else j end as line from j)"""
_PLACE = 'length(head)::int as start, length(head || line)::int as "end", sha256(line) as line_sha256'


@query(f"""with {_NOTES}
select o_orderkey as record_id, {_PLACE}, 0 as fact_no, 'c' || o_custkey as subject, 'made' as relation, 'o' || o_orderkey as object, 'positive' as polarity, o_orderdate::date::varchar as time, '' as conditions, null as problem from notes where k >= {len(_BREAKS)}
union all select o_orderkey, {_PLACE}, 1, 'o' || o_orderkey, 'has', o_orderstatus, 'negative', null, 'now,here', null from notes where k >= {len(_BREAKS)}
union all select o_orderkey, {_PLACE}, null, null, null, null, null, null, null, case k {_PROBLEM} end from notes where k < {len(_BREAKS)}""")
def typed_facts(spark, d):
    o = A.read(spark, d, "orders")
    text = {c: F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderstatus")} | {"day": F.to_date("o_orderdate").cast("string")}
    j = F.concat(F.lit('{"facts":[{"subject":"c'), text["o_custkey"], F.lit('","object":"o'), text["o_orderkey"], F.lit('","relation":"made","polarity":"positive","time":"'), text["day"], F.lit('"},{"object":"'), text["o_orderstatus"], F.lit('","subject":"o'), text["o_orderkey"], F.lit('","relation":"has","polarity":"negative","conditions":["now","here"]}]}'))
    k = F.expr("o_orderkey div 32 % 16")
    body = j
    for n, (old, new, _) in enumerate(_BREAKS):
        body = F.when(k == n, F.replace(j, F.lit(old), F.lit(new))).otherwise(body)
    note = F.concat(F.lit("order "), text["o_orderkey"], F.lit("\ntyped_facts_v1: "), body, F.lit("\nend typed_facts_v1: {}"))
    found = structured.typed_facts(o.select(F.col("o_orderkey").alias("record_id"), note.alias("text")))
    return found.drop("scope").withColumn("conditions", F.array_join("conditions", ","))


#: An action as it should be, over a customer's name, and what is changed in it with the reason that this gives.
_ACTION = """{"action":"query","missing_evidence":["orders"],"clarification":"","stop_reason":"","query":{"entities":[{"id":"e1","surface":"Customer","canonical":"customer","span":[0,8]},{"id":"e2","surface":"$","canonical":"number","span":[9,18]}],"relations":[{"subject_id":"e1","object_id":"e2","predicate":"numbered","surface":"Customer","span":[0,8],"negated":false,"direction":"undirected"}],"negations":[],"time":null,"scope":null,"canonical_terms":["customer"],"ambiguities":[]}}"""
_CHANGES = [
    ('"action":"query"', '"action":"shout"', "unknown_action"),
    ("[9,18]", "[9,19]", "not_anchored"),
    ('"surface":"Customer","canonical"', '"surface":"customer","canonical"', "not_anchored"),
    ('"action":"query"', '"action":"query","action":"query"', "duplicate_key"),
    ('"time":null', '"time":Infinity', "not_json"),
    ('"object_id":"e2"', '"object_id":"e3"', "unknown_entity"),
    ('"ambiguities":[]', '"ambiguities":["which"]', "ambiguous"),
    ('["customer"]', "[]", "no_terms"),
    ('"id":"e2"', '"id":"e1"', "entity_identity"),
    ('"stop_reason":""', '"stop_reason":"ambiguity"', "needs_missing"),
    ('"action":"query"', '"action":"answer"', "unexpected_query"),
    ('"negated":false', '"negated":0', "bad_relation"),
    (',"scope":null', "", "wrong_keys"),
    ('["orders"]', '["a","b","c","d"]', "bad_list"),
    ('"canonical":"number"', '"canonical":" "', "bad_text"),
]


@query(f"""select c_custkey as query_id, case when c_custkey % 20 >= {len(_CHANGES)} then 'query' end as action, case c_custkey % 20 {" ".join(f"when {k} then '{why}'" for k, (_, _, why) in enumerate(_CHANGES))} end as reason from customer""")
def judged_actions(spark, d):
    c = A.read(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_name").alias("text"))
    good = F.replace(F.lit(_ACTION), F.lit("$"), F.substring("text", 10, 9))
    body = good
    for n, (old, new, _) in enumerate(_CHANGES):
        body = F.when(F.col("query_id") % 20 == n, F.replace(good, F.lit(old), F.lit(new))).otherwise(body)
    return structured.judged_actions(c.withColumn("body", body)).drop("identity")


#: A source is a round; its chunks of documents with a good label are frozen in it.
_ROUNDS = f"""{A.CHUNKS},\n{A.MARKS},
sel as (select record_id, regexp_extract_all(lower(text), '[a-z0-9_]+') as toks, ({_KIND}) <> '{rules.OTHER_KIND}' or regexp_matches(text, '(?im){rules.REFERENCE_HEADING}') as unfit from chunks semi join (select doc_id from labels where quality = 1) g using (doc_id)),
sup as (select x.scope, c.source_id as round, x.record_id, x.mark as a, y.mark as b from rm x join rm y on x.scope = y.scope and x.record_id = y.record_id and x.mark < y.mark join chunks c on c.record_id = x.record_id),
j as (select sup.*, case when s.record_id is null then 'not_frozen_in_round' when unfit then 'bibliography_or_metadata' when not (list_contains(toks, a) and list_contains(toks, b)) then 'endpoint_absent' end as reason from sup left join sel s on s.record_id = sup.record_id),
q as (select scope, round, a, b, count(*) as support, count(*) filter (reason is null) as bindings, count(*) filter (reason = 'not_frozen_in_round') as unresolved, list(distinct reason) filter (reason is not null) as met from j group by scope, round, a, b)"""


def _judged(spark, d):
    marks = A.record_marks(spark, d, "source_id")
    sets = saved(marks.groupBy("scope", "record_id", F.col("source_id").alias("round")).agg(F.collect_set("mark").alias("m")), "round-sets")  # eight marks at most
    good = A.read(spark, d, "labels").where("quality = 1").select("doc_id")
    texts = A.chunks(spark, d).join(good, "doc_id", "left_semi").select("record_id", "text")
    return feedback.judged_records(sets, sets.withColumnRenamed("m", "marks").join(texts, "record_id"))


@query(f"with {_ROUNDS} select scope, round, a, b, support, bindings, unresolved, bindings > 0 as qualified, array_to_string(list_sort(list_concat(coalesce(met, []), case when bindings = 0 then ['no_qualified_support'] else [] end)), ',') as reasons from q")
def qualified_edges(spark, d):
    return feedback.qualified_edges(_judged(spark, d))


@query(f"with {_ROUNDS} select scope, a, b, count(*) as rounds, min(round) as first_round, sum(bindings)::bigint as bindings from q where bindings > 0 group by scope, a, b")
def union_graph(spark, d):
    """The graph that all rounds' qualified edges make."""
    bound = _judged(spark, d).where("reason is null")  # the others qualify nothing
    return feedback.union_graph(feedback.qualified_edges(bound))
