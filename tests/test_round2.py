"""Known answers for literal hits beyond ASCII, the shared folder, message order, the opened index, and source names."""

import random
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from markloom import session
from markloom.functions import text as T
from markloom.operators import audit, conversation, evidence
from markloom.operators import graph
from markloom.operators import retrieval as R
from markloom.plans.batch import TextGraph


def test_unicode_marks_like_plain_python(spark):
    r = random.Random(331179)
    parts = ["Größe", "GRÖSSE", "ǅ", "ΣΊΣΥΦΟΣ", "σίσυφος", "İstanbul", "naïve", "x", "ab.c", "a-b", "日本", "日本語", "K", "straße", "STRASSE", "ﬁn", "fin", "_y", "9z"]
    marks = sorted({p.strip().casefold() for p in parts} | {"grösse", "strasse", "σίσυφοσ", "c#"})
    queries = [(i, "s", "".join(r.choice(parts) + r.choice([" ", "", ", ", "-", "_", "c# "]) for _ in range(r.randint(0, 6)))) for i in range(200)]

    def hits(mark, text):
        if re.fullmatch(r"[A-Za-z0-9_.\-]+", mark):
            return re.search(rf"(?<![a-z0-9_]){re.escape(mark)}(?![a-z0-9_])", text, re.IGNORECASE) is not None
        return mark in text.casefold()

    want = sorted((i, m) for i, _, t in queries for m in marks if hits(m, t))
    found = R.literal_matches(spark.createDataFrame(queries, "query_id int, scope string, text string"), spark.createDataFrame([("s", m) for m in marks], "scope string, mark string"))
    assert len(want) > 300 and sorted((x.query_id, x.mark) for x in found.collect()) == want
    one = spark.createDataFrame([("Die Größe zählt", "grösse")], "text string, mark string")
    assert one.select(T.hit(F.col("mark"), F.col("text")).alias("h")).head().h


def cluster(**conf):
    told = SimpleNamespace(get=lambda k, d=None: conf.get(k, d))
    return SimpleNamespace(conf=told, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: told))


def test_shared_folder_on_a_cluster():
    assert session.shared_folder(cluster(**{"spark.checkpoint.dir": "hdfs://n/c"})) == "hdfs://n/c"
    assert session.shared_folder(cluster(**{"spark.sql.warehouse.dir": "s3a://b/w"})) == "s3a://b/w"
    for own in ("file:/opt/w", "/opt/w", "spark-warehouse"):
        with pytest.raises(ValueError):
            session.shared_folder(cluster(**{"spark.sql.warehouse.dir": own}))


def test_first_row_of_a_message(spark):
    rows = [("m1", 5, "late"), ("m1", 2, "first"), ("m2", 1, "only"), ("m1", 9, "last")]
    got = conversation.deduplicated_turns(spark.createDataFrame(rows, "message_id string, seq int, content string").repartition(4))
    assert sorted(tuple(r) for r in got.collect()) == [("m1", 2, "first"), ("m2", 1, "only")]


def test_dictionary_in_order_and_kept(spark):
    marks = spark.createDataFrame([(f"common{i:03d}",) for i in range(300)], "mark string")
    ids = {r.label: r.id for r in graph.mark_dictionary(marks).collect()}
    assert [ids[k] for k in sorted(ids)] == list(range(1, 301))
    earlier = spark.createDataFrame(list(ids.items()), "label string, id long")
    more = marks.unionByName(spark.createDataFrame([("a new one",), ("z",)], "mark string"))
    assert {r.label: r.id for r in graph.mark_dictionary(more, earlier).collect()} == ids | {"a new one": 301, "z": 302}
    long = graph.prefix_trie(spark.createDataFrame([("s", "x" * 60)], "scope string, mark string"))
    assert long.count() == 60 and long.where("terminal = 1").head().prefix == "x" * 60


def test_source_names(spark):
    q = 'See “A title with ﬁne‐grained dashes”, doi 10.1234/AB.c). In 2019.'
    names = spark.createDataFrame([(q,), ("none",)], "q string").select(T.source_identity(F.col("q")).alias("n")).collect()
    assert names[0].n.titles == ["a title with fine grained dashes"] and names[0].n.dois == ["10.1234/ab.c"] and names[0].n.years == ["2019"]
    assert names[1].n.titles == []


def test_context_gate(spark):
    pairs = spark.createDataFrame([(1, "s", "a", "b"), (2, "s", "a", "b"), (1, "s", "a", "c")], "query_id int, scope string, a string, b string")
    matches = spark.createDataFrame([(1, "s", "a"), (1, "s", "z"), (2, "s", "a")], "query_id int, scope string, mark string")
    context = spark.createDataFrame([("s", "a", "b", "z"), ("s", "a", "b", "y")], "scope string, a string, b string, mark string")
    got = {(r.query_id, r.b): r.context_passed for r in R.gated(pairs, matches, context).collect()}
    assert got == {(1, "b"): True, (2, "b"): False, (1, "c"): True}


def test_index_is_opened_again(spark):
    d = "/root/testdata/sf0.001"
    assert TextGraph.opened(spark, d) is TextGraph.opened(spark, d)


def test_audit_of_nothing_and_of_nulls(spark):
    edges = spark.createDataFrame([("s", "a", "b", 0.5)], "scope string, a string, b string, weight double")
    support = edges.select("scope", "a", "b")
    assert audit.graph_violations(edges, edges, support).count() == 0
    assert [r.kind for r in audit.graph_violations(edges, edges.limit(0), support).collect()] == ["missing"]
    times = spark.createDataFrame([("2020-01-01T00:00:00Z",), ("2020-01-01 00:00:00",), ("2020-01-01T00:00:00.5+00:00",), (None,)], "t string").select(audit.utc_time(F.col("t")).alias("t")).collect()
    assert [t.t is None for t in times] == [False, True, False, True]


def test_wrapped_entries(spark):
    lines = ["[1] A. Smith, a title that goes on", "over a line, J. Phys. 2001", "This is a sentence.", "2) B. Jones, alone", "", "(3) Doe, J. one", "two", "three", "four, pp. 3", "five", "six 1999"]
    got = {r.line_no: r.kind for r in evidence.line_kinds(spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "")], "record_id int, text string")).where("record_id = 1").collect()}
    assert [got[i] for i in range(11)] == ["bibliography"] * 2 + ["body"] * 3 + ["bibliography"] * 5 + ["body"]
