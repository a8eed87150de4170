"""Steps that must stay small on large tables: what a plan shuffles, and the same rows as by the plain rule."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from markloom.operators import analytics, audit, graph
from markloom.operators import retrieval as R
from markloom.plans.batch import TextGraph
from markloom.sources import adapters as A


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def tables(spark, folder, documents, labels=((99, 1, 0),)):
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_marks_are_cut_from_a_chunks_own_array(spark, tmp_path):
    texts = ["alpha beta gamma delta epsilon that zeta theta iota kappa lambda sigma", "Alpha beta gamma delta epsilon zeta theta iota lonely kappa lambda", "omicron alpha", "", None, "that that"]
    docs = [(i, t, "en" if i < 3 else "de", f"s{i % 2}", 0) for i, t in enumerate(texts)] + [(7, "alpha beta", None, "s", 0), (8, "alpha beta", "en", None, 0)]
    d = tables(spark, tmp_path, docs, [(0, 1, 0), (1, 0, 0)])
    words, df = defaultdict(set), Counter()
    for i, t, lang, _, _ in docs:
        if t and lang:
            words[lang, i * 100_000] = set(re.findall("[a-z]{4,40}", t.lower())) - set(A.SELF_MARKS)
    for (lang, _), ws in words.items():
        df.update((lang, w) for w in ws)
    want = {(lang, r, w) for (lang, r), ws in words.items() for w in sorted((w for w in ws if df[lang, w] > 1), key=lambda w: (-len(w), w))[:8]}
    found = A.record_marks(spark, d)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert sorted(tuple(r)[:3] for r in A.active_marks(spark, d).collect()) == sorted(x for x in want if x[1] != 100_000)
    assert {(r.scope, r.record_id, r.mark) for r in A.told_marks(spark, d).where("not active").collect()} == {x for x in want if x[1] == 100_000}
    assert "Window" not in plan(found)  # before, each word of each chunk was a row of a join and of a window


def random_marks(spark, seed, records=60, words="abcdefgh"):
    import random

    r = random.Random(seed)
    rows = [("s", i, m, "x") for i in range(records) for m in r.sample(words, r.randint(1, 4))]
    return spark.createDataFrame(rows, "scope string, record_id long, mark string, source_id string")


def test_context_of_asked_pairs_is_that_of_all(spark):
    marks = random_marks(spark, 1)
    by_record = defaultdict(set)
    for r in marks.collect():
        by_record[r.record_id].add(r.mark)
    want = {("s", a, b, c) for m in by_record.values() for a in m for b in m for c in m if a < b and c not in (a, b)}
    found = graph.pair_context(marks)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "array_except" not in plan(found)  # before, a record's three marks were compared as three rows
    asked = spark.createDataFrame([("s", "a", "b"), ("s", "c", "h"), ("s", "a", "zz")], "scope string, a string, b string")
    assert sorted(map(tuple, graph.context_of(marks, asked).collect())) == sorted(x for x in want if x[1:3] in (("a", "b"), ("c", "h")))


def test_edges_group_pairs_once(spark):
    marks = random_marks(spark, 2)
    counts = marks.groupBy("scope").agg(F.countDistinct("record_id").alias("n"))
    found = graph.npmi_edges(marks, counts)
    old = graph.weighed(graph.pair_support(marks), graph.mark_frequency(marks), counts).select(*found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, old.collect())) != []
    assert plan(found).count("Join") == 2  # frequencies meet marks; scopes' counts meet pairs
    hits = spark.createDataFrame([("s", "a"), ("s", "c")], "scope string, mark string")
    near, every = graph.nearest_edges(found, hits, 2), graph.directed_edges(found).where("neighbor_order <= 2 and mark in ('a', 'c')")
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, every.collect())) != []


def test_first_references_need_no_other_candidates(spark):
    for seed in range(3):
        marks = random_marks(spark, seed, 120)
        queries = spark.createDataFrame([(i, "s", t) for i, t in enumerate(["a b c d", "e f", "h a", "g", "zz"])], "query_id long, scope string, text string")
        edges = graph.directed_edges(graph.npmi_edges(marks, spark.createDataFrame([("s", 120)], "scope string, n long")))
        matches = R.literal_matches(queries, marks.select("scope", "mark").distinct())
        hits = R.direct_hits(matches)
        context = lambda asked, marks=marks: graph.context_of(marks, asked)
        found = R.expansion_candidates(hits, matches, edges, context)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, R.expansion_candidates(hits, matches, edges, graph.pair_context(marks)).select(*found.columns).collect()))
        args = (hits, R.expanded_marks(found), R.direct_evidence(hits, matches, edges, context), marks)
        first = lambda df: sorted(map(tuple, audit.decided(df).where("selected").collect()))
        some, every = R.best_candidates(*args), R.ranked_candidates(*args)
        assert first(some) == first(every) != []
        assert some.count() < every.count()


def test_a_seed_of_many_cases_spreads_once(spark, monkeypatch):
    edges = spark.createDataFrame([("x", "p", 1.0), ("x", "q", 2.0), ("y", "q", 1.0)], "a string, b string, weight double")
    nodes = spark.createDataFrame([("p", "t", 1), ("q", "t", 3)], "node string, label string, frequency long")
    a = spark.createDataFrame([(i, "x") for i in range(9)], "case_id int, node string")
    b = spark.createDataFrame([(i, "y") for i in range(0, 9, 2)], "case_id int, node string")
    targets = a.select("case_id", F.lit("t").alias("label"))
    asked, spread = [], analytics.walk_with_restart
    monkeypatch.setattr(analytics, "walk_with_restart", lambda e, s: asked.append(s.count()) or spread(e, s))
    found = analytics.rank_cases(nodes, edges, a, b, targets).where("variant = 'alpha_nomeet'").collect()
    both = spark.createDataFrame([(0, "x"), (0, "y"), (1, "x")], "case_id int, node string")
    want = {(r.case_id, r.node): round(r.score, 9) for r in spread(edges, both).collect()}
    assert {(r.case_id % 2, r.node): r.score for r in found} == {k: v for k, v in want.items() if k[1] in "pq"}
    assert asked == [2]  # before, 23 groups of 9 cases


def test_pool_by_blocks_of_records_and_queries(spark, monkeypatch):
    import random

    r = random.Random(5)
    scopes, terms = {"en": range(300), "de": range(300, 340)}, "abcdefg"
    index = [(s, i, t) for s, ids in scopes.items() for i in ids for t in r.sample(terms, r.randint(1, 5))]
    weights = [(q, "en" if q < 25 else "de", t, round(1 + r.random(), 6) if t < "d" else 1.5) for q in range(30) for t in r.sample(terms, 3)]
    monkeypatch.setattr(R, "QUERIES_A_BLOCK", 7)
    found = R.lexical_pool(spark.createDataFrame(weights, "query_id long, scope string, term string, weight double"), spark.createDataFrame(index, "scope string, record_id long, term string"), limit=10, block=40)
    sums = defaultdict(float)
    own = {(s, i, t) for s, i, t in index}
    for q, s, t, w in weights:
        for i in scopes[s]:
            if (s, i, t) in own:
                sums[q, s, i] += w
    want = []
    for q in range(30):
        best = sorted(((round(x, 6), i, s) for (k, s, i), x in sums.items() if k == q), reverse=True)[:10]
        want += [(q, s, i, x, n) for n, (x, i, s) in enumerate(best, 1)]
    assert sorted(tuple(x) for x in found.select("query_id", "scope", "record_id", "lexical", "lexical_rank").collect()) == sorted(want)
    assert "sum(weight" not in plan(found)  # before, each record that has a topic word was a row of each query


def test_terms_need_no_marks(spark, tmp_path):
    d = tables(spark, tmp_path, [(0, "Alpha beta-gamma alpha", "en", "s", 0), (1, "delta", "de", "s", 0)], [(1, 0, 0)])
    g = TextGraph(spark, d)
    assert sorted(map(tuple, g.index.collect())) == [("en", 0, "alpha"), ("en", 0, "beta"), ("en", 0, "gamma")]
    assert not {"marks", "record_texts"} & set(g.__dict__)  # before, the index came from texts joined with their marks
