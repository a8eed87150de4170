"""Findings of round 3, second part: work and shuffles that grew faster than the input."""

import random
from types import SimpleNamespace

from markloom import catalog
from markloom.operators import retrieval as R


def _graph(spark):
    rng = random.Random(5)
    words = [f"w{chr(97 + i)}x" for i in range(14)]
    texts = [" ".join(rng.sample(words, 5)) + rng.choice(["", " 7", " = 7", "\n- is", " pad" * 60]) for _ in range(60)]
    texts += [t.upper().replace(" ", "  ") for t in texts[:20]] + texts[10:30] + ["x" * 1190 + " " + " ".join(words)]
    records = spark.createDataFrame([("st"[i % 2], i, "d", t) for i, t in enumerate(texts * 2)], "scope string, record_id long, source_id string, text string")
    marks = R.record_terms(records).where("length(term) = 3 and term < 'wj'").withColumnRenamed("term", "mark")
    queries = [(q, "st"[q % 2], "What values and steps define " + " ".join(rng.sample(words, 1 + q % 9)) + "?") for q in range(16)]
    hits = spark.createDataFrame([(q, s, m) for q, s, t in queries for m in rng.sample(words[:9], 3)], "query_id long, scope string, mark string")
    expanded = hits.selectExpr("query_id", "scope", "'wjx' as mark", "0.25D as weight").distinct()
    proof = hits.groupBy("query_id", "scope").agg({"mark": "min"}).toDF("query_id", "scope", "a").join(hits.groupBy("query_id").agg({"mark": "max"}).toDF("query_id", "b"), "query_id").selectExpr("*", "0.5D as weight")
    counts = spark.createDataFrame([("s", 101), ("t", 101)], "scope string, n long")
    g = SimpleNamespace(records=records, record_texts=R.record_texts(records, marks), queries=spark.createDataFrame(queries, "query_id long, scope string, text string"), counts=counts)
    g.ranked = R.ranked_candidates(hits, expanded, proof, marks)
    return g, {"hits": hits, "expanded": expanded, "evidence": proof}


def test_greedy_shuffles_few_candidates(spark, tmp_path, monkeypatch):
    """Every candidate of every query met all its terms in shuffles; now tasks leave those that may be chosen."""
    from markloom.operators import evidence

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    g, told = _graph(spark)
    monkeypatch.setattr(catalog, "TextGraph", SimpleNamespace(opened=lambda *_: g))
    rows = lambda: sorted((x.query_id, x.pick, x.record_id, round(x.utility, 9)) for x in catalog.evidence_greedy(spark, "").collect())
    want, every = rows(), g.ranked.count()
    pools = []
    cover = evidence.coverage
    monkeypatch.setattr(evidence, "coverage", lambda pool, *rest: pools.append(pool.count()) or cover(pool, *rest))
    del g.ranked
    vars(g).update(told)
    assert rows() == want and len(want) > 20
    few = evidence.foremost
    monkeypatch.setattr(evidence, "foremost", lambda *a: few(*a, block=9, queries=5))
    assert rows() == want
    assert pools[0] * 3 < every and pools[1] * 2 < every


def test_chunks_go_through_a_text_once(spark):
    """Each chunk was counted off from its text's start, so a text's chunks cost the square of its length."""
    from pyspark.sql import functions as F

    from markloom.functions import text as T

    texts = ["", None, " \n", "ab", "a😀b\nc" * 90 + "é", "x" * 400, "\n" * 400 + "y", "q\r\n " * 333]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").select("id", F.explode(T.fixed_chunks(F.col("text"))).alias("c"))
    want = [(i, k // 400, k, t[k : k + 400]) for i, t in enumerate(texts) if t for k in range(0, len(t), 400) if t[k : k + 400].strip()]
    assert sorted((r.id, *r.c) for r in df.collect()) == want
    assert "substring(text" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_marks_are_distinct_before_they_meet_queries(spark, monkeypatch):
    """All records' marks were read, judged and made distinct for each of three ways to meet a query."""
    kept = {}
    save = R.saved
    monkeypatch.setattr(R, "saved", lambda df, label: kept.setdefault(label, save(df, label)))
    marks = spark.createDataFrame([("s", i % 50, f"m{i % 3}") for i in range(200)] + [("s", 1, "x-y"), ("s", 2, "é")], "scope string, record_id long, mark string")
    queries = spark.createDataFrame([(1, "s", "m1 x-y"), (2, "s", "Été m0"), (3, "t", "m1")], "query_id long, scope string, text string")
    got = R.literal_matches(queries, marks)
    assert sorted((r.query_id, r.mark) for r in got.collect()) == [(1, "m1"), (1, "x-y"), (2, "m0"), (2, "é")]
    assert kept["known-marks"].count() == 5 and "Aggregate [scope" not in got.select("mark")._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_a_path_s_edges_are_shuffled_once(spark):
    """Edges were shuffled by path, by need and by contradiction, some ten times, and each issue read the inputs again."""
    from markloom.operators import meetings as M

    edge = lambda p, k, side=0, source="a", sign="positive": (p, side, k, source, "b", "r", sign, 0.0, 9.0, "s", ["e"])
    edges = [edge(1, 1, source="b"), edge(1, 2, source="b", sign="negative"), edge(1, 1, 1, "b")] + [edge(2, k) for k in range(40)] + [edge(3, 1), edge(3, 1, 1, "b")]
    needs = [(1, "b", "b", "r", "negative", 0.0, 1.0, None), (3, "a", "b", "r", "positive", None, None, None), (4, "a", "b", "r", "positive", None, None, None)]
    edges = spark.createDataFrame(edges, "path_id long, side int, position int, source string, target string, relation string, polarity string, since double, until double, scope string, evidence array<string>")
    needs = spark.createDataFrame(needs, "path_id long, source string, target string, relation string, polarity string, since double, until double, scope string")
    got = M.path_meetings(spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 4, None)], "path_id long"), edges, needs)
    want = [(1, "insufficient", "contradictory_polarity", None), (2, "budget_stop", "path_edges", None), (3, "pending_hypothesis", "", "b"), (4, "insufficient", "empty_path,required_edge_missing", None), (None, "pending_hypothesis", "", None)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning(path_id") <= 3 and plan.count("Exchange ") <= 3


def test_borders_are_judged_for_many_texts_at_once(monkeypatch):
    """Each text's characters were classed and its borders judged alone, which cost more than its search."""
    from markloom.operators import phrases as P

    rng = random.Random(2)
    names = ["ab", "a b", "b-c", "(ab)", "é", "ab.c"]
    texts = ["".join(rng.choice(["ab", " ", "a", "b-c", "(", ")", ".", "é", "\n", "c", "😀", "-"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    made, built, text = P.automaton(names), [], P.Text
    want = []
    for border in (P.standing_alone, P.within_words, P.within_compacts):
        for k, t in enumerate(texts):
            which, start, end = P.finds(made, t, True)
            if len(which):
                good = border(text(t, P.Classes()), start, end)
                want += [(border.__name__, k, *x) for x in zip(which[good].tolist(), start[good].tolist(), end[good].tolist(), strict=True)]
    monkeypatch.setattr(P, "Text", lambda *a: built.append(1) or text(*a))
    got = [(b.__name__, *map(int, x)) for b in (P.standing_alone, P.within_words, P.within_compacts) for x in zip(*P.places(texts, made, b, P.Classes(), True), strict=True)]
    assert got == want and len(want) > 100 and len(built) == 3
    assert [len(x) for x in P.places(["", "z"], made, P.within_words, P.Classes(), True)] == [0] * 4


def test_questions_of_one_small_file_are_many_tasks_work(spark, monkeypatch):
    """All questions of a small file were searched by one task."""
    from markloom.operators import grounding as G

    kept = {}
    save = G.saved
    monkeypatch.setattr(G, "saved", lambda df, label: kept.setdefault(label, save(df, label)))
    questions = spark.createDataFrame([(i, f"Is blue anvil {i} of kind?") for i in range(200)], "question_id long, text string").coalesce(1)
    concepts = spark.createDataFrame([(1, "blue anvil", "kind", "alloy")], "cid long, name string, coarse string, fine string")
    found = G.question_grounding(questions, concepts, spark.createDataFrame([(5, 1)], "member long, cid long")).collect()
    assert len(found) == 200 and all(r.reason is None for r in found)
    assert len(kept["questions"].inputFiles()) == spark.sparkContext.defaultParallelism
