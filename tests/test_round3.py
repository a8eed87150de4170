"""Findings of round 3: work that grew with more than its input."""

import random

import pytest

from markloom.functions.text import lazy_decay
from markloom.operators import dynamics, phrases


def test_equal_decays_are_worked_out_once():
    dynamics.decayed.cache_clear()
    assert {dynamics.fold(0.5, [], 700) for _ in range(1000)} == {lazy_decay(0.5, 700)}
    assert dynamics.decayed.cache_info().misses == 1


BORDERS = [phrases.standing_alone, phrases.within_words, phrases.within_compacts]


@pytest.mark.parametrize("border", BORDERS)
def test_runs_are_what_the_automaton_finds(border):
    """Over texts of signs that borders look at, ends of texts included."""
    rng, words, classes = random.Random(7), ["a", "ab", "abc", "b", "ba", "zz"], phrases.Classes()
    texts = ["".join(rng.choice("aab  bz.z()[]{}-+_é7\n·\u200d\U0001d7d8") for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    row, named, start, end = phrases.runs(texts, border, classes)
    got = {(r, w, s, e) for r, w, s, e in zip(row.tolist(), named.to_pylist(), start.tolist(), end.tolist(), strict=True) if w in words}
    made, want = phrases.automaton(words), set()
    for r, text in enumerate(texts):
        which, s, e = phrases.finds(made, text, False)
        if len(which):
            good = border(phrases.Text(text, classes), s, e)
            want |= {(r, words[i], a, z) for i, a, z in zip(which[good].tolist(), s[good].tolist(), e[good].tolist(), strict=True)}
    assert got == want and len(want) > 50


def test_plain_phrases_need_no_parts(spark, monkeypatch):
    """A dictionary over the limit was scanned part by part, each over all texts again."""
    asked = []
    parts = phrases._parts
    monkeypatch.setattr(phrases, "_parts", lambda df, limit: asked.append(df.count()) or parts(df, limit))
    texts = spark.createDataFrame([(1, "one two, three"), (2, ""), (3, None), (4, "two-two x two")], "id int, text string")
    known = spark.createDataFrame([("one",), ("two",), ("three",), ("two, three",), ("",), (None,)], "phrase string")
    got = {tuple(r) for r in phrases.phrase_spans(texts, known, limit=340).collect()}
    assert got == {(1, "one", 0, 3), (1, "two", 4, 7), (1, "three", 9, 14), (1, "two, three", 4, 14), (4, "two", 10, 13)}
    assert asked == [1]


def test_an_alias_form_is_worked_out_a_name_not_an_occurrence(spark, monkeypatch):
    """A filter on forms went below the grouping of names."""
    names = spark.createDataFrame([("models",), ("model",), ("models",), ("gas",)], "name string")
    kept = []
    save = phrases.saved
    monkeypatch.setattr(phrases, "saved", lambda df, label: kept.append(label) or save(df, label))
    got = sorted(tuple(r) for r in phrases.alias_canon(names, names).collect())
    assert got == [("gas", "gas"), ("model", "model"), ("models", "model"), ("models", "model")]
    assert kept == ["alias-forms"]


def test_candidates_are_placed_without_a_shuffle_of_them(spark):
    """The rows and places are those of the grouped form, over several ranges of records; only what stands beside them is shuffled."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from markloom.operators import retrieval as R

    rng = random.Random(5)
    marks = spark.createDataFrame([(s, i, m) for s in "xy" for i in range(300) for m in sorted({f"m{rng.randrange(12)}" for _ in range(4)})], "scope string, record_id long, mark string")
    hits, more, pairs = [], [], []
    for q in range(40):
        s, own = rng.choice("xy"), rng.sample(range(14), 6)
        hits += [(q, s, f"m{m}") for m in own[: q % 5]]
        more += [(q, s, f"m{m}", rng.randrange(1, 4) / 10) for m in own[4 : 4 + q % 3]]
        pairs += [(q, s, min(f"m{a}", f"m{b}"), max(f"m{a}", f"m{b}"), 0.1) for a, b in [(own[0], own[1])] if q % 5 > 1]
    hits = spark.createDataFrame(hits, "query_id long, scope string, mark string")
    more = spark.createDataFrame(more, "query_id long, scope string, mark string, weight double")
    pairs = spark.createDataFrame(pairs, "query_id long, scope string, a string, b string, weight double")
    order = W.partitionBy("query_id").orderBy(F.col("direct").desc(), F.col("score").desc(), F.col("record_id").desc())
    want = R.ranked_candidates(hits, more, pairs, marks)
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = R.placed_candidates(hits, more, pairs, marks, block=50)
    assert rows(got) == rows(want.withColumn("rank", F.row_number().over(order))) and got.count() > 1000
    assert rows(R.placed_candidates(hits, more, pairs, marks, placed=False)) == rows(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FlatMapGroupsInArrow") < plan.index("Exchange")


def _sets(spark):
    rng = random.Random(3)
    rows = [(s, i, f"c{rng.randrange(8)}", sorted({f"m{rng.randrange(12)}" for _ in range(4)})) for s in "xy" for i in range(60)]
    sets = spark.createDataFrame(rows, "scope string, record_id long, source_id string, m array<string>")
    return sets, sets.selectExpr("scope", "record_id", "explode(m) as mark", "source_id")


def test_sources_of_pairs_meet_no_table_of_records(spark):
    """Pairs met a table of all records, which was broadcast as long as its file was small."""
    from markloom.operators import diagnostics, graph

    sets, marks = _sets(spark)
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = diagnostics.sources_of_pairs(sets)
    assert rows(got) == rows(diagnostics.pair_sources(graph.pair_evidence(marks), sets)) and got.count() > 50
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_listings_weigh_listed_marks_alone(spark, monkeypatch):
    """The whole graph was derived for the first nodes, which need no edge, and for edges between these."""
    from markloom.operators import diagnostics, graph

    _, marks = _sets(spark)
    counts = graph.record_counts(marks.select("scope", "record_id").distinct())
    edges, rows = graph.npmi_edges(marks, counts), lambda df: sorted(map(str, df.collect()))
    nodes = diagnostics.node_listing(marks, edges, 5)
    assert rows(diagnostics.node_listing(marks, limit=5)) == rows(nodes)
    want = rows(diagnostics.edge_listing(graph.pair_support(marks), edges, nodes))
    monkeypatch.setattr(diagnostics, "node_listing", lambda m, limit=5, first=diagnostics.node_listing: first(m, limit=limit))
    supported = []
    monkeypatch.setattr(graph, "pair_support", lambda m, first=graph.pair_support: supported.append(m.select("scope", "mark").distinct().count()) or first(m))
    assert rows(diagnostics.listed_edges(marks, counts)) == want and len(want) > 5
    assert supported == [10]


def test_native_order_broadcasts_no_candidates(spark):
    """Candidates met the bound records by a join, for which Spark broadcast every query's candidates."""
    from markloom.operators import audit

    ranked = spark.createDataFrame([(1, 7, 2), (1, 8, 1), (2, 7, 1), (None, 7, 1), (3, 9, 1)], "query_id long, cid long, rank int")
    bindings = spark.createDataFrame([(7, 10), (7, 11), (8, 12), (8, 11)], "cid long, record_id long")
    candidates = spark.createDataFrame([(1, 10, 1), (1, 11, 3), (1, 12, 2), (1, 13, 4), (2, 11, None), (None, 10, 1), (3, 10, 1)], "query_id long, record_id long, native_rank int")
    got = audit.native_order(ranked, bindings, candidates)
    assert sorted(map(tuple, got.collect())) == [(1, 10, 3), (1, 11, 2), (1, 12, 1), (2, 11, 1)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_identities_are_written_as_bytes(spark, monkeypatch):
    """A digest of 64 letters went through every shuffle of a bundle's materials."""
    from markloom.operators import bundles

    kept = {}
    save = bundles.saved
    monkeypatch.setattr(bundles, "saved", lambda df, label: kept.setdefault(label, save(df, label)))
    texts = ", ".join(f"{c} string" for c in bundles._IDENTITY)
    rows = spark.createDataFrame([(1, r, 0, *[f"{x}"] * 8) for r, x in enumerate("abca")], f"bundle_id long, round long, position int, {texts}")
    got = bundles.bindings(rows)
    assert dict(kept["identities"].dtypes)["evidence_uid"] == "binary" and dict(got.dtypes)["evidence_uid"] == "string"
    want = [r.u for r in rows.select("round", bundles.identity().alias("u")).orderBy("round").collect()]
    assert [(r["round"], r.evidence_uid, r.citation) for r in got.orderBy("round").collect()] == [(k, u, c) for k, (u, c) in enumerate(zip(want, (1, 2, 3, 1), strict=True))]
