"""Findings of round 4: tables that were sent whole, and caps that had no exact way for the rest."""

import re

import duckdb

from markloom import catalog
from markloom.operators import graph
from markloom.operators import retrieval as R


def _sent(df):
    """What a plan sends to every task: the lines below each broadcast."""
    lines, out = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    depth = lambda line: len(re.match(r"[\s:+\-|*(\d)]*", line).group().split("(")[0])
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = lines[i + 1 :]
            stop = next((k for k, x in enumerate(below) if depth(x) <= depth(line)), len(below))
            out.append("\n".join(below[:stop]))
    return out


def _marks(spark, records=40):
    rows = [("st"[i % 2], i, f"m{(i * k * 7 + k) % 23:02d}") for i in range(records) for k in range(1, 7)]
    return spark.createDataFrame(rows, "scope string, record_id long, mark string").distinct()


def test_pairs_of_records_are_not_sent(spark, tmp_path, monkeypatch):
    """All records' pairs were sent to every task, since Spark took them for as small as the records' written marks."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    marks = _marks(spark)
    pairs = [(s, f"m{a:02d}", f"m{b:02d}") for s in "stu" for a in range(23) for b in range(a + 1, 23) if (a + b) % 3] * 30
    asked = spark.createDataFrame(pairs, "scope string, a string, b string")
    want = {(r.scope, r.a, r.b, r.record_id, tuple(r.m)) for r in graph.pairs(marks).collect() if (r.scope, r.a, r.b) in set(pairs)}
    for most in (None, 0):
        found = graph.records_of(marks, asked) if most is None else graph._met(marks, asked.distinct(), most)
        assert not [x for x in _sent(found) if "Generate" in x]
        assert sorted((r.scope, r.a, r.b, r.record_id, tuple(r.m)) for r in found.collect()) == sorted(want) and want


def test_words_of_queries_are_not_sent(spark, tmp_path):
    """Each word of each query was sent to every task with the query's whole text."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    texts = ["alpha beta-2 gamma", "Beta alpha.one one", "naïve café gamma_x", "", None, "ſtop alpha"]
    spark.createDataFrame([(i, "st"[i % 2], t) for i, t in enumerate(texts)], "query_id long, scope string, text string").write.parquet(f"{tmp_path}/queries")
    queries = spark.read.parquet(f"{tmp_path}/queries")
    marks = ["alpha", "beta-2", "alpha.one", "gamma", "café", "stop", "-.-"] + [f"w{i}" for i in range(3000)]
    known = spark.createDataFrame([(s, m) for s in "st" for m in marks], "scope string, mark string")
    found = R.literal_matches(queries, known)
    assert not [x for x in _sent(found) if "Generate" in x]
    got = sorted((r.query_id, r.scope, r.mark) for r in found.collect())
    assert got == [(0, "s", "alpha"), (0, "s", "beta-2"), (0, "s", "gamma"), (1, "t", "alpha"), (1, "t", "alpha.one"), (2, "s", "café"), (5, "t", "alpha"), (5, "t", "stop")]


def test_orders_count_with_all_marks(spark, tmp_path):
    """Marks beyond an order's first eight were left out, and so were their pairs."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    d = str(tmp_path / "in")
    for name in ("documents", "labels", "benchmark", "conversations"):
        spark.createDataFrame([(1,)], "x int").write.parquet(f"{d}/{name}.parquet")
    spark.createDataFrame([(i, f"Brand#{i + 1}", f"TYPE {i:02d}") for i in range(8)], "p_partkey long, p_brand string, p_type string").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(1, i) for i in range(8)] + [(2, 6), (2, 7), (3, 0)], "l_orderkey long, l_partkey long").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(k, "O", k) for k in (1, 2, 3)], "o_orderkey long, o_orderstatus string, o_custkey long").write.parquet(f"{d}/orders.parquet")
    con = duckdb.connect()
    for name in ("part", "lineitem", "orders"):
        con.execute(f"create view {name} as select * from read_parquet('{d}/{name}.parquet/*.parquet')")
    for name in ("effective_edges", "npmi_diagnostics"):
        twin = con.execute(catalog.ORACLES[name])
        columns = [c[0] for c in twin.description]
        rows = lambda found: sorted(repr([round(x, 7) if isinstance(x, float) else x for x in r]) for r in found)
        assert rows(catalog.QUERIES[name](spark, d).select(*columns).collect()) == rows(twin.fetchall())
    assert catalog.npmi_diagnostics(spark, d).head().supported_pairs == 15 * 14 // 2  # an order of 8 parts, without brand#1


def test_groups_and_pieces_are_worked_out_once(spark, tmp_path):
    """A question's groups were worked out in a filter, too, and for each use, by one task; pieces were merged for each use."""
    from markloom.operators import selection as S

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    questions = spark.createDataFrame([(i, "s", f"What is the value of alpha rate (AR) and beta {i}?") for i in range(20)], "query_id long, scope string, text string")
    names = spark.createDataFrame([(i, "alpha rate") for i in range(20)], "query_id long, mark string")
    groups = S.concept_groups(questions, names)
    assert "lambdafunction" not in groups._jdf.queryExecution().executedPlan().toString()
    assert {(r.query_id, r.basis) for r in groups.collect()} >= {(i, "explicit_question_acronym") for i in range(20)}
    plans = S.question_plans(questions, S.weighted_concepts(groups, names.selectExpr("'s' as scope", "mark", "1L as df").distinct(), spark.createDataFrame([("s", "beta", 2)], "scope string, term string, df long"), spark.createDataFrame([("s", 9)], "scope string, n long")))
    rows = [(1, "s", r, "d", "v", r, 0, r, "The alpha rate is 7 beta.", [r], []) for r in (1, 2)]
    met = S.covered(S.merged(spark.createDataFrame(rows, S._PIECE)), plans)
    assert "MapInArrow" not in met._jdf.queryExecution().executedPlan().toString()
    assert [(r.record_id, r.members, r.eligible) for r in met.collect()] == [(1, [1, 2], True)]


def test_a_new_version_joins_no_edges_to_earlier_ones(spark, monkeypatch):
    """Each version's support was merged by pair, and its edges were then joined to all edges before, also by pair."""
    from markloom.operators import upkeep

    plans, save = [], upkeep.saved
    monkeypatch.setattr(upkeep, "saved", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or save(df, label))
    marks = spark.createDataFrame([("s", r, m, 1) for r, ms in {1: "abx", 2: "abx", 3: "ac", 4: "bd", 5: "e"}.items() for m in ms], "scope string, record_id long, mark string, sign int")
    own = lambda df: df.select("scope", "record_id", "sign").distinct()
    first = upkeep.advanced(None, own(marks), marks, 1.0)
    gone = marks.where("record_id = 2").selectExpr("scope", "record_id", "mark", "-1 as sign")
    second = upkeep.advanced(first, own(gone), gone, 2.0)
    assert not [p for p in plans if "FullOuter" in p]
    assert {(e.a, e.b): (e.co_count, e.active, e.last_updated) for e in second.edges.collect()}["a", "x"] == (1, True, 2.0)
