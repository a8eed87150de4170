"""Path meetings: known answers for every issue, and for nulls, ties and empty tables."""

import pytest

from markloom.operators import meetings as M

EDGE = "path_id long, side int, position int, source string, target string, relation string, polarity string, since double, until double, scope string, evidence array<string>"
NEED = "path_id long, source string, target string, relation string, polarity string, since double, until double, scope string"


def edge(side=0, position=1, source="a", target="b", relation="r", polarity="positive", since=0.0, until=9.0, scope="s", evidence=("e",)):
    return (1, side, position, source, target, relation, polarity, since, until, scope, None if evidence is None else list(evidence))


def need(source="a", target="b", relation="r", polarity="positive", since=1.0, until=2.0, scope="s"):
    return (1, source, target, relation, polarity, since, until, scope)


GIVEN = edge(side=1, source="b", target="c")
CASES = [
    ([edge(), GIVEN], [need()], ""),
    ([edge(), GIVEN], [need()] * 16, ""),
    ([edge(), GIVEN], [need()] * 17, "path_edges"),
    ([edge(position=k, source="b", target="b") for k in range(16)] + [GIVEN], [], "path_edges"),
    ([], [], "empty_path"),
    ([edge()], [], "empty_path"),
    ([edge(source=None), GIVEN], [need("z")], "invalid_identity_or_relation"),
    ([edge(relation="r" * 201), GIVEN], [], "invalid_identity_or_relation"),
    ([edge(polarity="maybe"), edge(side=1, source="b", scope=None)], [], "invalid_polarity_or_time,scope_unknown"),
    ([edge(until=None), GIVEN], [], "invalid_polarity_or_time"),
    ([edge(since=5.0, until=4.0), GIVEN], [], "invalid_polarity_or_time"),
    ([edge(until=float("inf")), GIVEN], [], "invalid_polarity_or_time"),
    ([edge(since=float("nan")), GIVEN], [], "invalid_polarity_or_time"),
    ([edge(scope=""), GIVEN], [], "invalid_scope"),
    ([edge(evidence=None), GIVEN], [], "missing_or_invalid_evidence"),
    ([edge(evidence=["e", None]), GIVEN], [], "missing_or_invalid_evidence"),
    ([edge(evidence=["e"] * 17), GIVEN], [], "missing_or_invalid_evidence"),
    ([edge(since=None, until=None), GIVEN], [], "time_unknown"),
    ([edge(scope="t"), GIVEN], [], "path_scope_conflict"),
    ([edge(until=1.0), edge(side=1, source="b", target="c", since=2.0)], [], "path_time_conflict"),
    ([edge(until=1.0), edge(side=1, source="b", target="c", since=1.0)], [], ""),
    ([edge(), edge(side=1, source="x")], [], "disconnected_or_direction_mismatch"),
    ([edge(source="b"), edge(position=2, source="b", polarity="negative"), GIVEN], [], "contradictory_polarity"),
    ([edge(source="b"), edge(position=2, source="b", polarity="negative", relation="q"), GIVEN], [], ""),
    ([edge(source="b", until=1.0), edge(position=2, source="b", polarity="negative", since=2.0), GIVEN], [], "path_time_conflict"),
    ([edge(), GIVEN], [need("b", "a")], "direction_mismatch"),
    ([edge(), GIVEN], [need("a", "c")], "required_edge_missing"),
    ([edge(), GIVEN], [need(relation="q")], "relation_mismatch"),
    ([edge(), GIVEN], [need(polarity="negative", since=None, until=None, scope=None)], "negation_mismatch"),
    ([edge(), GIVEN], [need(polarity="negative")], "negation_mismatch,scope_mismatch_or_unknown,time_mismatch_or_unknown"),
    ([edge(), GIVEN], [need(scope="t", since=None, until=None)], "scope_mismatch_or_unknown"),
    ([edge(), GIVEN], [need(since=-1.0)], "time_mismatch_or_unknown"),
    ([edge(), GIVEN], [need(None), need(since=3.0), need("a", "c")], "invalid_requirement,required_edge_missing"),
]


@pytest.fixture(scope="module")
def judged(spark):
    edges = [(n, *e[1:]) for n, (es, _, _) in enumerate(CASES) for e in es]
    needs = [(n, *w[1:]) for n, (_, ws, _) in enumerate(CASES) for w in ws]
    paths = [(n,) for n in range(len(CASES))] * 2
    rows = M.path_meetings(spark.createDataFrame(paths, "path_id long"), spark.createDataFrame(edges, EDGE), spark.createDataFrame(needs, NEED)).collect()
    assert len(rows) == len(CASES)
    return {r.path_id: r for r in rows}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_every_issue(judged, n):
    want = CASES[n][2]
    got = judged[n]
    assert got.issues == want
    assert got.status == ("budget_stop" if want == "path_edges" else "insufficient" if want else "pending_hypothesis")
    assert got.meeting == (None if want else "b")


def test_empty_tables(spark):
    made = lambda s: spark.createDataFrame([], s)
    assert M.path_meetings(made("path_id long"), made(EDGE), made(NEED)).collect() == []
