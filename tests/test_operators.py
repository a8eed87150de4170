"""Known answers and plain Python twins for the operators."""

import datetime
import math
import random
import zipfile
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from markloom.functions import text as T
from markloom.operators import analytics, conversation, dynamics, eventlog, evidence, files, graph, ledger
from markloom.operators import retrieval as R
from markloom.sources import files as sources


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def facts(spark, by_record, scope="s"):
    """marks and records of {name: marks}."""
    rows = list(enumerate(by_record.items()))
    marks = frame(spark, [(scope, i, m, name) for i, (name, ms) in rows for m in ms], "scope string, record_id long, mark string, source_id string")
    records = frame(spark, [(scope, i, name, " ".join(ms) or "-") for i, (name, ms) in rows], "scope string, record_id long, source_id string, text string")
    return marks, records


def ask(spark, by_record, *texts, scope="s", asked="s"):
    marks, records = facts(spark, by_record, scope)
    queries = frame(spark, [(i, asked, t) for i, t in enumerate(texts)], "query_id long, scope string, text string")
    edges = graph.directed_edges(graph.npmi_edges(marks, graph.record_counts(records)))
    rows = R.retrieve(queries, records, marks, edges, graph.pair_context(marks)).collect()
    return [{r.source_id for r in rows if r.query_id == i} for i in range(len(texts))]


def test_positive_and_negative_npmi(spark):
    marks, records = facts(spark, {"ab1": ["alpha", "beta"], "ab2": ["alpha", "beta"], "ac": ["alpha", "gamma"], "c": ["gamma"]})
    edges = {(r.a, r.b): (r.co_count, r.weight) for r in graph.npmi_edges(marks, graph.record_counts(records)).collect()}
    assert edges == {("alpha", "beta"): (2, 0.415)}
    assert {(r.a, r.b) for r in graph.pair_support(marks).collect()} == {("alpha", "beta"), ("alpha", "gamma")}
    assert {r.record_id for r in graph.pair_evidence(marks).where("b = 'beta'").collect()} == {0, 1}


def test_a_pair_in_every_record_weighs_one(spark):
    marks, records = facts(spark, {"x": ["a", "b"]})
    assert graph.npmi_edges(marks, graph.record_counts(records)).head().weight == 1.0


def test_scopes_are_apart(spark):
    assert ask(spark, {"source-a": ["alpha", "beta"]}, "alpha beta", scope="a", asked="b") == [set()]


def test_word_borders(spark):
    found = ask(spark, {"named": ["bot"]}, "robot", "botanical", "bot2", "_bot", "BOT!", "a (bot)")
    assert found == [set()] * 4 + [{"named"}] * 2


def test_marks_of_other_scripts_are_substrings(spark):
    found = ask(spark, {"cat": ["猫"], "is": ["is"]}, "黑猫警长", "Iſ it", "犬")
    assert found == [{"cat"}, {"is"}, set()]


def test_context_gate(spark):
    by = {"context": ["alpha", "beta", "gamma"], "beta-only": ["beta"], "unrelated": ["unrelated"]}
    assert ask(spark, by, "alpha", "alpha gamma") == [{"context"}, {"context", "beta-only"}]


def test_one_hop_only(spark):
    by = {"ab": ["alpha", "beta"], "bc": ["beta", "gamma"], "c": ["gamma", "delta"], "z1": ["z"], "z2": ["z"]}
    assert ask(spark, by, "alpha") == [{"ab", "bc"}]


def test_references_are_cut(spark):
    records = frame(spark, [("s", i, "x", "y" * 200) for i in range(6)], "scope string, record_id long, source_id string, text string")
    ranked = frame(spark, [(1, "s", i, 1, 0, 0.0) for i in range(6)], "query_id long, scope string, record_id long, direct int, extra int, score double")
    rows = sorted(R.references(ranked, records).collect(), key=lambda r: r.rank)
    assert [r.record_id for r in rows] == [5, 4, 3]
    assert all(len(r.text) == 110 and r.text.endswith("…") and r.truncated for r in rows)


def test_stored_facts_come_once(spark):
    new = frame(spark, [("s", "a", "t", "q"), ("s", "a", "t", "q"), ("s", "b", "t", "q")], "scope string, source_id string, text string, quote string")
    first = graph.insert_new(new.limit(0).withColumn("fingerprint", F.lit("")), new)
    assert first.count() == 2
    assert graph.insert_new(first, new).count() == 0
    stored = first.withColumn("active", F.lit(True)).withColumn("archived_at", F.lit(None).cast("double"))
    after = graph.deactivate(stored, frame(spark, [("s", "a")], "scope string, source_id string"), 5.0)
    assert {(r.source_id, r.active, r.archived_at) for r in after.collect()} == {("a", False, 5.0), ("b", True, None)}


def test_dictionary_keeps_ids(spark):
    marks, _ = facts(spark, {"x": ["b", "a"]})
    first = graph.mark_dictionary(marks).persist()
    more, _ = facts(spark, {"x": ["b", "a", "c", "d"]})
    before = {r.label: r.id for r in first.collect()}
    after = {r.label: r.id for r in graph.mark_dictionary(more, first).collect()}
    assert sorted(after.values()) == [1, 2, 3, 4] and {k: after[k] for k in before} == before


@pytest.mark.parametrize("seed", range(3))
def test_dynamic_fold_is_the_sequential_one(spark, seed):
    rng = random.Random(seed)
    static = {("a", "b"): 0.4151, ("b", "c"): 0.3333}
    events = [(i, rng.sample("abcd", rng.randint(0, 3))) for i in range(1, 60)]
    weights = dict(static)
    for _, marks in events:
        weights = {k: round(w * 0.99, 6) for k, w in weights.items()}
        for pair in combinations(sorted(marks), 2):
            weights[pair] = round(weights.get(pair, 0.0) + 1.0, 6)
    s = frame(spark, [("s", *k, w) for k, w in static.items()], "scope string, a string, b string, weight double")
    e = frame(spark, [("s", i, float(i)) for i, _ in events] * 2, "scope string, event_id long, observed_at double")  # each comes twice
    h = frame(spark, [("s", i, m) for i, ms in events for m in ms], "scope string, event_id long, mark string")
    assert {(r.a, r.b): r.weight for r in dynamics.dynamic_weights(s, e, h).collect()} == weights


def some_log(spark, n=6):
    rows = [("l", i, f"2026-01-01T00:00:{i:02d}Z", "event", '{"k":%d}' % i) for i in range(1, n + 1)]
    return eventlog.chained(frame(spark, rows, "log_id string, sequence long, timestamp string, event string, fields string"))


def test_hash_chain(spark):
    log = spark.createDataFrame(some_log(spark).collect())
    reasons = lambda df: {(r.sequence, r.reason) for r in eventlog.chain_violations(df).collect()}
    assert reasons(log) == set()
    assert reasons(log.withColumn("fields", F.when(F.col("sequence") == 3, '{"k":9}').otherwise(F.col("fields")))) == {(3, "hash")}
    assert reasons(log.where("sequence <> 3")) == {(4, "sequence")}
    assert reasons(log.withColumn("fields", F.when(F.col("sequence") == 2, '{"k":NaN}').otherwise(F.col("fields")))) == {(2, "hash")}


def test_retention_takes_the_cutoff_itself(spark):
    now = datetime.datetime(2026, 1, 2, 12)
    at = lambda h: now - datetime.timedelta(hours=h)
    rows = frame(spark, [("t", at(25)), ("t", at(24)), ("t", at(23)), ("u", at(1)), ("u", at(-1))], "trace_id string, ts timestamp")
    assert {r.ts for r in eventlog.retained(rows, now).collect()} == {at(23), at(1)}
    assert {(r.trace_id, r.removed, r.kept, r.partial) for r in eventlog.retention_split(rows, now).collect()} == {("t", 2, 1, True), ("u", 0, 2, False)}


def test_replays_and_conflicts(spark):
    rows = frame(spark, [("s", 1, "q"), ("s", 1, "q"), ("s", 2, "q"), ("s", 2, "other"), ("s", 3, "q")], "scope string, event_id long, query string")
    assert {(r.event_id, r.kind) for r in eventlog.replayed(rows).collect()} == {(1, "replay"), (2, "conflict")}


GATE = [("s", i, f"m{i}", "bot", True) for i in range(1, 8)] + [("s", 8, "m8", "human", False), ("s", 9, "m9", "bot", True), ("t", 10, "m10", "bot", True), ("t", 11, "m11", "human", False)]
GATE_SCHEMA = "scope string, seq long, message_id string, author_id string, author_is_bot boolean"


def test_bot_gate(spark):
    rows = {r.seq: r for r in conversation.bot_gate(frame(spark, [*GATE, ("s", 12, "m9", "bot", True)], GATE_SCHEMA)).collect()}
    assert [rows[i].allowed for i in range(1, 12)] == [True] * 5 + [False] * 2 + [True] * 4
    assert rows[6].reason == "round_limit" and rows[12].reason == "duplicate"


def test_streamed_gate_is_the_batch_one(spark, tmp_path):
    from markloom.streaming import state

    for part in (GATE[:4], GATE[4:]):
        frame(spark, part, GATE_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(GATE_SCHEMA).parquet(str(tmp_path / "in"))
    run = state.gate_bots(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = {(r.seq, r.allowed) for r in conversation.bot_gate(frame(spark, GATE, GATE_SCHEMA)).collect()}
    assert {(r.seq, r.allowed) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == batch


def test_compaction_takes_whole_oldest_turns(spark):
    rows = [("c", i, f"t{i // 2}", "user", "x" * 36) for i in range(10)]  # each costs 100, a turn 200
    df = frame(spark, rows, "conv_id string, seq long, turn_id string, role string, content string")
    assert {r.group_no for r in conversation.compaction_prefix(df, 900).collect()} == {1, 2}
    assert conversation.compaction_prefix(df, 1000).count() == 0


EDGES = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 1.0), ("a", "d", 0.5), ("d", "e", 1.5)]


def matrix():
    nodes = sorted({n for a, b, _ in EDGES for n in (a, b)})
    m = np.zeros((len(nodes), len(nodes)))
    for a, b, w in EDGES:
        m[nodes.index(a), nodes.index(b)] = m[nodes.index(b), nodes.index(a)] = w
    return nodes, m


def test_walk_and_exponentials(spark):
    nodes, m = matrix()
    edges = frame(spark, EDGES, "a string, b string, weight double")
    seeds = frame(spark, [(1, "a"), (1, "e")], "case_id int, node string")
    p0 = np.array([0.5 * (n in "ae") for n in nodes])
    p = p0
    for _ in range(12):
        p = 0.5 * p0 + 0.5 * (p / m.sum(0)) @ m
    walk = {r.node: r.score for r in analytics.walk_with_restart(edges, seeds, steps=12).collect()}
    assert np.allclose([walk[n] for n in nodes], p, atol=1e-12)
    rho, term, total = m.sum(0).max(), p0, p0
    for k in range(1, 21):
        term = term @ m / rho / k
        total = total + term
    found = {r.node: r.score for r in analytics.truncated_exponential(edges, seeds).collect()}
    assert np.allclose([found[n] for n in nodes], total, atol=1e-12)
    values, vectors = np.linalg.eigh(m)
    exact = vectors @ np.diag(np.exp(values)) @ vectors.T @ p0
    graphs = analytics.communicability(edges.withColumn("graph_id", F.lit(7)), seeds.select(F.lit(7).alias("graph_id"), "node"))
    assert np.allclose([{r.node: r.score for r in graphs.collect()}[n] for n in nodes], exact, atol=1e-9)


def test_ranked_cases_in_five_ways(spark):
    nodes, m = matrix()
    label = {n: "xy"[i % 2] for i, n in enumerate(nodes)}
    often = {n: i * 5 % 7 for i, n in enumerate(nodes)}
    cases = {1: ("a", "e", "y"), 2: ("ab", "", "x"), 3: ("c", "cd", "y"), 4: ("", "a", "x")}
    group = lambda k: frame(spark, [(c, n) for c, v in cases.items() for n in v[k] * 2], "case_id int, node string")
    got = analytics.rank_cases(frame(spark, [(n, label[n], often[n]) for n in nodes], "node string, label string, frequency long"), frame(spark, EDGES, "a string, b string, weight double"), group(0), group(1), frame(spark, [(c, v[2]) for c, v in cases.items()], "case_id int, label string"))

    def spread(seeds, alpha):
        p0 = np.array([(n in seeds) / len(set(seeds)) for n in nodes])
        p = total = p0
        for k in range(1, 41 if alpha else 21):
            p = 0.5 * p0 + 0.5 * (p / m.sum(0)) @ m if alpha else p @ m / m.sum(0).max() / k
            total = total + p
        return p if alpha else total

    want = []
    for c, (a, b, wanted) in cases.items():
        if not a:
            continue
        scores = {"frequency": [float(often[n]) for n in nodes]}
        for name, alpha in (("alpha", True), ("beta", False)):
            scores[f"{name}_nomeet"] = spread(a + b, alpha)
            if b:
                scores[f"{name}_meet"] = np.sqrt(spread(a, alpha) * spread(b, alpha))
        for variant, s in scores.items():
            pool = sorted((-round(float(x), 9), n) for n, x in zip(nodes, s, strict=True) if label[n] == wanted and n not in a + b)[:10]
            want += [(c, variant, i, n, -x) for i, (x, n) in enumerate(pool, 1)]
    found = sorted(tuple(r) for r in got.collect())
    assert [r[:4] for r in found] == [r[:4] for r in sorted(want)] and len(want) > 20
    assert np.allclose([r[4] for r in found], [r[4] for r in sorted(want)], atol=2e-9)


@pytest.mark.parametrize("seed", range(2))
def test_simple_paths_by_brute_force(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted(rng.sample(range(8), 2))) for _ in range(14)})
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)

    def paths(at):
        if len(at) > 1 and at[-1] in (5, 6):
            yield tuple(map(str, at))
        if len(at) <= 4:
            for n in near[at[-1]] - set(at):
                yield from paths([*at, n])

    edges = frame(spark, [(str(a), str(b), 1.0) for a, b in pairs], "a string, b string, weight double")
    starts = frame(spark, [(1, "0")], "case_id int, node string")
    ends = frame(spark, [(1, "5"), (1, "6")], "case_id int, node string")
    assert {tuple(r.path) for r in analytics.simple_paths(edges, starts, ends).collect()} == set(paths([0]))


def test_text_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).head().x
    assert one(T.normalize(F.lit("the  Descrip-\ntor of Electronic-Temperature "))) == "the descriptor of electronic temperature"
    assert one(T.normalize(F.lit("Straße ﬁn–de"))) == "strasse fin de"
    assert one(T.contains_normal(F.lit("cat"), F.lit("the catalyst"))) is False
    assert one(T.contains_normal(F.lit("ho*"), F.lit("a ho* species"))) is True
    assert one(T.contains_normal(F.lit("ho*"), F.lit("a hoo* species"))) is False
    assert one(T.focus_terms(F.lit("Hello. What is the binding energy? Please answer briefly"))) == ["binding", "energy"]
    assert one(T.metadata_kind(F.lit("[1] A. Smith 2001\n[2] B. Jones 2003"))) == "bibliography"
    assert one(T.citations(F.lit("so [M1], and [M12]; not [X3]"))) == [1, 12]
    assert one(T.terminal_safe(F.lit("a\x1b[0m\nb"))) == "a?[0m\nb"
    assert one(T.cost_nano(F.lit(1), F.lit(0), "3.0000005", "0")) == 3001
    assert [tuple(c) for c in one(T.fixed_chunks(F.lit("ab cd   "), 3))] == [(0, 0, "ab "), (1, 3, "cd ")]
    assert one(T.canonical(F.lit("  Straße "))) == "strasse"
    assert math.isclose(one(T.idf(F.lit(9), F.lit(4))), 1 + math.log(2))


def test_overlapping_pieces_merge(spark):
    whole = "".join(chr(97 + i % 26) for i in range(90))
    merge = lambda a, i, b, j: spark.range(1).select(evidence.merged_overlap(F.lit(a), F.lit(i), F.lit(b), F.lit(j)).alias("x")).head().x
    assert merge(whole[:60], 0, whole[30:], 30) == whole
    assert merge(whole[:50], 0, whole[30:], 30) is None
    assert merge(whole[:60], 0, "!" + whole[31:], 30) is None


def test_spans_ledgers_and_conflicts(spark):
    pages = frame(spark, [(1, 1, 0, 10), (1, 2, 10, 20), (1, 3, 21, 30)], "doc_id long, page int, start int, end int")
    assert [(r.page, r.before) for r in files.span_violations(pages).collect()] == [(3, 20)]
    calls = frame(spark, [("s", "settled", 10, 12), ("s", "open", 30, None), ("s", "settled", 10, 5)], "session_id string, status string, reserved long, cost long")
    assert ledger.ledger_violations(calls).count() == 1
    state = ledger.budget_state(calls, frame(spark, [("s", 47), ("t", 1)], "session_id string, ceiling long"))
    assert {(r.session_id, r.remaining, r.halted) for r in state.collect()} == {("s", 0, True), ("t", 1, False)}


def test_scan(spark, tmp_path):
    root = tmp_path / "files"
    (root / "deep").mkdir(parents=True)
    (root / "a.md").write_bytes(b"\xef\xbb\xbfhello")
    (root / "deep" / "b.TXT").write_bytes(b"\xff\xfe")
    (root / "c.pdf").write_bytes(b"%PDF")
    (root / "d.exe").write_bytes(b"no")
    rows = {r.path.rsplit("/", 1)[1]: (r.state, r.text) for r in sources.scan(spark, str(root)).collect()}
    assert rows == {"a.md": ("ready", "hello"), "b.TXT": ("not_utf8", None), "c.pdf": ("needs_conversion", None)}
    with pytest.raises(ValueError, match="more than 2 files"):
        sources.scan(spark, str(root), max_files=2)


def test_log_files_and_archives(spark, tmp_path):
    path = str(tmp_path / "log")
    sources.write_log(some_log(spark).coalesce(1), path)
    (tmp_path / "log" / "broken.json").write_text("not json\n")
    back = sources.read_log(spark, path)
    assert [r.broken for r in back.where("broken is not null").collect()] == ["not json"]
    assert eventlog.chain_violations(back.where("broken is null").withColumn("log_id", F.lit("l"))).count() == 0
    archive = str(tmp_path / "x.zip")
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("rows.jsonl", '{"a":1}\n{"a":2}\n')
    assert [r.line for r in sources.read_zipped_lines(spark, archive).orderBy("line_no").collect()] == ['{"a":1}', '{"a":2}']
    with pytest.raises(Exception, match="pinned"):
        sources.read_zipped_lines(spark, archive, {"rows.jsonl": "0" * 64}).count()
