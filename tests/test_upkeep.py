"""Upkeep, lifecycles, bundles and batches against plain Python that works record by record."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from markloom.operators import bundles, conversation, eventlog, lifecycle, maintenance, ranges, upkeep


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small ranges stay ranges of their own, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rebuilt(records, before, at):
    """Every edge from the records themselves; before: what was stored, inactive edges too."""
    now = {}
    for scope in {s for s, _ in records}:
        own = {r: m for (s, r), m in records.items() if s == scope}
        n, f = len(own), Counter(x for m in own.values() for x in m)
        for a, b in {p for m in own.values() for p in combinations(sorted(m), 2)}:
            shown = frozenset(r for r, m in own.items() if a in m and b in m)
            beside = frozenset(x for r in shown for x in own[r]) - {a, b}
            p = len(shown) / n
            raw = 1.0 if p == 1 else math.log(p / (f[a] / n * (f[b] / n))) / -math.log(p)
            if raw > 0:
                now[scope, a, b] = (len(shown), round(raw, 4), shown, beside)
    out = {}
    for e in before.keys() | now.keys():
        old = before.get(e)
        if e not in now:
            out[e] = (old[0], False, old[2])
        elif old is None:
            out[e] = (now[e], True, at)
        else:
            out[e] = (now[e], True, old[2] if old[0] == now[e] else max(old[2], at))
    return out


@pytest.mark.parametrize("seed", [3, 8])
def test_deltas_equal_rebuilds(spark, seed):
    r = random.Random(seed)
    marks = [f"m{i}" for i in range(7)]
    draw = lambda: frozenset(r.sample(marks, r.randint(0, 4)))
    records, version, told = {}, None, {}
    for at in (10.0, 30.0, 20.0, 40.0):
        come = {(r.choice("st"), k): draw() for k in r.sample(range(60), 30 if version is None else 7)}
        gone = dict(r.sample(sorted(records.items()), min(len(records), 6)))
        gone |= {k: records[k] for k in come if k in records}
        for key in r.sample(sorted(gone), len(gone) // 2):  # goes and comes back as it was
            come.setdefault(key, gone[key])
        frame = lambda d, sign: [(s, k, sign) for s, k in d]
        flat = lambda d, sign: [(s, k, m, sign) for (s, k), ms in d.items() for m in ms]
        delta = spark.createDataFrame(frame(come, 1) + frame(gone, -1), "scope string, record_id long, sign int")
        moved = spark.createDataFrame(flat(come, 1) + flat(gone, -1), "scope string, record_id long, mark string, sign int")
        version = upkeep.advanced(version, delta, moved, at)
        records = {k: v for k, v in records.items() if k not in gone} | come
        told = rebuilt(records, told, at)
        got = {(e.scope, e.a, e.b): ((e.co_count, e.weight), e.active, e.last_updated) for e in version.edges.collect()}
        assert got == {k: (v[:2], on, t) for k, (v, on, t) in told.items()}
        assert {(c.scope, c.n) for c in version.counts.collect()} == set(Counter(s for s, _ in records).items())
        assert {(c.scope, c.mark, c.frequency) for c in version.frequency.collect()} == {(s, m, n) for (s, m), n in Counter((s, m) for (s, _), ms in records.items() for m in ms).items()}


def test_archiving_what_is_not_there_fails(spark):
    gone = spark.createDataFrame([("s", 1, -1)], "scope string, record_id long, sign int")
    marks = spark.createDataFrame([("s", 1, "a", -1)], "scope string, record_id long, mark string, sign int")
    with pytest.raises(Exception, match="more goes than there is"):
        upkeep.advanced(None, gone, marks, 1.0)
    empty = upkeep.advanced(None, gone.limit(0), marks.limit(0), 1.0)
    assert empty.edges.count() == 0


def walked(events, grammar, partial):
    moves, state, bad = {(a, e): b for a, e, b in grammar.moves}, "unknown" if partial else grammar.start, []
    for place, e in events:
        to = {b for (a, x), b in moves.items() if x == e}
        if not to:
            continue
        if state == "unknown":
            state = to.pop() if len(to) == 1 else state
        elif (state, e) in moves:
            state = moves[state, e]
        else:
            bad.append((place, e, state, ",".join(sorted(x for a, x in moves if a == state))))
    return state, bad


@pytest.mark.parametrize("grammar", [lifecycle.TURN, lifecycle.CALL])
def test_lifecycles(spark, grammar):
    r = random.Random(4)
    alphabet = sorted({e for _, e, _ in grammar.moves})
    right = {"turn_end": ["turn_start", "retrieval_record", "reply_context", "answer_generated", "delivery_start", "answer_delivered", "turn_end"], "call_end": ["call_start", "input_gate", "http_request", "http_response", "call_end"]}
    chain = next(v for v in right.values() if v[0] in alphabet)
    traces = {"hot": (False, [r.choice(alphabet) for _ in range(900)]), "whole": (False, chain), "cut": (True, chain[2:]), "open": (False, chain[:2]), None: (False, ["other", *chain]), "bad": (False, [*chain, chain[0]]), "aside": (False, ["other"])}
    traces |= {f"t{k}": (k % 3 == 0, [r.choice([*alphabet, "other"]) for _ in range(r.randint(1, 9))]) for k in range(40)}
    rows = [(t, i, e, p) for t, (p, es) in traces.items() for i, e in enumerate(es)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "trace string, seq long, event string, partial boolean")
    found = lifecycle.run(df, grammar, "trace", ["seq"], F.col("partial"))
    want, verdicts = set(), {}
    for t, (p, es) in traces.items():
        state, bad = walked(enumerate(es), grammar, p)
        want |= {(t, *b) for b in bad}
        verdicts[t] = (len(es), len(bad), state, "invalid" if bad else "retention_partial" if p else "complete" if state in grammar.ends else "incomplete")
    assert {(x.trace, x.seq, x.event, x.state, x.expected) for x in found.violations.collect()} == want
    assert {x.trace: (x.events, x.violations, x.state, x.status) for x in found.verdicts.collect()} == verdicts
    assert verdicts["whole"][3] == "complete" and verdicts["cut"][3] == "retention_partial" and verdicts["bad"][1] == 1
    assert ranges.ranged(df, ["trace"], ["seq"]).where("trace = 'hot'").select(ranges.PART).distinct().count() > 1
    none = lifecycle.run(df.limit(0), grammar, "trace", ["seq"])
    assert none.verdicts.count() == none.violations.count() == 0


def test_two_ways_are_refused():
    with pytest.raises(ValueError, match="two ways"):
        lifecycle.Grammar("a", (("a", "x", "b"), ("a", "x", "c")), frozenset("b")).steps  # noqa: B018


def test_running_and_carried(spark):
    r = random.Random(5)
    rows = [(r.choice(["hot"] * 8 + ["a", None]), k, r.choice([None, 1, 2])) for k in range(700)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    sums, seen = {}, Counter()
    for k, o, v in rows:
        seen[k] += v or 0
        sums[o] = (k, seen[k])
    assert {x.o: (x.k, x.s) for x in ranges.running(df, ["k"], ["o"], s=F.col("v")).collect()} == sums
    step = lambda s, row: ((s or 0) + (row["v"] or 0), [(row["o"], (s or 0) + (row["v"] or 0))])
    end = lambda s, row: [(-1, s)]
    got = [tuple(x) for x in ranges.carried(df, ["k"], ["o"], step, "o long, s long", end).collect()]
    assert {o: s for o, s in got if o >= 0} == {o: s for o, (_, s) in sums.items()}
    assert sorted(s for o, s in got if o < 0) == sorted(seen.values())


def test_long_chain_is_carried(spark):
    df = spark.range(25_000).select(F.lit("one").alias("log_id"), (F.col("id") + 1).alias("sequence"), F.lit("2024-01-01").alias("timestamp"), F.lit("e").alias("event"), F.to_json(F.struct("id")).alias("fields"))
    got = {x.sequence: (x.previous_hash, x.hash) for x in eventlog.chained(df).collect()}
    previous = eventlog.ZERO
    for n in range(1, 25_001):
        digest = eventlog.record_hash(n, "2024-01-01", "e", f'{{"id":{n - 1}}}', previous)
        assert got[n] == (previous, digest)
        previous = digest


def test_gate_over_many_ranges(spark):
    r = random.Random(6)
    rows = [("s", k, f"m{r.randrange(700)}", r.choice("abc"), r.random() < 0.8) for k in range(900)]
    rows = [(s, k, m, a if bot else "p", bot) for s, k, m, a, bot in rows]
    seen, used, want = set(), Counter(), {}
    for _, k, m, a, bot in rows:
        copy = m in seen
        seen.add(m)
        if not bot and not copy:
            used.clear()
        used[a] += bot and not copy
        want[k] = "duplicate" if copy else "round_limit" if bot and used[a] > 5 else None
    df = spark.createDataFrame(rows, "scope string, seq long, message_id string, author_id string, author_is_bot boolean")
    assert {x.seq: x.reason for x in conversation.bot_gate(df).collect()} == want


MATERIAL = "bundle_id long, round long, position int, scope string, record_id string, source_id string, original_sha256 string, normalized_sha256 string, fingerprint string, stored_text string, quote string"


def material(b, k, p, text, original="o"):
    return (b, k, p, "s", text, "src", original, None, "fp", text, f"“{text}”")


def test_bundles(spark):
    rows = [material(1, 0, 0, "x"), material(1, 0, 1, "y"), material(1, 2, 0, "y"), material(1, 2, 1, "z"), material(1, 3, 0, "x", "changed"), material(1, 3, 1, "x", "changed"), material(2, 0, 0, "x"), material(2, 0, 1, None)]
    materials = spark.createDataFrame(rows, MATERIAL)
    rounds = spark.createDataFrame([(1, k, f"r{k}", None if k == 0 else f"p{k}") for k in range(4)] + [(2, 0, "r0", None), (3, 0, "r0", None)], "bundle_id long, round long, request_id string, planning_call_id string")
    kept = bundles.bindings(materials)
    numbers = {(x.bundle_id, x["round"], x.position): x.citation for x in kept.collect()}
    assert numbers == {(1, 0, 0): 1, (1, 0, 1): 2, (1, 2, 0): 2, (1, 2, 1): 3, (1, 3, 0): 4, (1, 3, 1): 4, (2, 0, 0): 1, (2, 0, 1): 2}
    assert len({x.evidence_uid for x in kept.collect()}) == 5
    stored = bundles.rounds_of(rounds, kept)
    told = {(x.bundle_id, x["round"]): x for x in stored.collect()}
    assert told[1, 1].materials == 0 and told[1, 0].parent_sha256 is None and all(told[1, k].parent_sha256 == told[1, k - 1].bundle_sha256 for k in (1, 2, 3))
    assert bundles.violations(stored, kept, materials).count() == 0
    shorter = bundles.rounds_of(rounds.where("round < 2"), bundles.bindings(materials.where("round < 2")))
    assert {x.bundle_sha256 for x in shorter.collect()} <= {x.bundle_sha256 for x in told.values()}  # appending changes nothing before
    reasons = lambda *a: {(x.bundle_id, x["round"], x.reason) for x in bundles.violations(*a).collect()}
    other = spark.createDataFrame([material(1, 0, 0, "forged"), *rows[1:]], MATERIAL)
    assert {(1, 0, "binding"), (1, 1, "chain"), (1, 2, "chain"), (1, 3, "chain")} == reasons(stored, kept, other)
    assert reasons(stored, kept.where("round <> 2"), materials) == {(1, 2, "binding")}
    assert (1, 2, "round") in reasons(stored.where("round <> 1"), kept, materials)
    assert reasons(stored.limit(0), kept.limit(0), materials.limit(0)) == set()


def test_batches_go_on_where_they_were_cut(spark):
    r = random.Random(9)
    caps = {"call": {"input_tokens": 95, "output_tokens": 20, "seconds": 9}, "document": {"input_tokens": 420, "output_tokens": 90, "seconds": 60}, "batch": {"input_tokens": 1000, "output_tokens": 260, "seconds": 150}}
    blocks = [(b, doc, k, r.randint(1, 96), r.randint(1, 20), r.choice([1, 2, 9])) for b in range(14) for doc in range(r.randint(1, 4)) for k in range(r.randint(1, 9))]
    blocks += [(90, 0, 0, None, 1, 1), (91, 0, 0, -1, 1, 1), (92, 0, 0, 1, 1, 1)]

    def plain(rows, ended):
        out = {}
        for b in {x[0] for x in rows}:
            used, all_used, stopped = {}, [0] * 3, False
            for row in sorted((x for x in rows if x[0] == b), key=lambda x: (x[2] >= 3, x[1], x[2])):
                key, cost = row[:3], ended.get(row[:3], row[3:])
                known = all(c is not None and c >= 0 for c in row[3:])
                if key in ended:
                    state, why = "ended", None
                elif stopped:
                    state, why = "waits", None
                else:
                    own = [x + c for x, c in zip(used.get(row[1], [0] * 3), cost, strict=True)] if known else None
                    every = [x + c for x, c in zip(all_used, cost, strict=True)] if known else None
                    levels = [("call", cost), ("document", own), ("batch", every)] if known else []
                    over = [f"{n}_{res}" for n, sums in levels for res, s in zip(maintenance.RESOURCES, sums, strict=True) if s > caps[n][res]] if known else ["unknown_cost"]
                    state, why = ("stops", over[0]) if over else ("runs", None)
                    stopped = bool(over)
                used[row[1]] = [x + (c or 0) for x, c in zip(used.get(row[1], [0] * 3), cost, strict=True)]
                all_used = [x + (c or 0) for x, c in zip(all_used, cost, strict=True)]
                out[key] = (state, why)
        return out

    schema = "batch_id long, document_id long, block int, input_tokens long, output_tokens long, seconds long, ended struct<input_tokens: long, output_tokens: long, seconds: long>"
    ask = lambda ended: {(x.batch_id, x.document_id, x.block): (x.state, x.reason) for x in maintenance.admitted(spark.createDataFrame([(*x, ended.get(x[:3])) for x in blocks], schema), caps).collect()}
    whole = ask({})
    assert whole == plain(blocks, {})
    assert {"runs", "stops", "waits"} == {s for s, _ in whole.values()} and len({w for _, w in whole.values()}) > 4
    cost = {x[:3]: x[3:] for x in blocks}
    cut = {k: cost[k] for k, (s, _) in whole.items() if s == "runs" and k[0] % 2 == 0}
    again = ask(cut)  # those blocks ended and used what was reserved: the rest is decided as before
    assert {k: v for k, v in again.items() if k not in cut} == {k: v for k, v in whole.items() if k not in cut}
    cheap = {k: tuple(c // 2 for c in v) for k, v in cut.items()}
    assert ask(cheap) == plain(blocks, cheap)
    states = maintenance.batch_states(maintenance.admitted(spark.createDataFrame([(*x, None) for x in blocks], schema), caps))
    assert {x.batch_id: x.reason for x in states.collect()}[90] == "unknown_cost"


def test_the_first_version_shuffles_no_context_by_pair(spark, monkeypatch):
    """Three marks of a record were six rows beside its pairs, and each pair was written with all of its record's marks."""
    kept = {}
    save = upkeep.saved
    monkeypatch.setattr(upkeep, "saved", lambda df, label: kept.setdefault(label, save(df, label)))
    marks = spark.createDataFrame([("s", r, m, 1) for r in range(5) for m in "abcde"], "scope string, record_id long, mark string, sign int")
    first = upkeep.advanced(None, marks.select("scope", "record_id", "sign").distinct(), marks, 1.0)
    assert "delta-pairs" not in kept and kept["delta-sets"].count() == 5 and first.beside.count() == 10


def test_a_pair_that_is_gone_returns_as_it_was(spark):
    rows = [("s", r, m, 1) for r, ms in {1: "abx", 2: "abx", 3: "ac", 4: "bd", 5: "e", 6: "f"}.items() for m in ms]
    marks = spark.createDataFrame(rows, "scope string, record_id long, mark string, sign int")
    of = lambda df: df.select("scope", "record_id", "sign").distinct()
    moved = lambda ids, sign: marks.where(F.col("record_id").isin(ids)).withColumn("sign", F.lit(sign))
    version = upkeep.advanced(None, of(marks), marks, 1.0)
    told = lambda v: {(e.a, e.b): (e.active, e.last_updated) for e in v.edges.collect()}["a", "b"]
    gone = upkeep.advanced(version, of(moved([1, 2], -1)), moved([1, 2], -1), 2.0)
    assert told(gone) == (False, 1.0)
    again = moved([1, 2], 1)
    assert told(upkeep.advanced(gone, of(again), again, 3.0)) == (True, 1.0)
    other = again.withColumn("mark", F.when((F.col("mark") == "x") & (F.col("record_id") == 2), "y").otherwise(F.col("mark")))
    assert told(upkeep.advanced(gone, of(other), other, 3.0)) == (True, 3.0)
