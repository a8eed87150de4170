"""Lifecycle grammars: a deterministic automaton run over each trace's events in order, however long a trace is.

Traces are dealt by ranges of (trace, order). A range's piece of a trace is a function from the state it is entered in to the state it is
left in, a short list; a trace's pieces are composed in order, which gives each piece its state of entry, and then every piece is judged on
its own. No task holds a trace, and a trace with a third of all events is spread over its ranges.

An event that its state doesn't allow is a violation, told with its place, the state and what was expected, and leaves the state as it
is. A trace whose beginning retention took away is entered in `UNKNOWN`, which allows every event of the grammar and is left by the first one
that leads to one state only. Events outside the grammar are passed over.

Defined results: null traces are one trace; ties of the order are for the caller to break; a trace without events of the grammar ends
where it was entered.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom.operators import ranges

UNKNOWN = "unknown"


@dataclass(frozen=True)
class Grammar:
    """moves: (state, event, next state); a trace is entered in `start` and whole in one of `ends`."""

    start: str
    moves: tuple[tuple[str, str, str], ...]
    ends: frozenset[str]

    @cached_property
    def states(self) -> list[str]:
        return sorted({s for a, _, b in self.moves for s in (a, b)} | {self.start, UNKNOWN})

    @cached_property
    def steps(self) -> dict[str, dict[str, str]]:
        """By event and state the next one, for allowed events only."""
        out: dict[str, dict[str, str]] = {}
        for a, event, b in self.moves:
            if out.setdefault(event, {}).setdefault(a, b) != b:
                raise ValueError(f"two ways from {a} by {event}")
        for event, ways in out.items():
            ways[UNKNOWN] = next(iter(set(ways.values()))) if len(set(ways.values())) == 1 else UNKNOWN
        return out

    def expected(self, state: str) -> list[str]:
        return sorted(e for a, e, _ in self.moves if a == state)


#: The order of a call's events, and of a turn's.
CALL = Grammar(
    "new",
    (("new", "call_start", "started"), ("started", "input_gate", "gated"), ("started", "call_rejected", "closed"), ("started", "call_end", "closed"), ("gated", "call_rejected", "closed"),
     ("gated", "http_request", "sent"), ("gated", "call_end", "closed"), ("sent", "http_response", "answered"), ("sent", "call_end", "closed"), ("answered", "call_end", "closed")),
    frozenset({"closed"}),
)
TURN = Grammar(
    "new",
    (("new", "turn_start", "started"), ("started", "retrieval_record", "retrieved"), ("retrieved", "reply_context", "asked"), ("asked", "answer_generated", "generated"), ("generated", "delivery_start", "sending"),
     ("sending", "answer_delivered", "delivered"), *((s, "turn_end", "ended") for s in ("started", "retrieved", "asked", "generated", "sending", "delivered"))),
    frozenset({"ended"}),
)


def _composed(states: list[str], moved: list[int] | None, ways: dict[str, str]) -> list[int]:
    """The list of states left in after one more event."""
    at = {s: i for i, s in enumerate(states)}
    return [at[ways.get(states[i], states[i])] for i in (moved if moved is not None else range(len(states)))]


def _pieces(parts: DataFrame, grammar: Grammar, trace: str, order: list[str]) -> DataFrame:
    """(range, trace, moved, entered): each piece as a function of states, and whether the trace may lack its beginning."""
    states, steps = grammar.states, grammar.steps

    def step(moved, row):
        ways = steps.get(row["event"])
        return (_composed(states, moved, ways) if ways else moved or list(range(len(states)))), []

    def end(moved, row):
        return [(row[ranges.PART], row[trace], moved, row["partial"])]

    kind = dict(parts.dtypes)[trace]
    return ranges.carried(parts, [ranges.PART, trace], order, step, f"{ranges.PART} int, {trace} {kind}, moved array<int>, partial boolean", end)


def _entries(pieces: DataFrame, grammar: Grammar, trace: str) -> DataFrame:
    """(range, trace, entered, left): the state in which each piece is entered and left."""
    states, start = grammar.states, grammar.start

    def step(state, row):
        entered = state or (UNKNOWN if row["partial"] else start)
        left = states[row["moved"][states.index(entered)]]
        return left, [(row[ranges.PART], row[trace], entered, left)]

    kind = dict(pieces.dtypes)[trace]
    return ranges.carried(pieces, [trace], [ranges.PART], step, f"{ranges.PART} int, {trace} {kind}, entered string, left string")


@dataclass(frozen=True)
class Run:
    """A grammar run over rows(trace, order, event): its violations and a verdict for each trace."""

    violations: DataFrame
    verdicts: DataFrame


def run(rows: DataFrame, grammar: Grammar, trace: str, order: list[str], partial: Column | None = None) -> Run:
    """partial: whether a row's trace may lack its beginning; the same for all rows of a trace.

    violations(trace, order, event, state, expected); verdicts(trace, events, violations, state, status), where status is invalid,
    complete, incomplete, or retention_partial."""
    own = rows.select(trace, *order, "event", (F.lit(False) if partial is None else F.coalesce(partial, F.lit(False))).alias("partial"))
    parts = ranges.ranged(own, [trace], order)
    entries = ranges.saved(_entries(_pieces(parts, grammar, trace, order), grammar, trace), "entries")
    steps, expected = grammar.steps, {s: ",".join(grammar.expected(s)) for s in grammar.states}

    def judge(state, row):
        state = state or row["entered"]
        ways = steps.get(row["event"])
        if ways is None or state in ways:
            return (ways[state] if ways else state), []
        return state, [(row[trace], *[row[c] for c in order], row["event"], state, expected[state])]

    kinds = dict(parts.dtypes)
    met = ranges.with_parts(parts, entries, [trace])
    found = ranges.carried(met, [ranges.PART, trace], order, judge, ", ".join(f"{c} {kinds[c]}" for c in (trace, *order)) + ", event string, state string, expected string")
    violations = ranges.saved(found, "violations")
    counted = parts.groupBy(F.col(trace).alias("_t")).agg(F.count("*").alias("events"), F.first("partial").alias("partial"))
    ended = entries.groupBy(F.col(trace).alias("_e")).agg(F.max_by("left", ranges.PART).alias("state"))
    broken = violations.groupBy(F.col(trace).alias("_v")).agg(F.count("*").alias("violations"))
    every = counted.join(ended, F.col("_t").eqNullSafe(F.col("_e"))).join(broken, F.col("_t").eqNullSafe(F.col("_v")), "left")
    bad = F.coalesce("violations", F.lit(0))
    status = F.when(bad > 0, "invalid").when(F.col("partial"), "retention_partial").when(F.col("state").isin(*sorted(grammar.ends)), "complete").otherwise("incomplete")
    return Run(violations, every.select(F.col("_t").alias(trace), "events", bad.alias("violations"), "state", status.alias("status")))
