"""Conversation structure repair: damaged role sequences are parsed at the least cost of edits.

Grammar of role initials, right-linear, so that an item needs no origin (its only parent is the start symbol's chain):

    E -> s S | u U | (nothing)      S -> u U      U -> a A      A -> u U | (nothing)

which is (s?(ua)+)?. Error productions stand beside them: delete reads a row and stays where it is (3), rerole reads a row as user
or assistant whatever its role (2), insert passes a user or assistant without reading a row (2). A kept or reroled row that is
truncated costs 1 more; blank and duplicate rows can only be deleted. A chart set holds, for each symbol after a dot, the least
(cost, audit) that leads there; the audit is the edits' initials, compared as ASCII. All audits of one cost that have read the same
rows differ before either ends, so the least prefix stays the least. A chart that ends in E or A is complete.

Rows go by (turn, role, text), nulls first. Equal rows are counted before anything moves; then rows are dealt out by ranges of
(conversation, turn, role, first characters) and cut into chunks of at most `chunk_rows` rows, so a conversation of any length
is spread over tasks. A chunk that may continue a conversation is parsed from each symbol it may begin with; one pass
chains the chunks' charts, holding nothing but audits, and one hashes the repaired texts in order as they stream by (a SHA-256 of a
conversation is sequential by definition).

Defined results: null ids, turns, roles and texts are one space in the damage's key, roles and texts; rows of null ids are
one conversation; repeated rows are duplicates of each other; conversations without rows give zeros, an empty audit
and the empty string's hash; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import bounded_batches, cut, give_back

CHUNK_ROWS, CHUNK_CHARS = 256, 1 << 20
DELETE, REROLE, INSERT, LATE = 3, 2, 2, 1
GRAMMAR = {"E": (("s", "S"), ("u", "U")), "S": (("u", "U"),), "U": (("a", "A"),), "A": (("u", "U"),)}
START, FINAL = "E", ("E", "A")
#: Terminals that rerole and insert may make.
MADE = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
_SPACE = " \t\n\x0b\x0c\r"

Chart = dict[str, tuple[int, str]]


class Row(NamedTuple):
    initial: str
    dead: bool  # blank or duplicate
    late: bool  # truncated


def _offer(chart: Chart, symbol: str, cost: int, audit: str) -> bool:
    if symbol in chart and chart[symbol] <= (cost, audit):
        return False
    chart[symbol] = cost, audit
    return True


def predicted(chart: Chart) -> Chart:
    """chart with all that insert productions reach from it."""
    todo = list(chart)
    while todo:
        symbol = todo.pop()
        cost, audit = chart[symbol]
        todo += [after for terminal, after in GRAMMAR[symbol] if terminal in MADE and _offer(chart, after, cost + INSERT, audit + "I")]
    return chart


def scanned(chart: Chart, row: Row) -> Chart:
    """The next chart set: row is deleted, kept or reroled."""
    out: Chart = {}
    for symbol, (cost, audit) in chart.items():
        _offer(out, symbol, cost + DELETE, audit + "D")
        if not row.dead:
            for terminal, after in GRAMMAR[symbol]:
                if row.initial == terminal:
                    _offer(out, after, cost + LATE * row.late, audit + "K")
                elif terminal in MADE:
                    _offer(out, after, cost + REROLE + LATE * row.late, audit + "R")
    return predicted(out)


def parse(rows: list[Row], start: str = START) -> Chart:
    """The last chart set over rows, from one symbol."""
    chart = predicted({start: (0, "")})
    for row in rows:
        chart = scanned(chart, row)
    return chart


def completed(chart: Chart) -> tuple[int, str]:
    return min(chart[x] for x in FINAL if x in chart)


def edited(audit: str, roles: list[str], texts: list[str], state: str = START) -> tuple[list[tuple[str, str]], str]:
    """The repaired (role, text) rows that an audit makes of rows, and the symbol after them."""
    out, rows = [], zip(roles, texts, strict=True)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        terminal, after = next((t, a) for t, a in GRAMMAR[state] if (role[:1] == t if edit == "K" else t in MADE))
        out.append((role if edit == "K" else MADE[terminal], text))
        state = after
    return out, state


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the rows after damage, equal ones once with their number."""
    conv, turn = F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint")
    key = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn"), (F.crc32(key.cast("binary")) % 20).alias("fault"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    fault, role, text = F.col("fault"), F.col("role"), F.col("text")
    rows = rows.where(fault != 0).select("conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"), F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(fault == 3, 2).otherwise(1).alias("n"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


_CHUNK = "conv_id bigint, seq bigint, fresh boolean, initials array<string>, marks string, digests array<binary>, first_turn bigint, last_turn bigint, n_turns bigint, roles array<string>, texts array<string>"


class _Chunk:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv: int | None, seq: int, fresh: bool):
        self.conv, self.seq, self.fresh, self.chars = conv, seq, fresh, 0
        self.turns: list[int] = []  # distinct, not null
        self.roles, self.texts, self.marks, self.digests = [], [], [], []

    def add(self, turn: int | None, role: str, text: str, digest: bytes, mark: str) -> None:
        if turn is not None and turn not in self.turns[-1:]:
            self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.marks.append(mark)
        self.digests.append(digest)
        self.chars += len(text)

    def row(self) -> tuple:
        ends = (self.turns[0], self.turns[-1]) if self.turns else (None, None)
        return self.conv, self.seq, self.fresh, [r[:1] for r in self.roles], "".join(self.marks), self.digests, *ends, len(self.turns), self.roles, self.texts


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 64) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _streamed(df: DataFrame, f, schema: str) -> DataFrame:
    """df.mapInArrow for a generator over the rows of a partition, in their order."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from _batches(f(rows), arrow)

    return df.mapInArrow(over, schema)


def _mark(text: str) -> str:
    left = text.rstrip(_SPACE)
    return "b" if not left else "o" if left[-1] in ".!?" else "t"


def _chunked(chunk_rows: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    part, no, now = TaskContext.get().partitionId(), 0, None
    for conv, turn, role, text, n in rows:
        digest, mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest(), _mark(text)
        for copy in range(n):
            if now is None or now.conv != conv or len(now.roles) >= chunk_rows or now.chars >= CHUNK_CHARS:
                fresh = now is not None and now.conv != conv
                if now:
                    yield now.row()
                now, no = _Chunk(conv, (part << 32) + no, fresh), no + 1
            now.add(turn, role, "" if copy else text, digest, mark)  # a further copy is deleted, its text never read
    if now:
        yield now.row()


_CHART = "conv_id bigint, seq bigint, starts array<string>, ends array<string>, costs array<bigint>, audits array<string>, figures array<bigint>, edges array<string>, turns array<bigint>"


def _charted(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv, seq, fresh, initials, marks, first_turn, last_turn, n_turns, again in rows:
        gone = set(again or ())
        seen = [Row(x, m == "b" or i in gone, m == "t" and i not in gone) for i, (x, m) in enumerate(zip(initials, marks, strict=True))]
        found = [(start, end, *best) for start in (START if fresh else GRAMMAR) for end, best in parse(seen, start).items()]
        starts, ends, costs, audits = zip(*found, strict=True)
        blank = marks.count("b")
        figures = [blank, sum(r.dead for r in seen) - blank, sum(r.late for r in seen), sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))]
        yield conv, seq, starts, ends, costs, audits, figures, [initials[0], initials[-1]], [first_turn, last_turn, n_turns]


class _Path(NamedTuple):
    cost: int
    parent: _Path | None
    piece: str


def _pieces(a: _Path | None, until: _Path | None = None) -> list[str]:
    out = []
    while a is not None and a is not until:
        out.append(a.piece)
        a = a.parent
    return out[::-1]


def _less(a: _Path, b: _Path) -> bool:
    """Whether a comes before b; both have as many pieces."""
    if a.cost != b.cost:
        return a.cost < b.cost
    x, y = a, b
    while x is not y and x is not None:  # to where they part
        x, y = x.parent, y.parent
    return _pieces(a, x) and "".join(_pieces(a, x)) < "".join(_pieces(b, y))


_PIECE = "conv_id bigint, seq bigint, kind int, audit string, cost bigint, figures array<bigint>, gaps bigint"


def _chained(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of each conversation's charts: a piece of the best audit for every chunk; the first bears the figures."""
    conv, seqs, ways = None, [], {}
    figures, last, turns = [0] * 4, "", [None, None, 0]

    def told() -> Iterator[tuple]:
        best = None
        for symbol in FINAL:
            if (way := ways.get(symbol)) and (best is None or _less(way, best)):
                best = way
        gaps = 0 if turns[0] is None else turns[1] - turns[0] + 1 - turns[2]
        for i, (seq, piece) in enumerate(zip(seqs, _pieces(best), strict=True)):
            yield conv, seq, 1, piece, None if i else best.cost, None if i else figures, None if i else gaps

    for this, seq, starts, ends, costs, audits, more, edges, own in rows:
        if not seqs or this != conv:
            if seqs:
                yield from told()
            conv, seqs, ways = this, [], {START: _Path(0, None, "")}
            figures, last, turns = [0] * 4, None, [None, None, 0]
            root = ways[START]
        after: dict[str, _Path] = {}
        for start, end, cost, audit in zip(starts, ends, costs, audits, strict=True):
            if start in ways:
                way = ways[start]
                new = _Path(way.cost + cost, None if way is root else way, audit)
                if end not in after or _less(new, after[end]):
                    after[end] = new
        figures = [a + b for a, b in zip(figures, more, strict=True)]
        figures[3] += last is not None and last + edges[0] not in LEGAL
        if own[0] is not None:
            turns = [own[0] if turns[0] is None else turns[0], own[1], turns[2] + own[2] - (turns[1] == own[0])]
        last, ways = edges[1], after
        seqs.append(seq)
    if seqs:
        yield from told()


_RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _hashed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of each conversation: its figures, its audit and the hash of its repaired rows; a piece of audit comes before its chunk."""
    conv, begun = None, False
    pieces, told, state, sha, first = [], (0, [0] * 4, 0), START, hashlib.sha256(), True

    def result() -> tuple:
        cost, figures, gaps = told
        return conv, gaps, *figures, cost, "".join(pieces), sha.hexdigest()

    for this, _, kind, audit, cost, figures, gaps, roles, texts in rows:
        if not begun or this != conv:
            if begun:
                yield result()
            conv, begun = this, True
            pieces, told, state, sha, first = [], (0, [0] * 4, 0), START, hashlib.sha256(), True
        if kind == 1:
            pieces.append(audit)
            if figures is not None:
                told = cost, figures, gaps
        elif kind == 2:
            lines, state = edited(pieces[-1], roles, texts, state)
            for role, text in lines:
                sha.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                first = False
    if begun:
        yield result()


def _chunks(conversations: DataFrame, chunk_rows: int) -> DataFrame:
    """The chunks of all conversations, numbered in order by seq, written to the shared folder."""
    spark = conversations.sparkSession
    bounded_batches(spark, 64)
    rows = damaged(conversations)
    order = ["conv_id", "turn", "role"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    return cut(_streamed(dealt, partial(_chunked, chunk_rows), _CHUNK), "roles")


def _pieces_of(chunks: DataFrame) -> DataFrame:
    """The best audit's piece of every chunk."""
    rows = chunks.select("conv_id", "seq", F.posexplode("digests").alias("i", "digest"))
    at = F.struct("seq", "i")
    first = rows.groupBy(F.col("conv_id").alias("of_conv"), F.col("digest").alias("of_digest")).agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = rows.join(first, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("digest") == F.col("of_digest"))).where(at != F.col("first"))
    again = again.groupBy(F.col("seq").alias("of_seq")).agg(F.collect_list("i").alias("again"))  # a chunk's rows at most
    slim = chunks.drop("roles", "texts", "digests").join(again, F.col("seq") == F.col("of_seq"), "left").drop("of_seq")
    charts = _streamed(slim, _charted, _CHART)
    return _streamed(charts.repartition("conv_id").sortWithinPartitions("conv_id", "seq"), _chained, _PIECE)


def report(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per conversation: gaps, faults, the cheapest repair's cost and audit, and the repaired rows' hash."""
    chunks = _chunks(conversations, chunk_rows)
    pieces = _pieces_of(chunks).withColumns({"roles": F.lit(None).cast("array<string>"), "texts": F.lit(None).cast("array<string>")})
    bare = lambda kind: [F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("audit"), F.lit(None).cast("bigint").alias("cost"), F.lit(None).cast("array<bigint>").alias("figures"), F.lit(None).cast("bigint").alias("gaps")]
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().select("conv_id", F.lit(-1).cast("bigint").alias("seq"), *bare(0), F.lit(None).cast("array<string>").alias("roles"), F.lit(None).cast("array<string>").alias("texts"))
    texts = chunks.select("conv_id", "seq", *bare(2), "roles", "texts")
    together = ids.union(pieces).union(texts)
    return _streamed(together.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "kind"), _hashed, _RESULT)


_REPAIRED = "conv_id bigint, role string, text string, position bigint"


def repaired(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(conv_id, position, role, text): the repaired rows themselves, as report() hashes them."""
    chunks = _chunks(conversations, chunk_rows)
    pieces = _pieces_of(chunks).select("conv_id", "seq", "kind", "audit", F.lit(None).cast("array<string>").alias("roles"), F.lit(None).cast("array<string>").alias("texts"))
    texts = chunks.select("conv_id", "seq", F.lit(2).alias("kind"), F.lit(None).cast("string").alias("audit"), "roles", "texts")

    def rows_of(rows: Iterator[tuple]) -> Iterator[tuple]:
        conv, audit, state, at, begun = None, "", START, 0, False
        for this, _, kind, piece, roles, said in rows:
            if not begun or this != conv:
                conv, state, at, begun = this, START, 0, True
            if kind == 1:
                audit = piece
                continue
            lines, state = edited(audit, roles, said, state)
            for role, text in lines:
                yield conv, role, text, at
                at += 1

    return _streamed(pieces.union(texts).repartition("conv_id").sortWithinPartitions("conv_id", "seq", "kind"), rows_of, _REPAIRED)
