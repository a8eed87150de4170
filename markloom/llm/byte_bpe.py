"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

The encoding of a string's prefix ends in exactly one token, and what stands before that token is again
the encoding of a prefix; two tokens may follow each other if and only if the merges leave their bytes
as just these two. So the transducer reads bytes left to right and knows, for each recent position,
the token that ends there. Of these, only positions matter from which a token may still grow. Their
paths back through the text meet at some position: the tokens before it are final and are emitted.
A state is thus (last token emitted, bytes since); it looks ahead no further than the longest token.
States and transitions are made when a text first needs them (`Transducer._step`), and are then dict
lookups. `STATES` bounds the states kept, later ones are made for the piece at hand. Words repeat, so a
bounded memo of two generations keeps what the transducer gave for short pieces.

Defined results: a null text encodes as an empty one; every row gives one row, repeated rows too.
Texts of any length are cut by the pattern as they are read; special tokens don't exist here.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, map_rows

STATES, MEMO, MEMO_BYTES = 300_000, 150_000, 48
DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class _State:
    """base: the token before; pending: bytes since; ends: the token that ends at each position of these, if
    any path reaches it; live: the positions where a token may still begin; rest: what the end of a piece emits."""

    __slots__ = ("base", "ends", "live", "next", "pending", "rest")

    def __init__(self, base: int, pending: bytes, ends: list, live: list[int], rest: bytes):
        self.base, self.pending, self.ends, self.live, self.rest, self.next = base, pending, ends, live, rest, {}


class Transducer:
    """encode(piece): the ids of a piece's bytes, each as 4 little-endian bytes."""

    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        self.ranks, self.limit = ranks, states
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.packed = {i: i.to_bytes(4, "little") for i in ranks.values()}
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.start = _State(-1, b"", [-1], [0], b"")
        self.states = {(-1, b""): self.start}

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes token, (-1, -1) for a single byte, None if the merges never make it."""
        if token in self.splits:
            return self.splits[token]
        whole = self.bytes_of[token]
        parts, made = [whole[i : i + 1] for i in range(len(whole))], (-1, -1)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                made = None
                break
            made = (self.ranks[parts[at]], self.ranks[parts[at + 1]])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self.splits[token] = made
        return made

    def _fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a (-1: the start): no merge ever joins bytes of both.

        Goes back in time: undoes the merges next to the border, latest first. The tokens x and y that meet
        at the border would have been joined if their merge ranks before the next merge of x or y (of equal
        ranks, the left one goes first).
        """
        if (found := self.pairs.get((a, b))) is not None:
            return found
        x, y, after_x, after_y = a, b, 1 << 60, 1 << 60
        found = self._split(b) is not None and (a < 0 or self._split(a) is not None)
        while found and a >= 0:
            rank = self.ranks.get(self.bytes_of[x] + self.bytes_of[y], 1 << 60)
            if rank < after_x and rank <= after_y and rank < 1 << 60:
                found = False
                break
            from_x, from_y = self._split(x), self._split(y)
            if from_x[0] < 0 and from_y[0] < 0:
                break
            if from_y[0] < 0 or from_x[0] >= 0 and x > y:
                after_x, x = x, from_x[1]
            else:
                after_y, y = y, from_y[0]
        if len(self.pairs) >= 2 * self.limit:
            self.pairs.clear()
        self.pairs[a, b] = found
        return found

    def _step(self, state: _State, byte: int) -> tuple[bytes, _State]:
        """The transition from state on byte: what it emits, and the state it leads to."""
        data, ends, ranks, size = state.pending + bytes((byte,)), state.ends, self.ranks, self.size
        n = len(data)
        for at in state.live:
            token = ranks.get(data[at:])
            if token is not None and self._fits(ends[at], token):
                break
        else:
            raise ValueError("the ranks hold no token for some byte")
        path, i = [n, at], at
        while i > 0:
            path.append(i := i - size[ends[i]])
        meet, live = n, [i for i in state.live if data[i:] in self.prefixes]
        for i in live:
            while i not in path:
                i -= size[ends[i]]
            meet = min(meet, i)
        last = lambda i: token if i == n else ends[i]
        path.reverse()
        cut = path.index(meet)
        emit = b"".join([self.packed[last(i)] for i in path[1 : cut + 1]])
        base = last(meet) if meet else state.base
        key = (base, data[meet:])
        if (after := self.states.get(key)) is None:
            kept: list = [None] * (n - meet + 1)
            for i in [*live, n]:  # the live positions and those on their paths
                while i > meet and kept[i - meet] is None:
                    kept[i - meet] = last(i)
                    i -= size[last(i)]
            kept[0] = base
            after = _State(base, data[meet:], kept, [i - meet for i in live] + [n - meet], b"".join([self.packed[last(i)] for i in path[cut + 1 :]]))
            if len(self.states) < self.limit:
                self.states[key] = after
        found = (emit, after)
        if len(self.states) < self.limit:  # else made for this piece only: the states met first are the common ones
            state.next[byte] = found
        return found

    def run(self, piece: bytes) -> bytes:
        state, out = self.start, []
        for byte in piece:
            step = state.next.get(byte)
            if step is None:
                step = self._step(state, byte)
            if step[0]:
                out.append(step[0])
            state = step[1]
        out.append(state.rest)
        return b"".join(out)

    def encode(self, piece: str) -> bytes:
        if (out := self.older.get(piece)) is not None:
            self.memo[piece] = out
            return out
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)  # the library takes a piece that is a token as it is
        out = self.run(data) if whole is None else self.packed[whole]
        if len(data) <= MEMO_BYTES:
            if len(self.memo) >= MEMO:
                self.older, self.memo = self.memo, {}
            self.memo[piece] = out
        return out

    def chunks(self, text: str, pattern: regex.Pattern, size: int = 1 << 16) -> Iterator[bytes]:
        """The ids of a text, some pieces at a time."""
        memo, out = self.memo, []
        if len(text) <= size:
            pieces = pattern.findall(text)
            yield b"".join([memo.get(p) or self.encode(p) for p in pieces])
            return
        for m in pattern.finditer(text):
            p = m.group()
            out.append(self.memo.get(p) or self.encode(p))
            if len(out) >= size:
                yield b"".join(out)
                out = []
        yield b"".join(out)


class Utf8Stream:
    """Decodes bytes as they come: holds back an unfinished character, which is all of its state."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes, last: bool = False) -> str:
        data, cut = self.held + data, 0
        if not last:
            for back in range(1, min(3, len(data)) + 1):
                lead = data[-back]
                if lead >= 0xC0:  # the start of a character: is it whole?
                    need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                    cut = back if back < need and lead < 0xF8 else 0
                    break
                if lead < 0x80:
                    break
        self.held = data[len(data) - cut :] if cut else b""
        return (data[: len(data) - cut] if cut else data).decode("utf-8", "replace")


class Codec:
    """What an executor keeps: the transducer, made when first used, and its pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.source, self.live = ranks, pattern, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"live": None}

    def parts(self) -> tuple[Transducer, regex.Pattern, list[bytes]]:
        if self.live is None:
            table = [b""] * (max(self.ranks.values()) + 1)
            for token, i in self.ranks.items():
                table[i] = token
            self.live = Transducer(self.ranks), regex.compile(self.source), table
        return self.live

    def encode(self, text: str | None) -> Iterator[bytes]:
        transducer, pattern, _ = self.parts()
        return transducer.chunks(text or "", pattern)

    def decode(self, ids: bytes) -> bytes:
        table = self.parts()[2]
        return b"".join([table[i] for i in memoryview(ids).cast("I")])


def broadcast_codec(spark: SparkSession, path: str, pattern: str):
    """The rank file has a fixed number of tokens, whatever the data: it is read here and sent to all."""
    bounded_batches(spark)
    return spark.sparkContext.broadcast(Codec(read_ranks(path), pattern))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs(doc_id, text) as (doc_id, ids array<int>)."""
    shared = broadcast_codec(docs.sparkSession, path, pattern)

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [memoryview(b"".join(shared.value.encode(t))).cast("I").tolist() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return map_rows(rows, use, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) as (doc_id, text), through the streaming decoder."""
    shared = broadcast_codec(encoded.sparkSession, path, pattern)

    def text(ids: list[int] | None) -> str:
        stream, table = Utf8Stream(), shared.value.parts()[2]
        return "".join(stream.feed(b"".join([table[i] for i in (ids or [])[at : at + 4096]])) for at in range(0, len(ids or []), 4096)) + stream.feed(b"", True)

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([text(x) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return map_rows(encoded.select(F.col("doc_id").cast("bigint"), "ids"), use, "doc_id bigint, text string")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: the number of its ids, their SHA-256 and that of the bytes they decode to."""
    shared = broadcast_codec(docs.sparkSession, path, pattern)

    def one(text: str | None) -> tuple[int, str, str]:
        n, ids_sha, out_sha, stream = 0, hashlib.sha256(), hashlib.sha256(), Utf8Stream()
        for ids in shared.value.encode(text):
            n += len(ids) // 4
            ids_sha.update(ids)
            out_sha.update(stream.feed(shared.value.decode(ids)).encode("utf-8"))
        out_sha.update(stream.feed(b"", True).encode("utf-8"))
        return n, ids_sha.hexdigest(), out_sha.hexdigest()

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, a, b = zip(*[one(t) for t in batch.column(1).to_pylist()], strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_rows(docs.select(F.col("doc_id").cast("bigint"), "text"), use, DIGEST)
