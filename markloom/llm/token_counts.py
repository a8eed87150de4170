"""Token counts of a BPE piece model by rank-synchronous merging of ragged numpy arrays.

A text is cut into pre-tokens: a run of spaces and the word after it. No piece has a space after another
character, so no merge ever joins two pre-tokens (checked when the model is compiled). The distinct
pre-tokens of a batch lie in one flat array of symbols. A round finds the lowest rank among the pairs of
each sequence and applies it in all sequences at once, at every place of that pair from the left; then
only the pairs beside a merge are looked up again, and sequences without a pair leave. What survives is
counted: one token a symbol, or one for each byte of a character that the model lacks (byte fallback).

Merging all places of the lowest pair in one round equals merging them one by one as long as no merge
makes a pair of a lower or equal rank than its own. Pairs for which that may fail (runs of spaces, all of
one rank) merge one place a round.

A memo of bounded size keeps the counts of short pre-tokens. Long unspaced sequences are first cut
between characters that no piece has side by side.

Defined results: null and empty texts have 0 tokens; every row gives one row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_rows

LIMIT, MEMO, MEMO_CHARS = 4096, 250_000, 32
COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
_SPACED = re.compile(" +[^ ]*| *[^ ]+")
_NONE = np.int64(1) << 40


class PairTable:
    """(left, right) -> joined symbol, by open addressing in two arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]  # of several that want a slot, the last has it
            self.values[at[free]] = values[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The joined symbols, -1 where a pair joins to nothing."""
        at, out = self._slot(keys), np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        while len(left):
            seen = self.keys[at[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (seen >= 0)]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        return out


class Merger:
    """Compiled from (piece, rank) pairs; a space stands for the model's space mark."""

    def __init__(self, pieces: list[tuple[str, int]]):
        if any(" " in p.lstrip(" ") for p, _ in pieces):
            raise ValueError("a piece has a space after another character: pre-tokens are not independent")
        names = {p: i for i, (p, _) in enumerate(pieces)}
        self.rank = np.array([r for _, r in pieces], np.int64)
        self.n = len(pieces)
        keys, values = [], []
        for p, i in names.items():
            for k in range(1, len(p)):
                a, b = names.get(p[:k]), names.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.n + b)
                    values.append(i)
        self.join = PairTable(np.array(keys, np.int64), np.array(values, np.int64))
        made, parts = np.array(values, np.int64), np.array(keys, np.int64)
        # symbols whose own rank is not below that of every pair they are in: to be merged one place a round
        self.single = np.zeros(self.n, bool)
        for part in (parts // self.n, parts % self.n):
            bad = (np.array([len(p) for p, _ in pieces])[part] > 1) & (self.rank[part] >= self.rank[made])
            self.single[part[bad]] = True
        self.chars = np.full(0x110000, -1, np.int32)
        for p, i in names.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        beside = {p[i : i + 2] for p, _ in pieces for i in range(len(p) - 1)}
        self.beside = PairTable(np.array([ord(x[0]) << 21 | ord(x[1]) for x in beside], np.int64), np.ones(len(beside), np.int64))
        self.memo: dict[str, int] = {}

    def counts(self, sequences: list[str]) -> np.ndarray:
        """The number of tokens of each sequence (none of them empty)."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        points = np.frombuffer("".join(sequences).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        symbols = self.chars[points].astype(np.int64)
        unknown = symbols < 0
        size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        total = np.bincount(owner[unknown], weights=size[unknown], minlength=len(lengths)).astype(np.int64)
        # cut where two characters never stand side by side in a piece, and at unknown characters
        first = np.ones(len(points), bool)
        first[1:] = (owner[1:] != owner[:-1]) | unknown[1:] | unknown[:-1]
        near = np.flatnonzero(~first)
        first[near[self.beside(points[near - 1] << 21 | points[near]) < 0]] = True
        part = np.cumsum(first) - 1
        known = ~unknown
        symbols, part = symbols[known], part[known]
        whose = np.zeros(int(first.sum()), np.int64)
        whose[part] = owner[known]
        left = self._merge(symbols, part, len(whose))
        return total + np.bincount(whose, weights=left, minlength=len(lengths)).astype(np.int64)

    def _merge(self, symbols: np.ndarray, part: np.ndarray, n_parts: int) -> np.ndarray:
        """How many symbols survive in each part."""
        left = np.bincount(part, minlength=n_parts)
        joined = self._pairs(symbols, part, np.arange(max(0, len(symbols) - 1)))
        while len(symbols) > 1:
            rank = np.append(np.where(joined >= 0, self.rank[joined], _NONE), _NONE)
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            lengths = np.diff(np.append(starts, len(part)))
            least = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            live = least < _NONE
            if not live.all():  # the rest has nothing to merge
                symbols, part, rank, least = symbols[live], part[live], rank[live], least[live]
                joined = np.append(joined, -1)[live][:-1] if len(symbols) else joined[:0]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == least)
            after = np.append(False, (at[1:] == at[:-1] + 1) & (part[at[1:]] == part[at[:-1]]))
            if after.any():  # in a row of overlapping places every other one, from the left
                row = np.arange(len(at)) - np.maximum.accumulate(np.where(after, 0, np.arange(len(at))))
                at = at[row % 2 == 0]
            alone = self.single[joined[at]]
            if alone.any():
                at = at[~alone | np.append(True, part[at[1:]] != part[at[:-1]])]
            symbols[at] = joined[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            left -= np.bincount(part[at], minlength=n_parts)
            moved = np.cumsum(keep) - 1
            symbols, part = symbols[keep], part[keep]
            joined = np.append(joined, -1)[keep][:-1]
            fresh = moved[at]
            fresh = np.unique(np.concatenate([fresh, fresh - 1]))
            fresh = fresh[(fresh >= 0) & (fresh < len(symbols) - 1)]
            joined[fresh] = self._pairs(symbols, part, fresh)
        return left

    def _pairs(self, symbols: np.ndarray, part: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), -1, np.int64)
        same = part[at] == part[at + 1]
        out[same] = self.join(symbols[at[same]] * self.n + symbols[at[same] + 1])
        return out

    def totals(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text, with the model's leading space."""
        split = []
        for t in texts:
            t = " " + t.replace("▁", " ") if t else ""
            split.append(_SPACED.findall(t) if "  " in t or t[-1:] == " " else [" " + w for w in t[1:].split(" ")] if t else [])
        memo = self.memo
        missing = list({w for words in split for w in words if w not in memo})
        fresh = dict(zip(missing, self.counts(missing).tolist(), strict=True)) if missing else {}
        out = [sum([memo[w] if w in memo else fresh[w] for w in words]) for words in split]
        if len(memo) + len(fresh) > MEMO:
            memo.clear()
        memo.update((w, c) for w, c in fresh.items() if len(w) <= MEMO_CHARS and len(memo) < MEMO)
        return out


def read_pieces(path: str) -> list[tuple[str, int]]:
    """The mergeable pieces of a sentencepiece BPE model, their marks as spaces, with their ranks."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i).replace("▁", " "), int(-m.get_score(i))) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: bytes, tokens, and whether these are over the limit."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(Merger(read_pieces(path)))  # of the model's size, whatever the data

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        n = shared.value.totals(texts)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_rows(docs.select(F.col("doc_id").cast("bigint"), "text"), use, COUNTS)
