"""Substring deduplication with suffix arrays.

Texts are UTF-8 bytes. A byte goes if a string of `LENGTH` (100) bytes that covers it also starts earlier:
in a document of a smaller doc_id, or earlier in the same one. Strings are judged on the input.

Candidates. Every window of 100 bytes has an anchor: the least hash among its 24-byte grams. Equal windows
have equal anchors, so a window whose anchor occurs once in the corpus is unique. Consecutive windows
with one anchor form a fragment (256 windows at most), named by its anchor and by a hash of its bytes.
Anchors are counted over the whole corpus; only fragments of anchors with two places or more go on.

Pre-aggregation. Of fragments with the same bytes only the earliest goes on; every other one starts
later by definition, so all of its windows go. That keeps copies of texts, however many, out of the sort.

Shards. The fragments left are dealt by anchor, so equal windows meet in one task, which sorts whole
buckets in shards of `SHARD` bytes: suffixes start in order of their first 8 bytes and are refined by
Larsson-Sadakane doubling (8, 16, 32, 64 bytes, then 100 as two overlapping 64), where only groups that are
still tied are sorted again. Common prefixes of neighbours in the order: a common prefix of 100 bytes or
more is what counts, so the doubled ranks give it for all neighbours at once (Kasai's scan visits them one
after the other). Of each class of equal windows all but the earliest go. A bucket above the shard size is
sorted in several shards, and their orders are merged by binary search of each class in the other shards.
Buckets of over `HOT` different fragments are not gathered at all: their windows meet by 128-bit digest in
an aggregation and a join, which spread.

Defined results: null and empty texts have no bytes; a null doc_id comes last; rows of one doc_id are
ordered by the hash of their text, and rows that also share the text are one document. Texts of any
length are worked on in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, map_rows

LENGTH, GRAM, RUN, BLOCK, SHARD, HOT = 100, 24, 256, 1 << 19, 1 << 20, 40_000
_WIDTH = LENGTH - GRAM + 1
_LAST = (1 << 63) - 1
_B = 0x9E3779B97F4A7C15
_ANCHORS = "v bigint, c bigint, d bigint, t bigint, a int, r int, places int"
_SPANS = "d bigint, t bigint, a int, r int"
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, BLOCK + 2 * LENGTH)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_B, pow(_B, -1, 1 << 64))]
    return _powers


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xCA5A826395121157)
    return h ^ (h >> np.uint64(32))


def anchors(x: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """Fragments of bytes x: anchor, bytes' hash, first window, windows, and 2 if the anchor has several places in it, else 1.

    valid: for each window start, whether the window is one (lies in one text)."""
    if len(x) < LENGTH:
        return (*[np.zeros(0, np.uint64)] * 2, *[np.zeros(0, np.int64)] * 3)
    power, inverse = _power_tables(len(x) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * inverse[: len(x)])])
    gram = _mix((total[GRAM:] - total[:-GRAM]) * power[: len(x) - GRAM + 1])
    least, width = gram, 1
    while 2 * width <= _WIDTH:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[: len(least) - (_WIDTH - width)], least[_WIDTH - width :])
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(new)
    end = np.flatnonzero(valid & ~np.append(valid[1:] & ~new[1:], False)) + 1
    runs = end - starts
    pieces = -(-runs // RUN)
    first = np.repeat(starts, pieces) + RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    r = np.minimum(RUN, np.repeat(end, pieces) - first)
    v, to = least[first], first + r + LENGTH - 1
    c = _mix((total[to] - total[first]) * power[first] + r.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    view = np.lib.stride_tricks.sliding_window_view(gram, _WIDTH)
    leftmost = first + (view[first] == v[:, None]).argmax(1)
    last = first + r - 1
    rightmost = last + _WIDTH - 1 - (view[last] == v[:, None])[:, ::-1].argmax(1)
    return v, c, first, r, 1 + (leftmost != rightmost)


def _anchor_rows(keyed: DataFrame) -> DataFrame:
    def use(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts, buffer, meta, held = [], [], [], 0

        def flush() -> None:
            nonlocal held
            if not buffer:
                return
            x = np.frombuffer(b"".join(buffer), np.uint8)
            ends = np.cumsum([len(b) for b in buffer])
            begins = ends - [len(b) for b in buffer]
            owner = np.repeat(np.arange(len(buffer)), [len(b) for b in buffer])
            n = max(0, len(x) - LENGTH + 1)
            v, c, first, r, places = anchors(x, np.arange(n) + LENGTH <= ends[owner[:n]])
            who = owner[first]
            d, t, at = (np.array([m[k] for m in meta], np.int64)[who] for k in range(3))
            parts.append((v.view(np.int64), c.view(np.int64), d, t, at + first - begins[who], r, places))
            buffer.clear()
            meta.clear()
            held = 0

        for d, t, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            for at in range(0, len(data), BLOCK):
                piece = data[at : at + BLOCK + LENGTH - 1]
                if len(piece) >= LENGTH:
                    if held + len(piece) > BLOCK:
                        flush()
                    buffer.append(piece)
                    meta.append((d, t, at))
                    held += len(piece)
        flush()
        if not parts:
            return None
        v, c, d, t, a, r, places = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(v), pa.array(c), pa.array(d), pa.array(t), pa.array(a.astype(np.int32)), pa.array(r.astype(np.int32)), pa.array(places.astype(np.int32))], [x.split()[0] for x in _ANCHORS.split(", ")])

    return map_rows(keyed, use, _ANCHORS)


def classes(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The window starts of fragments with these ends, in suffix order to LENGTH bytes, and the number of each one's class."""
    n = len(x)
    end_of = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    room = end_of - np.arange(n)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = x
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | wide[k : k + n]
    at = np.flatnonzero(room >= 8)
    order = at[np.argsort(key[at])]
    new = np.append(True, key[order[1:]] != key[order[:-1]])
    rank = np.full(n, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    for shift, depth in ((8, 16), (16, 32), (32, 64), (LENGTH - 64, LENGTH)):
        order = order[room[order] >= depth]
        group = rank[order]
        tied = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = order[tied]  # only these are sorted again, inside their groups
        by = np.lexsort((rank[at + shift], group[tied]))
        at, second, first = at[by], rank[at + shift][by], group[tied][by]
        order[tied] = at
        new = np.append(True, (second[1:] != second[:-1]) | (first[1:] != first[:-1])) if len(at) else np.zeros(0, bool)
        finer = np.full(n, -1, np.int64)
        finer[order] = group
        head = np.maximum.accumulate(np.where(np.append(True, first[1:] != first[:-1]), np.arange(len(at)), 0)) if len(at) else np.zeros(0, np.int64)
        finer[at] = first + np.maximum.accumulate(np.where(new, np.arange(len(at)), 0)) - head
        rank = finer
    return order, rank[order]


def _words(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The windows at these places as rows of 13 big-endian numbers, which compare as the bytes do."""
    rows = np.zeros((len(at), 104), np.uint8)
    rows[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(x, LENGTH)[at]
    return rows.view(">u8").astype(np.uint64)


def _search(sorted_rows: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where each of rows is in sorted_rows, -1 where it is not: a binary search of all at once."""
    low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(sorted_rows))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        other = sorted_rows[np.minimum(mid, len(sorted_rows) - 1)]
        differs = other != rows
        k = differs.argmax(1)[:, None]
        less = np.take_along_axis(other, k, 1)[:, 0] < np.take_along_axis(rows, k, 1)[:, 0]
        low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
    found = np.minimum(low, max(0, len(sorted_rows) - 1))
    return np.where((low < len(sorted_rows)) & (sorted_rows[found] == rows).all(1), found, -1)


def later_windows(fragments: list[bytes], places: np.ndarray, shard: int = SHARD) -> list[np.ndarray]:
    """For each fragment the offsets of windows that also start at an earlier place; places: of each
    fragment's first window, as numbers in order."""
    sizes = np.array([len(f) for f in fragments])
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(sizes) // shard)) + 1, [len(fragments)]])
    shards = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if lo == hi:
            continue
        x, ends = np.frombuffer(b"".join(fragments[lo:hi]), np.uint8), np.cumsum(sizes[lo:hi])
        order, group = classes(x, ends)
        owner = np.searchsorted(ends, order, "right")
        place = places[lo:hi][owner] + order - (ends - sizes[lo:hi])[owner]
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(order) else np.zeros(0, np.int64)
        number = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1 if len(order) else heads
        shards.append([lo, x, order, owner, number, place, heads, np.minimum.reduceat(place, heads) if len(heads) else place])
    if len(shards) > 1:  # one order for all: each class is searched for in the other shards
        rows = [_words(s[1], s[2][s[6]]) for s in shards]
        for i in range(len(shards)):
            for j in range(i + 1, len(shards)):
                at = _search(rows[i], rows[j])
                both = np.flatnonzero(at >= 0)
                least = np.minimum(shards[i][7][at[both]], shards[j][7][both])
                shards[i][7][at[both]] = least
                shards[j][7][both] = least
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(fragments)
    for lo, _, order, owner, number, place, _, least in shards:
        late = place > least[number]
        who = owner[late] + lo
        begin = np.concatenate([[0], np.cumsum(sizes)])[who] - (np.cumsum(sizes)[lo - 1] if lo else 0)
        offset = order[late] - begin
        by = np.lexsort((offset, who))
        who, offset = who[by], offset[by]
        for f, o in zip(np.unique(who), np.split(offset, np.flatnonzero(np.diff(who)) + 1), strict=True) if len(who) else ():
            out[f] = o
    return out


def _runs(offsets: np.ndarray) -> list[tuple[int, int]]:
    if not len(offsets):
        return []
    cuts = np.flatnonzero(np.diff(offsets) > 1) + 1
    return [(int(p[0]), len(p)) for p in np.split(offsets, cuts)]


def _sorted_shards(rows: DataFrame, shard: int) -> DataFrame:
    """(v, d, t, a, bytes) as spans (d, t, a, r) of windows that also start earlier; rows of one v are together."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        docs, who = np.unique(np.array([(d, t) for _, d, t, _, _ in rows], np.int64), axis=0, return_inverse=True)
        late = later_windows([b for *_, b in rows], (who.reshape(-1).astype(np.int64) << 32) + np.array([a for *_, a, _ in rows]), shard)
        out = [(d, t, a + s, n) for (_, d, t, a, _), o in zip(rows, late, strict=True) for s, n in _runs(o)]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["d", "t", "a", "r"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[0] != last and size >= shard:
                    yield solve(held)
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    return rows.select("v", "d", "t", "a", "bytes").repartition("v").sortWithinPartitions("v").mapInArrow(over, _SPANS)


def _hot_windows(rows: DataFrame) -> DataFrame:
    """The same for buckets that are too large for a task: windows meet by digest."""

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(xxhash.xxh3_128_digest(b[i : i + LENGTH]), d, t, a + i) for d, t, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True) for i in range(len(b) - LENGTH + 1)]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["w", "d", "t", "a"])

    windows = map_rows(rows.select("d", "t", "a", "bytes"), use, "w binary, d bigint, t bigint, a int")
    first = windows.groupBy(F.col("w").alias("fw")).agg(F.min(F.struct("d", "t", "a")).alias("place"))
    return windows.join(first, F.col("w") == F.col("fw")).where(F.struct("d", "t", "a") > F.col("place")).select("d", "t", "a", F.lit(1).alias("r"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("d"), F.xxhash64("text").alias("t"), "text")


def spans(docs: DataFrame, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(d, t, a, r): windows a..a+r-1 of document (d, t) that also start earlier."""
    bounded_batches(docs.sparkSession)
    keyed = _keyed(docs)
    found = _anchor_rows(keyed)
    shared = cut(found.groupBy(F.col("v").alias("sv")).agg(F.sum("places").alias("n")).where("n > 1").select("sv"), "suffix-shared")
    rows = cut(found.join(shared, F.col("v") == F.col("sv")).drop("sv"), "suffix-fragments")
    place = F.struct("d", "t", "a")
    first = cut(rows.groupBy("v", "c").agg(F.min(place).alias("place"), F.max("r").alias("r"), F.max("places").alias("places")), "suffix-first")
    named = first.select(F.col("v").alias("fv"), F.col("c").alias("fc"), "place")
    copies = rows.join(named, (F.col("v") == F.col("fv")) & (F.col("c") == F.col("fc"))).where(place > F.col("place")).select("d", "t", "a", "r")
    # a fragment alone in its bucket can only repeat itself, and only if its anchor has several places
    buckets = first.groupBy(F.col("v").alias("bv")).agg(F.count("*").alias("n"), F.max("places").alias("several")).where("n > 1 or several > 1").select("bv", "n")
    wanted = first.join(buckets, F.col("v") == F.col("bv")).groupBy(F.col("place.d").alias("wd"), F.col("place.t").alias("wt")).agg(F.collect_list(F.struct("v", F.col("place.a").alias("a"), "r", (F.col("n") > hot).alias("hot"))).alias("wanted"))

    def take(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for d, t, text, wanted in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            out += [(w["v"], d, t, w["a"], data[w["a"] : w["a"] + w["r"] + LENGTH - 1], w["hot"]) for w in wanted]
        cols = list(zip(*out, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()), strict=True)], ["v", "d", "t", "a", "bytes", "hot"])

    joined = keyed.join(wanted, (F.col("d") == F.col("wd")) & (F.col("t") == F.col("wt"))).select("d", "t", "text", "wanted")
    fragments = cut(map_rows(joined, take, "v bigint, d bigint, t bigint, a int, bytes binary, hot boolean").dropDuplicates(["v", "d", "t", "a"]), "suffix-bytes")
    return copies.union(_sorted_shards(fragments.where("not hot"), shard)).union(_hot_windows(fragments.where("hot")))


def _covered(n: int, spans: list[dict] | None) -> list[tuple[int, int]]:
    """The maximal runs of covered bytes."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["a"] + s["r"] + LENGTH - 1) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, n)) for a, b in out]


def _with_spans(docs: DataFrame, shard: int, hot: int) -> DataFrame:
    by_doc = cut(spans(docs.select("doc_id", "text"), shard, hot).groupBy(F.col("d").alias("sd"), F.col("t").alias("st")).agg(F.collect_set(F.struct("a", "r")).alias("spans")), "suffix-spans")
    return docs.join(by_doc, (F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)) == F.col("sd")) & (F.xxhash64("text") == F.col("st")), "left")


def report(docs: DataFrame, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """One row per document: its bytes, how many go, in how many runs, and the SHA-256 of the rest."""

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for i, text, found in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            runs, sha, end = _covered(len(data), found), hashlib.sha256(), 0
            for a, b in runs:
                sha.update(data[end:a])
                end = b
            sha.update(data[end:])
            out.append((i, len(data), sum(b - a for a, b in runs), len(runs), sha.hexdigest()))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _with_spans(docs.select(F.col("doc_id").cast("bigint"), "text"), shard, hot).select("doc_id", "text", "spans")
    return map_rows(rows, use, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def deduplicate(docs: DataFrame, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(doc_id, text) with the covered bytes cut out; cut characters become U+FFFD."""

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if text is not None and found:
                data, kept, end = text.encode("utf-8", "surrogatepass"), [], 0
                for a, b in _covered(len(data), found):
                    kept.append(data[end:a])
                    end = b
                text = b"".join([*kept, data[end:]]).decode("utf-8", "replace")
            texts.append(text)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = _with_spans(docs.select(F.col("doc_id").cast("bigint"), "text"), shard, hot).select("doc_id", "text", "spans")
    return map_rows(rows, use, "doc_id bigint, text string")
