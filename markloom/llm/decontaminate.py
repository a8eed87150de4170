"""Benchmark decontamination: a broadcast hash set of benchmark n-grams, scanned by token windows.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all bytes above 0x7F. A window is
`n` consecutive words of a benchmark item; an item of fewer words, but not none, is one window.
Document words inside an occurrence of a window are hit. The hash of a window only finds it:
every hit is verified word by word.

The benchmark goes to the executors as a broadcast if its index takes at most `max_bytes` by an estimate from
word counts (`_WORD_BYTES` a word, `_VOCABULARY_BYTES` a distinct word; a test holds it against the index's real size),
which Spark works out before anything is collected. A larger one stays distributed: the documents' windows meet it in
a shuffle join on their MD5, and what the join finds is verified word by word like any other hit. Only windows
that pass a Bloom filter of the benchmark's windows (a bit map of fixed size) are shuffled; hits return by text digest.

Defined results: a null text has no words and is never hit; an empty benchmark hits nothing; rows with
the same or no doc_id are treated one by one; other columns are handed through untouched.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, map_rows

WINDOW = 10
#: Bytes of index that may be broadcast: half of it again while it is pickled, on a driver of 1.5 GB.
MAX_BYTES = 128 << 20
_WORD_BYTES, _VOCABULARY_BYTES = 32, 200
#: Bits of the Bloom filter, as a power of two, and its places for each window.
_BLOOM_BITS, _BLOOM_PLACES = 27, 3
#: Every byte that is no word byte becomes a space; A-Z become a-z.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_RUN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
REPORT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def item_windows(text: str | None, n: int) -> list[tuple[bytes, ...]]:
    w = words(text)
    return [tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def _window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(max(0, len(ids) - length + 1), np.uint64)
    for j in range(length):
        out = out * _BASE + ids[j : j + len(out)].astype(np.uint64)
    return out


class Index:
    """The windows of some items: the items' words as ids, and by window length the sorted hashes and places of windows."""

    def __init__(self, items: list[tuple[object, str | None]], n: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        coded, starts, self.items = [], [], []
        for key, text in items:
            if w := words(text):
                starts.append(len(coded))
                self.items.append("" if key is None else str(key))
                coded += [self.ids.setdefault(x, len(self.ids) + 1) for x in w]
                coded.append(0)  # no window reaches over the end of an item
        self.coded, self.starts = np.array(coded, np.int32), np.array([*starts, len(coded)], np.int64)
        lengths = np.minimum(np.diff(self.starts) - 1, n)
        self.tables = []
        for length in np.unique(lengths).tolist():
            own = np.repeat(lengths == length, np.diff(self.starts))
            gaps = np.concatenate([[0], np.cumsum(self.coded == 0)])
            at = np.flatnonzero((gaps[length:] == gaps[: len(gaps) - length]) & own[: len(gaps) - length])
            hashes = _window_hashes(self.coded, length)[at]
            order = np.argsort(hashes, kind="stable")
            self.tables.append((length, hashes[order], at[order]))

    @property
    def nbytes(self) -> int:
        return self.coded.nbytes + self.starts.nbytes + sum(h.nbytes + p.nbytes for _, h, p in self.tables) + sum(len(w) + 130 for w in self.ids) + sum(len(i) + 60 for i in self.items)

    def scan(self, texts: list[str | None]) -> list[tuple[int, np.ndarray, list[str]]]:
        """For each text: its number of words, the positions of those hit, and the items found."""
        get, coded, starts = self.ids.get, [], [0]
        for text in texts:
            coded += [get(w, 0) for w in words(text)]
            coded.append(0)  # no window reaches over the end of a text
            starts.append(len(coded))
        ids, bounds = np.array(coded, np.int64), np.array(starts)
        hit, found = np.zeros(len(ids), bool), {}
        gaps = np.concatenate([[0], np.cumsum(ids == 0)])
        for length, hashes, places in self.tables:
            at = np.flatnonzero(gaps[length:] == gaps[: len(gaps) - length]) if len(ids) >= length else np.zeros(0, np.int64)
            if not len(at):
                continue
            seen = _window_hashes(ids, length)[at]
            k = np.searchsorted(hashes, seen)
            k[k == len(hashes)] = 0
            at, k, seen = (x[hashes[k] == seen] for x in (at, k, seen))
            while len(at):  # again for every further item with this window, and where windows share a hash
                same = (ids[at[:, None] + np.arange(length)] == self.coded[places[k][:, None] + np.arange(length)]).all(1)
                texts_of = np.searchsorted(bounds, at[same], "right") - 1
                items_of = np.searchsorted(self.starts, places[k[same]], "right") - 1
                for j in range(length):
                    hit[at[same] + j] = True
                for t, i in set(zip(texts_of.tolist(), items_of.tolist(), strict=True)):
                    found.setdefault(t, set()).add(self.items[i])
                at, k, seen = at, k + 1, seen
                more = (k < len(hashes)) & (hashes[np.minimum(k, len(hashes) - 1)] == seen)
                at, k, seen = at[more], k[more], seen[more]
        return [(b - a - 1, np.flatnonzero(hit[a : b - 1]), sorted(found.get(i, ()))) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]


def without_words(text: str, positions: np.ndarray) -> str:
    """text less the runs of hit words and what stands between them."""
    data, out, end = text.encode("utf-8", "surrogatepass"), [], 0
    spans = [m.span() for m in _RUN.finditer(data)]
    for run in np.split(positions, np.flatnonzero(np.diff(positions) > 1) + 1):
        out.append(data[end : spans[run[0]][0]])
        end = spans[run[-1]][1]
    return b"".join([*out, data[end:]]).decode("utf-8", "surrogatepass")


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _small_index(benchmark: DataFrame, n: int, max_bytes: int) -> Index | None:
    word = F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    counted = benchmark.where("text is not null").select(F.explode(word).alias("w")).agg(F.count("*").alias("n"), F.count_distinct("w").alias("d"), F.sum(F.octet_length("w")).alias("b")).head()
    if _WORD_BYTES * counted.n + _VOCABULARY_BYTES * counted.d + (counted.b or 0) > max_bytes:
        return None
    return Index([(r[0], r[1]) for r in benchmark.select("item_id", "text").collect()], n)


def _places(digests: np.ndarray) -> np.ndarray:
    """The Bloom filter's places of 16-byte digests, a row each."""
    parts = digests.view(np.uint32).reshape(-1, 4)[:, :_BLOOM_PLACES]
    return (parts & np.uint32((1 << _BLOOM_BITS) - 1)).astype(np.int64)


def _bloom(windows: DataFrame) -> np.ndarray:
    """A bit map, as bytes, of windows(g): its size is fixed, whatever the benchmark."""

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = np.unique(_places(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8)).ravel()) if batch.num_rows else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], ["at", "bit"])

    words64 = map_rows(windows.select("g"), use, "at bigint, bit bigint").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (_BLOOM_BITS - 6), np.int64)
    bits[words64.column("at").to_numpy()] = words64.column("bits").to_numpy()
    return bits


def _far_hits(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """(digest of a text, its candidate spans with the windows' words, (window, item) pairs) by a shuffle join."""
    lengths = sorted({r[0] for r in map_rows(benchmark.select("text"), lambda b: pa.RecordBatch.from_pydict({"n": pa.array([min(n, len(words(t))) for t in b.column(0).to_pylist()], pa.int32())}), "n int").distinct().collect()} - {0})

    def of_items(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(k, hashlib.md5(b" ".join(w)).digest(), b" ".join(w)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in item_windows(t, n)]
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.binary()), strict=True)], ["i", "g", "w"])

    right = cut(map_rows(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text"), of_items, "i string, g binary, w binary").distinct(), "leak-windows")
    bits = docs.sparkSession.sparkContext.broadcast(_bloom(right))

    def of_docs(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, at, sizes, digests = [], [], [], []
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = words(t)
            for m in lengths:
                for start in range(0, len(w) - m + 1, 1 << 15):
                    own = [hashlib.md5(b" ".join(w[i : i + m])).digest() for i in range(start, min(len(w) - m + 1, start + (1 << 15)))]
                    places = _places(np.frombuffer(b"".join(own), np.uint8))
                    for i in np.flatnonzero(((bits.value[places >> 6] >> (places & 63)) & 1).all(1)).tolist():
                        keys.append(k)
                        at.append(start + i)
                        sizes.append(m)
                        digests.append(own[i])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(at, pa.int32()), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary())], ["k", "pos", "len", "g"])

    texts = docs.select(F.md5("text").alias("k"), "text").where("text is not null").dropDuplicates(["k"])
    left = cut(map_rows(texts, of_docs, "k string, pos int, len int, g binary"), "leak-candidates")
    spans = left.join(right.select("g", "w").distinct(), "g").groupBy("k").agg(F.collect_list(F.struct("pos", "len", "g", "w")).alias("spans"))
    items = left.select("k", "g").distinct().join(right.select("g", "i"), "g").groupBy(F.col("k").alias("ik")).agg(F.collect_list(F.struct("g", "i")).alias("items"))
    return spans.join(items, F.col("k") == F.col("ik")).select("k", "spans", "items")


def _scanned(docs: DataFrame, benchmark: DataFrame, n: int, max_bytes: int, use, schema) -> DataFrame:
    """docs through use(batch, scan results); the text is the column `text`."""
    spark = docs.sparkSession
    bounded_batches(spark)
    index = _small_index(benchmark, n, max_bytes)
    at = docs.columns.index("text")
    if index is not None:
        shared = spark.sparkContext.broadcast(index)
        return map_rows(docs, lambda b: use(b, shared.value.scan(b.column(at).to_pylist())), schema)
    row = docs.select(F.struct(*docs.columns).alias("row"), F.md5("text").alias("k"))
    joined = row.join(_far_hits(docs, benchmark, n), "k", "left").select("row", "spans", "items")

    def far(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = pa.RecordBatch.from_struct_array(batch.column(0))
        found = []
        for text, spans, items in zip(rows.column(at).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            w = words(text)
            true = [s for s in spans or () if w[s["pos"] : s["pos"] + s["len"]] == s["w"].split(b" ")]
            places, windows = sorted({p for s in true for p in range(s["pos"], s["pos"] + s["len"])}), {s["g"] for s in true}
            found.append((len(w), np.array(places, np.int64), sorted({x["i"] for x in items or () if x["g"] in windows})))
        return use(rows, found)

    return map_rows(joined, far, schema)


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per document: how many words, how many hit, which items."""

    def use(batch: pa.RecordBatch, found) -> pa.RecordBatch:
        hits = [len(h) for _, h, _ in found]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array([w for w, _, _ in found], pa.int64()), pa.array(hits, pa.int64()), pa.array([len(i) for *_, i in found], pa.int64()), pa.array([_digest(i) for *_, i in found]), pa.array([h > 0 for h in hits])],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    return _scanned(docs.select("doc_id", "text"), benchmark, n, max_bytes, use, REPORT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs, same columns, without documents that hold a window (remove="documents") or without the hit spans ("spans")."""
    if remove not in ("documents", "spans"):
        raise ValueError(remove)
    at = docs.columns.index("text")

    def use(batch: pa.RecordBatch, found) -> pa.RecordBatch:
        if remove == "documents":
            return batch.filter(pa.array([not len(h) for _, h, _ in found]))
        texts = [without_words(t, h) if len(h) else t for t, (_, h, _) in zip(batch.column(at).to_pylist(), found, strict=True)]
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))

    return _scanned(docs, benchmark, n, max_bytes, use, docs.schema)


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The same report in DuckDB's SQL.
SQL = rf"""
with b as (select coalesce(item_id::varchar, '') as i, {_SQL_WORDS} as w from benchmark),
bw as (select i, least(len(w), {WINDOW}) as n, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) as p, w from b where len(w) > 0),
win as (select distinct i, n, array_to_string(list_slice(w, p, p + n - 1), ' ') as g from bw),
d as (select row_number() over () as r, doc_id, {_SQL_WORDS} as w from documents),
dw as (select r, n, unnest(range(1, len(w) - n + 2)) as p, w from d join (select distinct n from win) on len(w) >= n),
hit as (select r, p, x.n, i from (select r, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') as g from dw) x join win using (n, g)),
pos as (select r, count(distinct p + k) as c from (select distinct r, p, n from hit) h join (select unnest(range(0, {WINDOW})) as k) t on k < n group by r),
its as (select r, count(*) as c, string_agg(i, ',' order by i) as s from (select distinct r, i from hit) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(pos.c, 0)::bigint as n_hit, coalesce(its.c, 0)::bigint as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(pos.c, 0) > 0 as contaminated
from d left join pos using (r) left join its using (r)
"""
