"""Line deduplication by a deletion-neighbourhood join.

A line's normal form is its words with A-Z lower-cased, joined by single spaces. A line with a word goes if an
earlier line of the corpus has the same normal form or is near it. Two lines are near if
* one word inserted, deleted or replaced makes one of the other, and the longer has `NEAR_WORDS` words or more, so
  that a word is an eighth of it at most, or
* one code point inserted, deleted or replaced makes one of the other, the longer has `NEAR_CHARS` of them or more, and the
  shorter has fewer than `NEAR_WORDS` words, as lines of scripts without spaces have.
Both are rules on pairs, whichever line is the earlier one; no size of a line keeps it from being compared with a line that it
is near. Earlier means a smaller doc_id (nulls last), then the text's hash, then the line's number; lines are judged
on the input.

Two lines at one edit at most have an equal deletion variant: the same position left out of both
(replaced), or one line whole and the other with a unit left out. Variants are hashed (from
hashes of what stands before and after the gap, in constant time each) and joined; of each
group of equal variants only its earliest line matters, so a group gives a row for each member and no
pairs. What the join finds is verified unit by unit.

Only lines that can have a partner emit variants: with one edit either the first half of the shorter
line or its second half is shared by both, so lines whose half keys (three as a rule) no other line has
are passed over. Only variants that two lines have go on to be grouped. A hot line, half or variant stays spread: groups are partial minima and counts before the
shuffle, and their joins are plain equality joins, which adaptive execution splits.

Defined results: null texts have no lines and stay null; rows that repeat doc_id and text count as one
document; other columns are handed through. Line ends are \\n alone.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, map_rows

NEAR_WORDS, NEAR_CHARS = 8, 16
#: The modulus and the base of the variants' hashes.
_PRIME, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)
_POWERS = [1]
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_LAST = (1 << 63) - 1
_LINES = "d bigint, t bigint, line int, h binary, id bigint, keys array<bigint>"
_VARIANTS = "id bigint, v bigint, p int, words binary"


def normal(line: bytes) -> list[bytes]:
    return line.translate(_LOWER).split()


def _long(data: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(data, seed) - (1 << 63)


def forms(words: list[bytes]) -> list[tuple[list[bytes] | str, bool]]:
    """What a line is compared by, its words and its code points as far as a pair may have them, and whether only as the shorter one."""
    out: list[tuple[list[bytes] | str, bool]] = []
    if len(words) >= NEAR_WORDS - 1:
        out.append((words, len(words) < NEAR_WORDS))
    if len(words) <= NEAR_WORDS:
        joined = b" ".join(words).decode("utf-8", "surrogatepass")
        if len(joined) >= NEAR_CHARS - 1:
            out.append((joined, len(joined) < NEAR_CHARS))
    return out


def near(a: list[bytes], b: list[bytes]) -> bool:
    """Whether two lines of these words are near; of one group of equal variants all lines are, see `_near`."""
    if max(len(a), len(b)) >= NEAR_WORDS and within_one(a, b):
        return True
    if min(len(a), len(b)) >= NEAR_WORDS:
        return False
    x, y = (b" ".join(w).decode("utf-8", "surrogatepass") for w in (a, b))
    return max(len(x), len(y)) >= NEAR_CHARS and within_one(x, y)


def half_keys(line: list[bytes] | str, shorter: bool = False) -> list[int]:
    """One of these is shared by any two lines within one edit: halves of the line as the longer and the shorter one."""
    n, out = len(line), set()
    data = (lambda x: x.encode("utf-8", "surrogatepass")) if isinstance(line, str) else b" ".join
    kind = 1 << 40 if isinstance(line, str) else 0
    for m in (n,) if shorter else (n, n - 1):
        left, right = m // 2, m - m // 2
        out.add(_long(data(line[:left]), kind + 2 * left))
        out.add(_long(data(line[n - right :]), kind + 2 * right + 1))
    return sorted(out)


def variants(line: list[bytes] | str, shorter: bool = False) -> list[tuple[int, int]]:
    """(hash, position left out; -1: none) of a line's deletion variants; only the whole of one that is only the shorter."""
    chars = isinstance(line, str)
    values = [ord(c) + 1 for c in line] if chars else [xxhash.xxh64_intdigest(w) % _PRIME for w in line]
    n, before = len(values), [0]
    for v in values:
        before.append((before[-1] * _BASE + v) % _PRIME)
    while len(_POWERS) <= n:
        _POWERS.append(_POWERS[-1] * _BASE % _PRIME)
    whole = before[n]
    out = [(2 * whole + chars, -1)]
    if shorter:
        return out
    return out + [(2 * (((before[p] - before[p + 1]) * _POWERS[n - p - 1] + whole) % _PRIME) + chars, p) for p in range(n)]


def within_one(a: list[bytes] | str, b: list[bytes] | str) -> bool:
    """Whether one unit inserted, deleted or replaced at most makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return len(b) - len(a) <= 1 and a[same + (len(a) == len(b)) :] == b[same + 1 :]


def _keyed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as (d, t, text): what names a document, and its text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("d"), F.xxhash64("text").alias("t"), "text")


def _lines(docs: DataFrame) -> DataFrame:
    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for d, t, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            for i, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
                words = normal(line)
                if words:
                    h = xxhash.xxh3_128_digest(b" ".join(words))
                    keys = [k for form in forms(words) for k in half_keys(*form)]
                    rows.append((d, t, i, h, int.from_bytes(h[:8], "big", signed=True), keys or None))
        types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], ["d", "t", "line", "h", "id", "keys"])

    return map_rows(docs, use, _LINES)


def _variants(docs: DataFrame) -> DataFrame:
    """docs(text, wanted: array of (line, id)) as variant rows; the whole line's row also has its words."""

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, wanted in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            lines = text.encode("utf-8", "surrogatepass").split(b"\n")
            for w in wanted:
                words = normal(lines[w["line"]])
                rows += [(w["id"], v, p, b" ".join(words) if p < 0 else None) for form in forms(words) for v, p in variants(*form)]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], ["id", "v", "p", "words"])

    return map_rows(docs, use, _VARIANTS)


def _place() -> Column:
    return F.struct("d", "t", "line")


def _several(rows: DataFrame, key: str) -> DataFrame:
    """The keys that two different lines have at least: bounded partial sums, whatever a key's rows."""
    return rows.groupBy(F.col(key).alias("shared")).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("shared")


def _near(lines: DataFrame, first: DataFrame, keyed: DataFrame) -> DataFrame:
    """(id) of the distinct lines with an earlier line at one edit; first: (h, id, place).

    id: half of a line's 128-bit hash; lines that share one are told apart when pairs are verified.
    The lines of a group of equal variants have as many units each; if they are words, NEAR_WORDS or more, and if code points, two
    lines of NEAR_WORDS words differ within a word, and are near by words. So a group's earliest line speaks for all of them."""
    keys = lines.where("keys is not null").select("id", F.explode("keys").alias("key"))
    shared = cut(_several(keys, "key"), "line-halves")
    candidates = keys.join(shared, F.col("key") == F.col("shared")).select(F.col("id").alias("ci")).distinct()
    placed = cut(first.join(candidates, F.col("id") == F.col("ci"), "left_semi").select("id", "place"), "line-candidates")
    wanted = placed.groupBy(F.col("place.d").alias("wd"), F.col("place.t").alias("wt")).agg(F.collect_list(F.struct(F.col("place.line").alias("line"), "id")).alias("wanted"))
    texts = keyed.join(wanted, (F.col("d") == F.col("wd")) & (F.col("t") == F.col("wt"))).select("text", "wanted")
    every = cut(_variants(texts), "line-variants")
    v = cut(every.select("id", "v", "p").join(_several(every, "v"), F.col("v") == F.col("shared")).drop("shared").join(placed.withColumnRenamed("id", "pi"), F.col("id") == F.col("pi")).drop("pi"), "line-shared-variants")
    out = v.where("p >= 0")
    whole = v.where("p < 0").select(F.col("v").alias("wv"), F.col("id").alias("wi"), F.col("place").alias("wplace"))
    groups = out.groupBy(F.col("v").alias("gv"), F.col("p").alias("gp")).agg(F.min(F.struct("place", "id")).alias("least"))
    replaced = out.join(groups, (F.col("v") == F.col("gv")) & (F.col("p") == F.col("gp"))).where("place > least.place").select("id", F.col("least.id").alias("partner"))
    longer = out.join(whole, F.col("v") == F.col("wv")).where("wplace < place").select("id", F.col("wi").alias("partner"))
    least = out.groupBy(F.col("v").alias("lv")).agg(F.min(F.struct("place", "id")).alias("least"))
    shorter = whole.join(least, F.col("wv") == F.col("lv")).where("least.place < wplace").select(F.col("wi").alias("id"), F.col("least.id").alias("partner"))
    pairs = replaced.union(longer).union(shorter).distinct()
    words = every.where("p < 0").select(F.col("id").alias("of"), "words").distinct()
    sides = pairs.join(words.withColumnRenamed("words", "a"), F.col("id") == F.col("of")).drop("of").join(words.withColumnRenamed("words", "b"), F.col("partner") == F.col("of")).select("id", "a", "b")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        sides = [[x.split(b" ") for x in batch.column(k).to_pylist()] for k in (1, 2)]
        good = [near(a, b) for a, b in zip(*sides, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good, pa.bool_()))], ["id"])

    return map_rows(sides, verify, "id bigint").distinct()


def _removed(docs: DataFrame) -> DataFrame:
    """(rd, rt, gone): the numbers of the lines that go from a document."""
    bounded_batches(docs.sparkSession)
    keyed = _keyed(docs)
    lines = cut(_lines(keyed), "line-rows")
    first = cut(lines.groupBy("h").agg(F.min(_place()).alias("place"), F.first("id").alias("id")), "line-first")
    near = cut(_near(lines, first, keyed), "line-near").select(F.col("id").alias("ni"))
    judged = first.join(near, F.col("id") == F.col("ni"), "left").select(F.col("h").alias("fh"), "place", F.col("ni").isNotNull().alias("near"))
    gone = lines.select("h", "d", "t", "line").join(judged, F.col("h") == F.col("fh")).where(F.col("near") | (_place() > F.col("place")))
    return gone.groupBy(F.col("d").alias("rd"), F.col("t").alias("rt")).agg(F.array_sort(F.collect_set("line")).alias("gone"))


def without_lines(text: str, gone: list[int]) -> str:
    drop = set(gone)
    return "\n".join([x for i, x in enumerate(text.split("\n")) if i not in drop])


def _with_gone(docs: DataFrame) -> DataFrame:
    """(row, gone) for each row of docs."""
    removed = _removed(docs.select("doc_id", "text"))
    row = docs.select(F.struct(*docs.columns).alias("row"))
    return row.join(removed, (F.coalesce(F.col("row.doc_id").cast("bigint"), F.lit(_LAST)) == F.col("rd")) & (F.xxhash64("row.text") == F.col("rt")), "left").select("row", "gone")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: its lines, how many go, and the SHA-256 of what is kept (null texts: as empty)."""
    rows = _with_gone(docs.select("doc_id", "text")).select("row.doc_id", "row.text", "gone")

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, gone = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        kept = [without_lines(t or "", g or []) for t, g in zip(texts, gone, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([t.count("\n") + 1 if t is not None else 0 for t in texts], pa.int64()), pa.array([len(g or ()) for g in gone], pa.int64()), pa.array([hashlib.sha256(k.encode("utf-8", "surrogatepass")).hexdigest() for k in kept])], ["doc_id", "n_lines", "n_removed", "kept_sha256"])

    return map_rows(rows, use, "doc_id bigint, n_lines bigint, n_removed bigint, kept_sha256 string")


def deduplicate(docs: DataFrame, drop_emptied: bool = True) -> DataFrame:
    """docs, same columns, texts without the lines that go; documents left without any word go too, if asked."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = pa.RecordBatch.from_struct_array(batch.column(0))
        gone = batch.column(1).to_pylist()
        texts = [t if not g else without_lines(t, g) for t, g in zip(rows.column(at).to_pylist(), gone, strict=True)]
        rows = rows.set_column(at, rows.schema.field(at), pa.array(texts, pa.string()))
        return rows.filter(pa.array([not g or bool(t.split()) or not drop_emptied for t, g in zip(texts, gone, strict=True)]))

    return map_rows(_with_gone(docs), use, docs.schema)
