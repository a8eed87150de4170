"""Quality rules: base counts of each text, then line frequency across documents.

Words are runs of anything but ASCII white space. The base rules fail a document of fewer than `MIN_WORDS`
words, or one where over `MAX_REPEAT` % of the words lie in 3-word windows that the text repeats.

Line frequency: lines are normalised (A-Z lower-cased, digits as 0, other ASCII signs dropped, white space
joined) and hashed (XXH64). For each host, a line counts the distinct documents that hold it; rows of one host
with the same text are one document. A line of over `LIMIT_DOCS` documents is frequent, whatever the size of the
host, and removed from all of them but the earliest (smallest doc_id, nulls last, then the text's MD5), so that a
passage that stands on many pages is kept once and a group of near copies isn't lost whole. A document is depleted,
and rejected, if less than `MIN_KEPT` of its words are left.

A hot host or line is spread: a document's vote is aggregated on (host, line, text) first and only then counted by
(host, line), in partial sums; what is joined on (host, line) only has frequent lines on one side.

Defined results: a null text has no words and fails the base rules; a null host is a host of its own;
repeated rows are judged row by row, alike; other columns are handed through; an empty table gives no rows. Long
texts are worked on whole.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, map_rows

MIN_WORDS, MAX_REPEAT = 50, 50
LIMIT_DOCS, MIN_KEPT = 10, 0.5
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
#: A-Z as a-z, digits as 0, other ASCII signs as spaces.
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x30 if 0x30 <= b <= 0x39 else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_BASE = "doc_id bigint, host string, digest binary, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean"
_LINES = "lines array<struct<hash: bigint, words: int>>"
_LINE = pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int32())]))


def repeated_words(ids: np.ndarray, width: int = 3) -> int:
    """How many positions lie in a window of `width` ids that occurs twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    _, key = np.unique(ids, return_inverse=True)
    first = key
    for j in range(1, width):  # windows numbered by their first j + 1 words
        _, key = np.unique(key[: len(key) - 1] * (int(first.max()) + 1) + first[j : j + len(key) - 1], return_inverse=True)
    again = np.bincount(key)[key] > 1
    covered = np.zeros(len(ids), bool)
    for j in range(width):
        covered[j : j + n] |= again
    return int(covered.sum())


def base(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    names: dict[bytes, int] = {}
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() parts at just the six ASCII white spaces
    ids = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif _SPACE.sub("", line):
            seen.add(line)
    return len(words), len(text) - len(_SPACE.findall(text)), len(_SYMBOLS.findall(text)), again, repeated_words(ids)


def normal_lines(text: str | None) -> list[tuple[int, int]]:
    """(hash, words) of the lines with a normalised word."""
    out = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        if words := line.translate(_NORMAL).split():
            h = xxhash.xxh64_intdigest(b" ".join(words))
            out.append((h - (1 << 64) if h >> 63 else h, len(line.split())))
    return out


def distinct_lines(text: str | None) -> list[tuple[int, int]]:
    """(hash, words in all) of the distinct lines of a text."""
    found: dict[int, int] = {}
    for h, n in normal_lines(text):
        found[h] = found.get(h, 0) + n
    return list(found.items())


def _measured(docs: DataFrame) -> DataFrame:
    """Base columns and lines of each row, numbered, written to the shared folder."""
    bounded_batches(docs.sparkSession)

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(2).to_pylist()
        figures = list(zip(*[base(t) for t in texts], strict=True))
        failed = [n < MIN_WORDS or 100 * r > MAX_REPEAT * n for n, r in zip(figures[0], figures[4], strict=True)]
        digests = [hashlib.md5((t or "").encode("utf-8", "surrogatepass")).digest() for t in texts]
        lines = [distinct_lines(t) for t in texts]
        arrays = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), *[pa.array(x, pa.int64()) for x in figures], pa.array(failed), pa.array(lines, _LINE)]
        return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _BASE.split(", ")] + ["lines"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string").alias("host"), "text")
    return cut(map_rows(rows, use, f"{_BASE}, {_LINES}").withColumn("row_no", F.monotonically_increasing_id()), "quality")


def _frequent(measured: DataFrame, limit_docs: int) -> DataFrame:
    """(bad_host, bad_hash, first) of the frequent lines, with the document that keeps them."""
    lines = measured.select("host", "doc_id", "digest", F.explode("lines.hash").alias("hash"))
    votes = lines.groupBy("host", "hash", "digest").agg(F.min("doc_id").alias("doc_id"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    counted = votes.groupBy(F.col("host").alias("bad_host"), F.col("hash").alias("bad_hash")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.where(F.col("n") > limit_docs).drop("n")


def _verdicts(measured: DataFrame, limit_docs: int, min_kept: float) -> DataFrame:
    """measured with the words that frequent lines take from a row, the hashes of these lines (or null), and the verdict."""
    lines = measured.select("row_no", "host", "doc_id", "digest", F.explode("lines").alias("l"))
    met = lines.join(_frequent(measured, limit_docs), F.expr("l.hash = bad_hash and host <=> bad_host")).where("not (doc_id <=> first.doc_id and digest = first.digest)")
    lost = met.groupBy("row_no").agg(F.sum("l.words").alias("lost"), F.collect_list("l.hash").alias("gone"))
    return measured.drop("lines").join(lost, "row_no", "left").withColumn("n_frequent_words", F.coalesce("lost", F.lit(0))).withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_frequent_words") >= min_kept * F.col("n_words")))


def report(docs: DataFrame, limit_docs: int = LIMIT_DOCS, min_kept: float = MIN_KEPT) -> DataFrame:
    """One row per document: the base counts, the words in frequent lines and the verdict."""
    return _verdicts(_measured(docs), limit_docs, min_kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_frequent_words", "kept")


def without_lines(text: str, gone: set[int]) -> str:
    """text less its lines with these hashes."""
    return "\n".join(x for x in text.split("\n") if not gone & {h for h, _ in normal_lines(x)})


def clean(docs: DataFrame, limit_docs: int = LIMIT_DOCS, min_kept: float = MIN_KEPT, reject: bool = True) -> DataFrame:
    """docs, same columns, without the rejected documents (unless reject is false) and, in all others, without frequent lines."""
    judged = _verdicts(_measured(docs), limit_docs, min_kept)
    which = [F.col(c).alias(f"of_{c}") for c in ("doc_id", "host", "digest")]
    touched = judged.where("not kept or gone is not null").groupBy(*which).agg(F.first("kept").alias("kept"), F.first("gone").alias("gone"))
    row = docs.select(F.struct(*docs.columns).alias("row"))
    own = F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("of_doc_id")) & F.col("row.source").cast("string").eqNullSafe(F.col("of_host"))
    met = row.join(touched, own & (F.unhex(F.md5(F.coalesce("row.text", F.lit("")))) == F.col("of_digest")), "left")
    left = met.where(F.coalesce("kept", F.lit(True))) if reject else met
    at = docs.columns.index("text")

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = pa.RecordBatch.from_struct_array(batch.column(0))
        texts = [t if not g else without_lines(t, set(g)) for t, g in zip(rows.column(at).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        return rows.set_column(at, rows.schema.field(at), pa.array(texts, pa.string()))

    return map_rows(left.select("row", "gone"), use, docs.schema)


#: The same verdicts in DuckDB's SQL.
SQL = rf"""
with d as (select row_number() over () as r, doc_id, source as host, coalesce(text, '') as text from documents),
w as (select r, unnest(x) as w, generate_subscripts(x, 1) as i from (select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as x from d)),
g as (select r, i, w || ' ' || lead(w) over o || ' ' || lead(w, 2) over o as g from w window o as (partition by r order by i)),
again as (select r, i from (select r, i, count(*) over (partition by r, g) as n from g where g is not null) where n > 1),
rep as (select r, count(distinct i + k) as n from again, (values (0), (1), (2)) t(k) group by r),
l as (select r, host, unnest(x) as line, generate_subscripts(x, 1) as i from (select r, host, string_split(text, chr(10)) as x from d)),
dup as (select r, sum(n - 1)::bigint as n from (select r, count(*) as n from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by r, line) group by r),
nl as (select r, host, i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words,
  trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) as line from l),
once as (select r, host, line, sum(words) as words from nl where line <> '' group by all),
held as (select o.*, doc_id, md5(text) as t from once o join d using (r)),
bad as (select host, line, min((doc_id is null, coalesce(doc_id, 0), t)) as first from held group by host, line having count(distinct t) > {LIMIT_DOCS}),
lost as (select r, sum(words)::bigint as n from held h join bad b on h.host is not distinct from b.host and h.line = b.line where (doc_id is null, coalesce(doc_id, 0), t) <> first group by r),
c as (select d.r, doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, coalesce(lost.n, 0)::bigint as n_frequent_words
  from d left join dup using (r) left join rep using (r) left join lost using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words as base_failed, n_frequent_words,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words) and n_words - n_frequent_words >= {MIN_KEPT} * n_words as kept from c
"""
