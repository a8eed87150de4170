"""WARC archives through a chunked record table.

Writing: each page becomes rows (record, chunk number, bytes) of at most `CHUNK` bytes. A Python task
sees them in order and keeps one running SHA-1 and a byte count, never a whole record; the digest that
the first header announces is checked when the last chunk has gone by. A payload of several chunks
becomes a segmented record: a response and its continuation records. The rows are WARC/1.1 records, and
Spark's text writer ends each with the empty lines that the format asks for, so the part files (gzip) are
archives that other readers take.

Reading: Spark's text reader splits the files before each `WARC/1.1` line, so that a row is a record or a
segment. Payload bytes that look like such a border are cut apart by one more segment when written.
Records of one segment are digested where they are read; segments are dealt by record, sorted by number
and digested as they pass. Declared lengths and digests are checked.

Equal payloads (SHA-1 and length) of at least `least` bytes are stored once: the record with the largest
page_id is the response, the others are revisits that name it.

Defined results: null html is an empty payload; rows that share the largest page_id of equal payloads are
all responses; a null page_id counts as the smallest, and null stays null when read back. An empty table
gives an archive without records. Columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, scratch_path

CHUNK = 1 << 20
_END, _HEAD = b"\r\n\r\n", b"WARC/1.1\r\n"
_BORDER = _END + _HEAD
TABLE = "record_id string, page_id bigint, kind string, refers_to string, digest string, chunk_no int, last boolean, total bigint, data binary"
RECORDS = "record_id string, page_id bigint, kind string, refers_to string, payload_bytes bigint, payload_digest string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {digest}'.encode()).digest())}>"


def _pieces(data: bytes) -> Iterator[bytes]:
    """data in pieces none of which, between a header and the next record, shows a border."""
    while (at := (_END + data + _END).find(_BORDER)) >= 0:
        yield data[: at + 2]
        data = data[at + 2 :]
    yield data


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*fields, ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"), ("Content-Length", len(block))] if v is not None]
    return _HEAD + "\r\n".join(lines).encode("utf-8", "surrogatepass") + _END + block


def _clean(url: str | None) -> str:
    return "".join(c for c in url or "" if c >= " ") or "urn:none"


def chunks(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """(page_id, url, digest, refers_to, length, chunk_no, data) in the rows' order; digest: SHA-1 in hex, of the whole payload."""
    data = F.col("payload")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / size)).cast("int")
    cut = pages.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.when(F.col("refers_to").isNull(), n - 1).otherwise(F.lit(0)))))
    part = F.when(F.col("refers_to").isNull(), F.substring(data, F.col("chunk_no") * size + 1, F.lit(size))).otherwise(F.lit(b""))
    return cut.select("page_id", "url", "digest", "refers_to", F.octet_length(data).cast("bigint").alias("length"), "chunk_no", part.alias("data"))


def _with_roles(pages: DataFrame, least: int) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    narrow = rows.select("page_id", "digest", F.octet_length("payload").alias("length"))
    kept = narrow.groupBy(F.col("digest").alias("d"), F.col("length").alias("n")).agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where((F.col("copies") > 1) & (F.col("n") >= least)).select("d", "n", "first")
    of = rows.join(kept, (F.col("digest") == F.col("d")) & (F.octet_length("payload") == F.col("n")), "left")
    return of.withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).select("page_id", "url", "payload", "digest", "refers_to")


def _serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    running, done, number = None, 0, 0
    for batch in batches:
        out = []
        for page, url, hexed, refers, length, chunk_no, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            digest = base32(bytes.fromhex(hexed))
            name = record_id(page, digest)
            common = [("WARC-Date", "1970-01-01T00:00:00Z"), ("X-Page-ID", page)]
            if refers is not None:
                out.append(_record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Target-URI", _clean(url)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers, digest)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")], b""))
                continue
            if not chunk_no:
                running, done, number = hashlib.sha1(), 0, 0
            running.update(data)
            for piece in _pieces(data):
                done += len(piece)
                last, number = done == length, number + 1
                parts = number if number > 1 or not last else None
                if number == 1:
                    head = [("WARC-Type", "resource"), ("WARC-Record-ID", name)] if url is None else [("WARC-Type", "response"), ("WARC-Record-ID", name)]
                    fields = [*head, *common, ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Segment-Number", parts), ("Content-Type", "text/html; charset=utf-8")]
                else:
                    total = length if last else None
                    fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page, f"{digest} {number}")), *common, ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total)]
                out.append(_record(fields, piece))
            if done == length and running.hexdigest() != hexed:
                raise ValueError(f"page {page}: the chunks don't have the announced digest")
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write(pages: DataFrame, path: str, least: int = 0, chunk: int = CHUNK, compression: str = "gzip") -> None:
    """Writes pages(page_id, url, html) as WARC files below path."""
    bounded_batches(pages.sparkSession, 64)
    rows = chunks(_with_roles(pages, least), chunk).mapInArrow(_serialise, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for raw in batch.column(0).to_pylist():
            head, _, block = raw.removeprefix(_HEAD).partition(_END)
            fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n") if ": " in line)
            if "Content-Length" not in fields:
                continue  # an empty file's end
            block = block[: int(fields["Content-Length"])]
            if len(block) != int(fields["Content-Length"]) or fields["WARC-Block-Digest"] != f"sha1:{base32(hashlib.sha1(block).digest())}":
                raise ValueError(f"{fields['WARC-Record-ID']}: broken block")
            number, total = fields.get("WARC-Segment-Number"), fields.get("WARC-Segment-Total-Length")
            page, digest = fields.get("X-Page-ID"), fields.get("WARC-Payload-Digest")
            rows.append((fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]), page and int(page), fields["WARC-Type"], fields.get("WARC-Refers-To"), digest and digest.removeprefix("sha1:"), int(number or 1) - 1, number is None or total is not None, total and int(total), block))
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
        cols = list(zip(*rows, strict=True)) or [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in TABLE.split(", ")])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of the archives below path."""
    bounded_batches(spark, 64)
    raw = spark.read.option("lineSep", _BORDER.decode()).text(path)
    return raw.select(F.col("value").cast("binary")).mapInArrow(_parse, TABLE)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order become records; what is kept between chunks is a running digest."""
    first, running, size = None, None, 0
    for batch in batches:
        rows = []
        for name, page, kind, refers, digest, no, last, total, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if no == 0:
                first, running, size = (name, page, kind, refers, digest), hashlib.sha1(), 0
            running.update(data)
            size += len(data)
            if last:
                found = base32(running.digest())
                if first[0] != name or kind != "revisit" and first[4] != found or total is not None and total != size:
                    raise ValueError(f"{name}: the payload isn't what its header announces")
                rows.append((*first[:4], size, first[4] if kind == "revisit" else found))
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        cols = list(zip(*rows, strict=True)) or [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])


def records(table: DataFrame) -> DataFrame:
    """The chunked record table as one row per record, with the length and digest of what was read."""
    whole = (F.col("chunk_no") == 0) & F.col("last")
    # rows of one record that is there twice would mix; the page and its digest name a record, and copies are alike
    parts = table.where(~whole).dropDuplicates(["record_id", "chunk_no"]).repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return table.where(whole).mapInArrow(_digested, RECORDS).unionByName(parts.mapInArrow(_digested, RECORDS))


def report(found: DataFrame) -> DataFrame:
    """One row per page, from the records that were read; revisits take their payload from what they refer to."""
    is_revisit = F.col("kind") == "revisit"
    full = found.where(~is_revisit).select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"))
    target = found.where(~is_revisit).groupBy(F.col("record_id").alias("target")).agg(F.max("page_id").alias("to_page"), F.max("payload_bytes").alias("bytes"), F.max("payload_digest").alias("digest"))
    again = found.where(is_revisit).join(target, F.col("refers_to") == F.col("target"), "left").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("to_page").alias("refers_to"))
    return full.unionByName(again)


def round_trip(pages: DataFrame, least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Writes the archives into the shared folder, reads them back and reports."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, least, chunk)
    return report(records(read(spark, path)))


#: The same in DuckDB's SQL: 40 hex digits are 160 bits, each 5 of them a base32 digit.
SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html))::bigint as payload_bytes, sha1(html) as h,
  list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform(range(4), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha1(html), 1 + g * 5, 5))::bigint >> (15 - 5 * k)) & 31)::int, 1)), 'string_agg', '')), 'string_agg', '') as payload_digest from p),
m as (select h, payload_bytes, max(page_id) as last from d group by h, payload_bytes)
select d.page_id, d.payload_bytes, payload_digest, case when d.page_id = m.last then 'response' else 'revisit' end as record_type, case when d.page_id <> m.last then m.last end as refers_to
from d join m on d.h = m.h and d.payload_bytes = m.payload_bytes
"""
