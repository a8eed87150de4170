import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from markloom.llm import warc

SCHEMA = "page_id long, url string, html string, refers_to string"
TRAP = "\r\n\r\nWARC/1.1\r\n"


def rows():
    out = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" * (1 + i % 7), None) for i in range(40)]
    out += [(100, "u", None, None), (101, "u", "", None), (102, None, "é日🎉" * 900, None), (103, "a\r\nX: y", TRAP, "q"), (104, "u", "WARC/1.1\r\nx", None), (105, "u", "x\r\n\r\nWARC/1.1", None)]
    out += [(106, "u", ("\r\n" * 5 + TRAP * 4) * 50, None), (107, "u", "\r\n", None), (108, "u", "z" * 100_000, None), (109, "u", "z" * 100_000, None), (7, "again", "<p>0</p>", None), (110, "u", "k", None), (110, "u", "k", None), (None, "u", "<p>0</p>", None)]
    return out


def want(data):
    last = {}
    for p, _, h, _ in data:
        if p is not None:
            last[h or ""] = max(p, last.get(h or "", p))
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    return [(p, len((h or "").encode()), digest(h), "response" if p == last[h or ""] else "revisit", None if p == last[h or ""] else last[h or ""]) for p, _, h, _ in data]


@pytest.mark.parametrize("chunk", [7, 1000, warc.CHUNK])
def test_round_trip(spark, chunk):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df, chunk=chunk).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want(rows())))


def test_files_and_least(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA).coalesce(1)
    warc.write(df, str(tmp_path / "a"), least=10)
    text = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path / "a").glob("*.gz"))
    assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
    got = warc.report(warc.records(warc.read(spark, str(tmp_path / "a"))))
    small = [r for r in got.collect() if r.payload_bytes < 10]
    assert small and all(r.record_type == "response" for r in small)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_damage_is_seen(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "abc", None)], SCHEMA)
    warc.write(df, str(tmp_path / "a"), compression="none")
    part = next(Path(tmp_path / "a").glob("part-*"))
    part.write_bytes(part.read_bytes().replace(b"abc", b"abd"))
    for crc in Path(tmp_path / "a").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="broken block"):
        warc.read(spark, str(tmp_path / "a")).collect()
