import hashlib
import random

import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P
import tiktoken

from markloom.llm import byte_bpe as B

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})


def texts():
    r = random.Random(8)
    out = [None, "", " ", "a", "  a\n\n b\t", "<|endoftext|>", "\x00\x7f", "🎉🎉é日本語", "a" * 3000, "ab" * 999, " " * 500, "x y " * 30000]
    for k in range(400):
        out.append("".join(chr(r.choice([r.randint(0, 127), r.randint(97, 110), r.randint(128, 0x2FFF), r.randint(0x1F300, 0x1F6FF)])) for _ in range(r.randint(0, 80))))
    return out


def test_like_the_library(library):
    codec = B.Codec(library._mergeable_ranks, P.PATTERN)
    for limit in (50, B.STATES):
        codec.live = None
        codec.parts()[0].limit = limit
        for t in texts():
            ids = b"".join(codec.encode(t))
            assert memoryview(ids).cast("I").tolist() == library.encode_ordinary(t or "")
            assert codec.decode(ids) == (t or "").encode()


def test_stream_at_every_cut():
    data = "aé日🎉z".encode()
    for i in range(len(data)):
        for j in range(i, len(data)):
            s = B.Utf8Stream()
            assert s.feed(data[:i]) + s.feed(data[i:j]) + s.feed(data[j:]) + s.feed(b"", True) == data.decode()
    s = B.Utf8Stream()
    assert s.feed(b"a\xff\xe6\x97") + s.feed(b"", True) == b"a\xff\xe6\x97".decode("utf-8", "replace")


def test_jobs(spark, library):
    rows = [(i % 300, t, "x") for i, t in enumerate(texts())] + [(None, "same", None), (None, "same", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(B.digests(df, PATH, P.PATTERN).collect(), key=str)
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert [tuple(g) for g in got] == sorted(want, key=lambda w: str(B_row(w)))
    back = B.decode(B.encode(df, PATH, P.PATTERN), PATH, P.PATTERN)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in back.collect()) == sorted((i is None, i or 0, t or "") for i, t, _ in rows)
    assert B.digests(df.limit(0), PATH, P.PATTERN).count() == 0


def B_row(w):
    from pyspark.sql import Row

    return Row("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")(*w)
