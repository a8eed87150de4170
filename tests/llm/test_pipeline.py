import hashlib

import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P
import test_line_dedup as lines
import test_near_duplicates as near
import test_quality_rules as quality
import tiktoken

import corpus_pipeline
from markloom.llm import byte_bpe, decontaminate

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    word = lambda i, k: f"w{i}q{k}"
    rows = []
    for i in range(24):
        body = [" ".join(word(i, 20 * j + k) for k in range(20)) for j in range(5)]
        rows.append((i, "\n".join(body)))
        if i % 4 == 0:  # a copy, a near copy, one that shares a line
            rows.append((100 + i, "\n".join(body)))
            rows.append((200 + i, " ".join(" ".join(body).split()[:-1])))
            rows.append((300 + i, "\n".join([body[2], *[" ".join(word(i + 500, 20 * j + k) for k in range(20)) for j in range(4)]])))
    rows += [(400, None), (401, ""), (402, "too short"), (403, "a b c " * 60)]
    rows += [(404, " ".join(word(900, k) for k in range(70)) + " " + "one two three four five six seven eight nine ten")]
    return [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in rows]


def test_like_brute_force(spark, tmp_path):
    rows, bench = documents(), [(1, "One, two three four five six seven eight nine ten!")]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    verdicts = quality.brute([(i, s, t, None) for i, t, _, s, _ in rows])
    left = [(i, t, "x") for (i, t, *_), v in zip(rows, verdicts, strict=True) if v[-1]]
    assert 0 < len(left) < len(rows)
    after = []
    for (i, t, _), (_, _, gone, digest) in zip(left, lines.brute(left), strict=True):
        w = None if not gone else next(x for x in candidates(t, left, i) if hashlib.sha256(x.encode()).hexdigest() == digest)
        if w is None or w.split():
            after.append((i, t if w is None else w))
    assert len(after) < len(left)
    stay, _ = near.slow_stay(after)
    first = [(i, t) for i, t in after if i in set(stay)]
    clean = [(i, t) for i, t in first if not any(set(decontaminate.item_windows(b, 10)) & set(decontaminate.item_windows(t, 10)) for _, b in bench)]
    assert len(clean) < len(first) < len(after)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for i, t in clean:
        ids = lib.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)


def candidates(text, docs, i):
    """What the brute force may have kept of a text: any of its lines."""
    parts = text.split("\n")
    for mask in range(1 << len(parts)):
        yield "\n".join(x for k, x in enumerate(parts) if mask >> k & 1)


def test_stages_return_documents(spark, tmp_path):
    extra = spark.createDataFrame([(*r, "y", 1) for r in documents()], f"{COLUMNS}, kept string, fp int")
    spark.createDataFrame([(1, "nothing at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, extra, str(tmp_path)).schema.names == extra.schema.names, name
        assert stage(spark, extra.limit(0), str(tmp_path)).count() == 0
