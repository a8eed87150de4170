import random

import pytest

P = pytest.importorskip("public_tokenizers")
import sentencepiece

from markloom.llm import token_counts as T

PATH = P.path("piece_bpe_32k.model")


def texts():
    r = random.Random(5)
    out = [None, "", " ", "   ", "a", " a  b ", "▁a ▁", "<s> </s> <0x41>", "\x00\r\n\t", "ab" * 2000, " " * 70, "-" * 300, "日本語" * 40, "word " * 20000]
    for k in range(300):
        out.append("".join(r.choice("aeinrst   the▁0189é日🎉\n-=") for _ in range(r.randint(0, 90))))
    return out


def test_like_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(None, "same text", 2), (None, "same text", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = T.token_counts(df, PATH)
    want = [(i is None, i or 0, len((t or "").encode()), len(lib.encode(t or "")), len(lib.encode(t or "")) > 4096) for i, t, _ in rows]
    assert sorted((g.doc_id is None, g.doc_id or 0, g.n_bytes, g.n_tokens, g.over_limit) for g in got.collect()) == sorted(want)
    assert T.token_counts(df.limit(0), PATH).count() == 0


def test_small_models():
    m = T.Merger([("a", 900), ("b", 901), ("c", 902), ("ab", 5), ("abc", 3), ("bc", 9), (" ", 903), ("  ", 1000), (" a", 2)])
    # abc ranks below ab, its part: the left pair first, then abc, before the next ab
    assert m.counts(["abcabc", "ab", "xé", " a"]).tolist() == [2, 1, 3, 1]
    with pytest.raises(ValueError):
        T.Merger([("a b", 1)])
