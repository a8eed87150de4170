import hashlib
import random
import tracemalloc

import pytest

from markloom.llm import decontaminate as D

DOCS = "doc_id long, text string, n_hit string"


def plain_words(text):
    """Runs of ASCII letters and digits and of all other signs beyond ASCII, A-Z in lower case."""
    out, run = [], ""
    for c in (text or "") + " ":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c > "\x7f" or "a" <= c <= "z" or "0" <= c <= "9":
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def brute(docs, items, n=10):
    """(words, words hit, items, their digest) of each document, by comparing every place with every window."""
    windows = []
    for k, t in items:
        w = plain_words(t)
        windows += [(w[i : i + n], "" if k is None else str(k)) for i in range(max(1, len(w) - n + 1)) if w]
    out = []
    for _, t, *_ in docs:
        w, hit, found = plain_words(t), set(), set()
        for win, k in windows:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(k)
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


def corpus():
    r = random.Random(4)
    vocab = ["a", "bb", "Ünd", "c1", "日本", "x"]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([0, 1, 3, 10, 12])))) for i in range(12)] + [(99, None), (5, "a a a a a a a a a a"), (None, "x x x x x x x x x x")]
    docs = [(i, ", ".join(r.choices(vocab, k=r.choice([0, 2, 9, 40])) + [items[i % 12][1]]), "extra") for i in range(60)]
    docs += [(None, "a a a a a a a a a a a", None), (3, docs[3][1], None), (70, None, None), (71, "", None), (72, "A A-a a_a a a a a a é!" + " a" * 5000, None)]
    return docs, items


@pytest.mark.parametrize("limit", [D.MAX_BYTES, 0])
def test_equals_brute_force(spark, limit):
    docs, items = corpus()
    df, bench = spark.createDataFrame(docs, DOCS).coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in D.report(df, bench, max_bytes=limit).collect())
    assert got == sorted((d is None, d or 0, *b) for (d, *_), b in zip(docs, brute(docs, items), strict=True))
    kept = D.decontaminate(df, bench, max_bytes=limit)
    assert kept.columns == df.columns
    assert kept.count() == sum(not b[1] for b in brute(docs, items))
    cleaned = D.decontaminate(df, bench, "spans", max_bytes=limit)
    assert cleaned.count() == len(docs)


def test_spans_and_empty(spark):
    df = spark.createDataFrame([(1, "Keep this. one TWO three four five six seven eight nine ten! and that", None)], DOCS)
    bench = spark.createDataFrame([(7, "One two three four five six seven eight nine ten")], "item_id long, text string")
    assert D.decontaminate(df, bench, "spans").first().text == "Keep this. ! and that"
    assert D.report(df, bench.limit(0)).first().contaminated is False
    assert D.report(df.limit(0), bench).count() == 0


def test_estimate_holds():
    """The index is no larger than the estimate that decides on its broadcast, for short and long, few and many words."""
    r = random.Random(2)
    for vocab, size in ((200, 3), (60000, 9), (60000, 40)):
        items = [(i, " ".join(f"{r.randrange(vocab):0{size}d}" for _ in range(60))) for i in range(1000)]
        words = [w for _, t in items for w in t.split()]
        tracemalloc.start()
        index = D.Index(items)
        real = tracemalloc.get_traced_memory()[0]
        tracemalloc.stop()
        estimate = D._WORD_BYTES * len(words) + D._VOCABULARY_BYTES * len(set(words)) + sum(map(len, words))
        assert max(real, index.nbytes) <= estimate, (vocab, size, real, index.nbytes, estimate)
