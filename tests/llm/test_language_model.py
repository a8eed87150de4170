"""The language model: base scores by plain sums, probabilities that sum to one, scores recomputed token by token."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from markloom.llm import language_model as lm

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def made(seed, n=400):
    rng = random.Random(seed)
    langs = [[f"{p}{k}" for k in range(40)] for p in ("the", "Der", "ñu", " x")]
    rows = []
    for i in range(n):
        vocab = rng.choice(langs)
        text = rng.choice([" ", "\n\t "]).join(rng.choices(vocab, range(40, 0, -1), k=rng.randrange(0, 60)) + [f"rare{rng.randrange(10**4)}"])
        rows.append((i, rng.choice([text] * 8 + [None, ""]), "", "", 0))
    return rows + [(None, "null id. Z" + "q" * 300, "", "", 0)] * 2 + [(3, "Repeated " * 4000, "", "", 0)] * 2


def base(rows):
    n = Counter(t for r in rows if not out(r[0]) for t in tokens(r[1]))
    total, v = sum(n.values()), len(n)
    return n, total, [(r[0], out(r[0]), len(tokens(r[1])), sum(n[t] > 0 for t in tokens(r[1])), total, sum(math.log10((n[t] + 0.1) / (total + 0.1 * (v + 1))) for t in tokens(r[1]))) for r in rows]


def key(r):
    return str(r[0]), *r[1:]


@pytest.mark.parametrize("dictionary", [1 << 16, 3, 100])
def test_base_scores(spark, monkeypatch, dictionary):
    """By the broadcast dictionary or by the join, the same sums; untrained, the model is the base."""
    monkeypatch.setattr(lm, "DICTIONARY", dictionary)
    rows = made(1)
    got = sorted((tuple(r) for r in lm.report(spark.createDataFrame(rows, SCHEMA), rounds=0).collect()), key=key)
    want = sorted(base(rows)[2], key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert [g[6] for g in got] == pytest.approx([g[5] for g in got], rel=1e-5)


def trained(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    training = docs.where(~lm.held_out())
    vocab = lm.vocabulary(lm.token_counts(training))
    return vocab, lm.train(training, vocab)


def test_probabilities_sum_to_one_and_scores_are_theirs(spark):
    """Every word's probability by plain sums over the definition, for histories of the texts."""
    rows = made(2, 200)
    vocab, weights = trained(spark, rows)
    known = {lm.token_key(t.encode()): x for t, x in base(rows)[0].items()}
    class_bias, word_bias = vocab.biases()
    size = lm.CLASSES * lm.WIDTH
    model = [w for w, i in vocab.ranks.items() if i < size]

    def hashed(w):
        return vocab.ranks[w] + 7 if w in vocab.ranks else zlib.crc32(w) | 1 << 32

    def softmax(z):
        e = np.exp(np.float64(z) - np.float64(z).max())
        return e / e.sum()

    def distribution(first, second):
        f = lm.histories(np.array([[first, second]], np.int64))[0]
        classes = softmax(class_bias + sum(weights.of_class[int(x) % lm.CLASS_ROWS] for x in f[:2]))
        of = {}
        for c in range(lm.CLASSES):
            at = [int(lm._mixed(np.array([x]) + np.uint64(c), 4)[0]) % lm.WORD_ROWS for x in f]
            inside = softmax(word_bias[c] + sum(weights.of_word[a] for a in at))
            of |= {w: classes[c] * inside[vocab.ranks[w] % lm.WIDTH] for w in model if vocab.ranks[w] // lm.WIDTH == c}
        rest = {k: x for k, x in known.items() if k not in of}
        whole = sum(rest.values()) + 0.1 * (len(rest) + 1)
        return of | {w: classes[-1] * (x + 0.1) / whole for w, x in rest.items()} | {None: classes[-1] * 0.1 / whole}

    memo = {}
    got = {r.doc_id: r.score for r in lm.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    for doc_id, text, *_ in [r for r in rows if r[0] is not None and r[0] != 3][:12]:
        before, want = [lm._START, lm._START], 0.0
        for t in tokens(text):
            k = before[-1], before[-2]
            if k not in memo:
                memo[k] = distribution(*k)
                assert sum(memo[k].values()) == pytest.approx(1, abs=1e-5)
            want += math.log10(memo[k].get(lm.token_key(t.encode()), memo[k][None]))
            before.append(hashed(t.encode()))
        assert got[doc_id] == pytest.approx(want, rel=1e-4)


def test_learns_what_the_base_cannot(spark):
    rows = made(3, 900)
    got = [r for r in lm.report(spark.createDataFrame(rows, SCHEMA)).collect() if r.held_out and r.n_tokens > 5]
    assert len(got) > 30 and sum(r.score for r in got) > 0.95 * sum(r.base_score for r in got)


def test_no_rows_nothing_to_learn_and_other_columns(spark):
    assert lm.report(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = next(k for k in range(99) if out(k))
    r = lm.report(spark.createDataFrame([(alone, "a b", "", "", 0)], SCHEMA)).collect()[0]
    assert tuple(r)[:5] == (alone, True, 3, 0, 0) and (r.base_score, r.score) == pytest.approx((0, 0))
    rows = made(5, 40)
    extra = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], f"{SCHEMA}, token string, row int, score string")
    assert sorted((tuple(r)[:5] for r in lm.report(extra, rounds=0).collect()), key=key) == sorted((w[:5] for w in base(rows)[2]), key=key)
