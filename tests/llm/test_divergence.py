"""The divergence audit against plain Python over all pairs and terms, and its SQL."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from markloom.llm import divergence
from markloom.llm.common import blocks

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def expected(rows, min_docs, top):
    n, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in terms]
        groups[lang].add(source)
        n[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, x in df[lang].items() if x >= min_docs)
        v = len(kept)

        def shares(count, kept=kept, v=v):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * v) for t in kept}

        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def made(seed, n=300, sources=9, words=60):
    rng = random.Random(seed)
    vocab = [rng.choice(["ab", "Ü", "ß", "Σ", "x", "été", "Zz", "的"]) + chr(97 + k % 26) * (k // 26 + 1) for k in range(words)]
    rows = []
    for i in range(n):
        source, lang = rng.randrange(sources), rng.choice(["en", "de", None])
        mine = vocab[: 10 + 5 * source] if rng.random() < 0.7 else vocab
        text = " ".join(rng.choice(mine) + rng.choice(["", ".", "1", "-_-"]) for _ in range(rng.randrange(0, 40)))
        rows.append((i if i % 7 else None, rng.choice([text, text, text, None, ""]), lang, f"s{source}" if source else None, 0))
    return rows + rows[:20] + [(1, "alone", "fr", "only", 0), (2, None, "it", "a", 0), (2, None, "it", "b", 0)]


@pytest.mark.parametrize(("light_share", "tile"), [(8, (128, 2048)), (1, (2, 7)), (2, (3, 5)), (100, (1, 1)), (3, (4, 1000))])
def test_against_plain_sums(spark, light_share, tile):
    """Whatever is heavy or light, and however small the tiles."""
    rows = made(light_share)
    got = divergence.report(spark.createDataFrame(rows, SCHEMA), min_docs=6, top=5, light_share=light_share, tile=tile).collect()
    assert sorted(tuple(r) for r in got) == expected(rows, 6, 5)


def test_sql_agrees(spark):
    import duckdb

    rows = made(5, 400, 5, 20)
    documents = spark.createDataFrame(rows, SCHEMA).toArrow()  # noqa: F841
    want = duckdb.sql(divergence.SQL).fetchall()
    got = divergence.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) == expected(rows, 30, 50)


def test_no_rows_and_other_columns(spark):
    assert divergence.report(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = made(2, 60)
    extra = spark.createDataFrame([(*r, "x", 5, "y") for r in rows], f"{SCHEMA}, term string, n int, total string")
    assert sorted(tuple(r) for r in divergence.report(extra, min_docs=3).collect()) == expected(rows, 3, 50)


def test_long_texts_part_at_spaces():
    data = b"ab cd\tefgh  i " * 50 + b"x" * 300
    assert b"".join(blocks(data, 64)) == data
    assert [w for b in blocks(data, 64) for w in b.split()] == data.split()
