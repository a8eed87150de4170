import hashlib
import random

import numpy as np
import pytest
import xxhash

from markloom.llm import suffix_dedup as S


def brute(rows):
    signed = lambda t: (xxhash.xxh64_intdigest(t, 42) ^ 1 << 63) - (1 << 63)
    order = sorted({(i is None, i or 0, t) for i, t, *_ in rows if t is not None}, key=lambda k: (*k[:2], signed(k[2])))
    seen, out = {}, {}
    for key in order:
        data = key[2].encode()
        cover = bytearray(len(data))
        for a in range(len(data) - 99):
            w = data[a : a + 100]
            if w in seen:
                cover[a : a + 100] = b"\1" * 100
            seen.setdefault(w, 1)
        kept = bytes(b for b, c in zip(data, cover, strict=True) if not c)
        spans = sum(1 for k in range(len(cover)) if cover[k] and (not k or not cover[k - 1]))
        out[key] = (len(data), sum(cover), spans, hashlib.sha256(kept).hexdigest())
    empty = (0, 0, 0, hashlib.sha256(b"").hexdigest())
    return sorted(str((i, *(empty if t is None else out[i is None, i or 0, t]))) for i, t, *_ in rows)


def corpus():
    r = random.Random(11)
    text = lambda n, alpha="abcdefgh é日": "".join(r.choices(alpha, k=n))
    base = [text(n) for n in (90, 130, 400, 900, 2500)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(r.randint(0, 4)):
            b = r.choice(base)
            s = r.randrange(len(b))
            parts += [b[s : s + r.choice([60, 110, 300, 3000])], text(r.choice([0, 5, 80]))]
        rows.append((r.randrange(10**6) if i % 5 else i, "".join(parts), "x"))
    rows += [(50, "a" * 700, "x"), (51, "ab" * 400, "x"), (52, "a" * 99, "x"), (53, "\x00" * 250, "x"), (54, base[3], "x"), (55, base[3], "x"), (None, base[3], "x"), (None, base[3], "x"), (56, None, "x"), (57, "", "x"), (54, base[3] + "!", "x"), (54, base[3], "x")]
    rows += [(58, text(3000, "ab"), "x"), (59, (text(37) * 40), "x")]
    return rows


@pytest.mark.parametrize(("shard", "hot"), [(S.SHARD, S.HOT), (500, 40_000), (S.SHARD, 1)])
def test_equals_brute_force(spark, shard, hot):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string").repartition(3)
    got = sorted(str(tuple(r)) for r in S.report(df, shard, hot).collect())
    assert got == brute(rows)
    assert S.report(df.limit(0)).count() == 0
    assert S.deduplicate(df).count() == len(rows)


def test_blocks(monkeypatch):
    """Long texts in blocks give the fragments' windows just once."""
    x = np.frombuffer(random.Random(2).randbytes(5000), np.uint8)
    v, c, first, r, places = S.anchors(x, np.ones(len(x) - 99, bool))
    assert r.sum() == len(x) - 99 and (first[1:] == (first + r)[:-1]).all() and (places == 1).all()


def test_orders_and_merging():
    r = random.Random(4)
    frags = [bytes(r.choices(b"ab", k=r.randint(100, 140))) * r.choice([1, 2]) for _ in range(60)]
    frags += frags[:10]
    places = np.array(r.sample(range(10**6), len(frags)), np.int64) << 10
    want = []
    where = {}
    for f, p in zip(frags, places, strict=True):
        for k in range(len(f) - 99):
            where[f[k : k + 100]] = min(where.get(f[k : k + 100], 1 << 60), p + k)
    for f, p in zip(frags, places, strict=True):
        want.append([k for k in range(len(f) - 99) if p + k > where[f[k : k + 100]]])
    for shard in (1 << 20, 1000, 300):
        assert [o.tolist() for o in S.later_windows(frags, places, shard)] == want
