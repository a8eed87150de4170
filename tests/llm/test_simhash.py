import random
import re

import numpy as np
import pytest
import xxhash

import test_near_duplicates as near

from markloom.llm import simhash as S


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def slow_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_fingerprint():
    r = random.Random(2)
    for t in [None, "", " \n", "One", "one TWO", "É A b c", "a b c d " * 9000, *[" ".join(r.choices(["aB", "é", "x", "yz"], k=r.randint(1, 60))) for _ in range(60)]]:
        assert S.fingerprint(t) == slow_fingerprint(t)


@pytest.mark.parametrize("dense", [1024, 3])
def test_links_join_what_all_pairs_join(spark, dense):
    r = random.Random(dense)
    fps = [r.getrandbits(64) for _ in range(150)]
    for base in fps[:20]:
        for _ in range(8):
            x = base
            for _ in range(r.randint(1, 4)):
                x ^= 1 << r.randrange(64)
            fps.append(x)
    fps += [fps[0] ^ (m << 40) for m in range(40)]  # many in one segment
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from markloom.llm.common import components

    got = {r.node: r.root for r in components(S.links(spark.createDataFrame([(f,) for f in signed], "fp long"), dense)).collect()}
    want = slow_components(fps)
    classes = lambda m: sorted(sorted(x for x in m if m[x] == y) for y in set(m.values()))
    assert classes({s: got.get(s, s) for s in signed}) == sorted(sorted(f - (1 << 64) if f >> 63 else f for f in c) for c in classes(want))


def test_forest_of_large_buckets():
    r = np.random.default_rng(1)
    fp = np.unique(r.integers(0, 1 << 12, 1500))
    a, b = S._forest(np.full(len(fp), 7 << 2 | 2), fp, 3)
    assert len(a) == len(fp) - 1 and (np.bitwise_count((a ^ b).view(np.uint64)) <= 64).all()


def corpus():
    r = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(12):
        t = r.choices(words, k=300)
        rows.append((i * 10, " ".join(t), "x"))
        for k in range(4):
            u = list(t)
            u[r.randrange(300)] = "edit"
            rows.append((i * 10 + k + 1, " ".join(u).upper() if k == 3 else " ".join(u), "x"))
    return rows + [(500, None, None), (501, "", None), (None, " ", None), (None, rows[0][1], None), (0, rows[0][1], "again"), (502, "very long " * 40000, None)]


def test_report_and_deduplicate(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    fps = [slow_fingerprint(t) if len(t or "") < 9000 else S.fingerprint(t) for _, t, _ in rows]
    comp = slow_components(sorted(set(fps)))
    least = {}
    for (i, _, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    want = sorted((str(i), f"{f:016x}", str(least[comp[f]])) for (i, _, _), f in zip(rows, fps, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in S.report(df).collect()) == want
    out = S.deduplicate(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=near.last) == near.slow_stay([(i, t) for i, t, _ in rows])[0]  # five words, similarity 0.8
    assert S.report(df.limit(0)).count() == 0 and S.deduplicate(df.limit(0)).count() == 0
