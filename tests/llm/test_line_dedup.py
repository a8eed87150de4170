import hashlib
import random
import re

from markloom.llm import line_dedup as L

SCHEMA = "doc_id long, text string, gone string"


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
    return row[-1]


def test_parts():
    r = random.Random(1)
    for _ in range(1500):
        a = [bytes([97 + r.randrange(3)]) for _ in range(r.randint(8, 12))]
        b = list(a)
        for _ in range(r.randint(0, 2)):
            k = r.randrange(3)
            i = r.randrange(len(b))
            b[i : i + (k != 0)] = [] if k == 1 else [b"z" if r.random() < 0.5 else b"a"]
        near = slow_distance(a, b) <= 1
        assert L.within_one(a, b) == near
        if near and min(len(a), len(b)) >= 8:
            assert set(L.half_keys(a)) & set(L.half_keys(b))
            va, vb = L.variants(a), L.variants(b)
            assert len({v for v, _ in va}) <= len({tuple(a[:p] + a[p + 1 :]) for p in range(len(a))}) + 1
            assert {x for x in va if x[1] >= 0} & {x for x in vb if x[1] >= 0} or {va[0][0]} & {v for v, _ in vb} or {vb[0][0]} & {v for v, _ in va}


def corpus():
    r = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    base = [r.choices(words, k=n) for n in (5, 6, 8, 9, 10, 14) for _ in range(5)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(0, 7)):
            x = list(r.choice(base))
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
                k = r.randrange(len(x))
                x[k : k + r.randint(0, 1)] = r.choice([[], ["new"], ["New"], [r.choice(words)]])
            lines.append(r.choice([" ".join(x), "  ".join(x).upper(), " ".join(x) + " "]))
        docs.append((i, "\n".join([*lines, r.choice(["", "short line", " ", "Short  LINE", "x"]), r.choice(["每行都没有空格的一句长话要被去重才对呀", "每行都没有空格的一句长话要被去掉才对呀", "没有空格的另一句长话不该同前面那句混在一起", "a chapter of five words", "a chapter of five sword"])]), "x"))
    docs += [(None, docs[7][1], None), (None, docs[7][1], None), (3, docs[3][1], "again"), (90, None, None), (91, "", None), (92, " ".join(f"w{k}" for k in range(30000)) + "\n" + " ".join(f"w{k}" for k in range(1, 30000)) + "\n" + "a b c d e f g h\n" * 30, None)]
    return docs


def brute(rows):
    place = lambda i, t: (i is None, i or 0)
    words = lambda x: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", x)]
    lines = [(place(i, t), k, words(x)) for i, t, _ in rows if t is not None for k, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]

    def near(v, w):
        if abs(len(v) - len(w)) <= 1 and (len(v) >= 8 or len(w) >= 8) and slow_distance(v, w) <= 1:
            return True
        a, b = " ".join(v), " ".join(w)
        return (len(v) < 8 or len(w) < 8) and (len(a) >= 16 or len(b) >= 16) and abs(len(a) - len(b)) <= 1 and slow_distance(a, b) <= 1

    out = []
    for i, t, _ in rows:
        kept = []
        for k, x in enumerate((t or "").split("\n")):
            w = words(x)
            mine = (place(i, t), k)
            gone = w and any((p, j) < mine and (v == w or near(v, w)) for p, j, v in lines)
            kept += [] if gone else [x]
        n = 0 if t is None else t.count("\n") + 1
        out.append((str(i), n, n - len(kept) if t is not None else 0, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_no_gap_between_sizes(spark):
    """Lines on both sides of every bound meet, in either order."""
    eight, seven = "one two three four five six seven eight", "one two three four five six seven"
    pairs = [(eight, seven), (eight, "one two three four five six seveneight"), (eight, "one two three four five six seven,eight"), ("fifteen letters", "fifteen lettersx"), ("没有空格的一句话正好有十五个字", "没有空格的一句话正好有十五个字呀"), (eight + " nine", eight)]
    apart = [(seven, "one two three four five six other"), ("fourteen chars", "fourteen charsx"), ("fifteen letters", "fifteen letterz"), (eight, "one two three four five seven"), (eight + " nine", "one two three four five six seveneight nine")]
    for both, n in ((pairs, 1), (apart, 0)):
        for a, b in both:
            for first, second in ((a, b), (b, a)):
                rows = [(1, first, None), (2, second, None)]
                assert [r[2] for r in brute(rows)] == [0, n]
    for turned in (False, True):
        for k, (a, b) in enumerate([*pairs, *apart]):
            rows = [(1, b if turned else a, None), (2, a if turned else b, None)]
            w = [L.normal(t.encode()) for _, t, _ in rows]
            assert L.near(*w) == (k < len(pairs))
            shared = [{key for form in L.forms(x) for key in L.half_keys(*form)} for x in w]
            assert not L.near(*w) or shared[0] & shared[1]
    every = [(10 * k + j, t, None) for k, p in enumerate([*pairs, *apart]) for j, t in enumerate(p)]
    df = spark.createDataFrame(every, SCHEMA).repartition(3)
    assert sorted((str(r.doc_id), r.n_lines, r.n_removed, r.kept_sha256) for r in L.report(df).collect()) == sorted(brute(every))


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute([r for r in rows if r[0] != 92])
    got = [(str(r.doc_id), r.n_lines, r.n_removed, r.kept_sha256) for r in L.report(df).collect()]
    assert sorted(x for x in got if x[0] != "92") == sorted(want)
    assert next(x for x in got if x[0] == "92")[2] == 30
    out = L.deduplicate(df)
    assert out.columns == df.columns
    texts = sorted(str((r.doc_id, r.text)) for r in L.deduplicate(df, drop_emptied=False).collect())
    assert len(texts) == len(rows) and out.count() < len(rows)
    assert L.report(df.limit(0)).count() == 0 and L.deduplicate(df.limit(0)).count() == 0
