import random
import re

import corpus_pipeline
from markloom.llm import near_duplicates as N
from markloom.llm import simhash


def slow_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def last(d):
    return d is None, d or 0


def slow_stay(rows):
    """The doc_ids that stay, by comparing all pairs."""
    sets, root = [slow_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted((min(g, key=last) for g in groups.values()), key=last), groups


def corpus():
    r = random.Random(11)
    words = [f"W{i}" for i in range(3000)]
    passage = r.choices(words, k=120)
    rows = []
    for i in range(30):
        t = r.choices(words, k=r.choice([4, 5, 6, 30, 200, 300]))
        rows.append([i * 20, t])
        for k in range(r.randint(0, 9)):  # around the limit
            u = list(t)
            for _ in range(r.randint(0, max(1, len(t) // 40))):
                u[r.randrange(len(u))] = f"edit{r.randrange(50)}"
            rows.append([i * 20 + k + 1, u[r.randint(0, 2) :] + r.choices(words, k=r.randint(0, 12))])
    rows += [[1000 + i, passage + r.choices(words, k=r.choice([15, 25, 60]))] for i in range(50)]  # a common passage
    rows = [(d, " ".join(t)) for d, t in rows]
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (None, rows[0][1]), (2003, rows[3][1].lower()), (None, "none like this")]


def test_deduplicate_like_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, groups = slow_stay(rows)
    assert len(want) < len(rows) and max(map(len, groups.values())) > 5
    out = simhash.deduplicate(df)
    assert out.columns == df.columns and sorted((r.doc_id for r in out.collect()), key=last) == want
    assert simhash.deduplicate(df.limit(0)).count() == 0


def test_repeated_rows_and_other_columns(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (None, "other", "z"), (None, "other", "z"), (2, "A b c d e f g", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, copies string")
    out = simhash.deduplicate(df)
    assert out.columns == df.columns and sorted((r.doc_id is None, r.doc_id) for r in out.collect()) == [(False, 1), (True, None)]
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in simhash.deduplicate(df.repartition(3)).collect()}


def test_pipeline_stage_finds_pairs_at_four_fifths(spark, tmp_path):
    r = random.Random(5)
    t = [f"v{i}" for i in range(104)]  # 100 shingles
    u = list(t)
    u[50] = u[70] = "edit"  # 90 common ones: 90 / 110
    v = list(t)
    v[30] = v[50] = v[70] = "edit"  # 85 / 115 with t, and 90 / 110 with u: linked through it
    w = [r.choice(t) for _ in t]
    df = spark.createDataFrame([(i, " ".join(x), "en", "s", 1) for i, x in enumerate((t, u, v, w))], "doc_id long, text string, lang string, source string, n_chars long")
    stage = corpus_pipeline.STAGES[2][1]
    assert sorted(x.doc_id for x in stage(spark, df, str(tmp_path)).collect()) == [0, 3]
    assert sorted(x.doc_id for x in stage(spark, df.where("doc_id <> 1"), str(tmp_path)).collect()) == [0, 2, 3]


def test_bit_maps_bound_the_difference():
    r = random.Random(3)
    for _ in range(300):
        x = [f"w{r.randrange(400)}" for _ in range(r.choice([1, 5, 7, 60, 300]))]
        y = [w for w in x if r.random() > 0.1] + [f"v{k}" for k in range(r.randrange(30))]
        a, b = N.shingles(" ".join(x)), N.shingles(" ".join(y))
        apart = N.apart(N.bit_map(a), N.bit_map(b))
        assert apart <= len(set(a.tolist()) ^ set(b.tolist())) and N.apart(N.bit_map(a), N.bit_map(a)) == 0


def test_a_crowded_shingle_makes_few_pairs(spark, monkeypatch):
    """One common passage of five words in 1,500 unlike texts, some of them with a near copy: no pairs of all, no link lost."""
    r = random.Random(21)
    rows = []
    for i in range(1500):
        words = [f"w{r.randrange(10**6)}" for _ in range(40)]
        words[10:15] = ["one", "common", "run", "of", "words"]
        rows.append((2 * i, " ".join(words)))
        if i % 50 == 0:
            rows.append((2 * i + 1, " ".join(words[:-1])))
    met, counted = N.across, []

    def across(members):
        pairs = met(members)
        counted.append(pairs.count())
        return pairs

    monkeypatch.setattr(N, "across", across)
    monkeypatch.setattr(N, "COUNTERS", 1 << 2)  # an order that keeps no boilerplate out of prefixes
    stays = {x.doc_id for x in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert stays == {d for d, _ in rows if d % 2 == 0} and sum(counted) < 4 * len(rows)


def test_clashing_names_and_long_texts(spark):
    rows = [(1, "a b c d e f g", 5, 6), (2, "A b c d e f g", 7, 8), (3, "x " * 50, 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, of_id int, of_node int")
    assert sorted(map(tuple, simhash.deduplicate(df).collect())) == [rows[0], rows[2]]
    words = [f"w{i % 977}" for i in range(400_000)]
    assert set(N.shingles(" ".join(words)).tolist()) == set(N.shingles(" ".join(words[: 977 + 8])).tolist())
