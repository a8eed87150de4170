import hashlib
import re
from collections import Counter, defaultdict

from markloom.llm import quality_rules as Q

SCHEMA = "doc_id long, source string, text string, kept string"


def brute(rows):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_frequent_words, kept of each row."""
    norm = lambda x: " ".join(re.findall(r"[0a-z\x80-\U0010ffff]+", re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), x))))
    docs, holders = [], defaultdict(set)
    name = lambda i, text: (i is None, i or 0, hashlib.md5((text or "").encode()).hexdigest())
    for i, host, text, _ in rows:
        lines = [(norm(x), len(re.findall(r"[^\x20\x09-\x0D]+", x))) for x in (text or "").split("\n") if norm(x)]
        docs.append(lines)
        for x, _ in lines:
            holders[host, x].add(name(i, text))
    frequent = {k: min(v) for k, v in holders.items() if len({t for *_, t in v}) > Q.LIMIT_DOCS}
    out = []
    for (i, host, text, _), lines in zip(rows, docs, strict=True):
        old, text = text, text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        same = Counter(x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
        lost = sum(n for x, n in lines if frequent.get((host, x), name(i, old)) != name(i, old))
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        out.append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(same.values()) - len(same), len(cover), lost, not failed and len(w) - lost >= 0.5 * len(w)))
    return out


def corpus():
    word = lambda i, k: f"w{i}x{k}"
    body = lambda i, n: "\n".join(" ".join(f"t{chr(97 + i % 26)}{chr(97 + j)}{chr(97 + k)}{chr(97 + i // 26)}" for k in range(10)) for j in range(n))
    menu = "Home | About | Contact " + " ".join(word(i, 0) for i in range(60))
    rows = [(i, "hot", f"{body(i, 6)}\n{menu}\n{body(i + 90, 2)}", None) for i in range(30)]  # frequent, not depleted
    rows += [(100 + i, "hot", f"{body(i + 200, 1)}\n{menu}\n{body(i + 300, 1)}", None) for i in range(30)]  # depleted
    rows += [(200 + i, "hot", body(500, 9), None) for i in range(40)]  # copies are left alone
    rows += [(400 + i, "near", f"{body(700, 12)}\nedit{chr(97 + i)}", None) for i in range(15)]  # near copies
    rows += [(300, None, None, None), (301, None, "", None), (302, "a", "a b c " * 40, None), (303, "b", "é # * & \n x\n x\n\n" * 3, None), (None, "hot", body(7, 6), None), (None, "hot", body(7, 6), None), (304, "long", " ".join(map(str, range(60000))), None)]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_frequent_words, r.kept) for r in Q.report(df).collect()]
    want = [(r[0], *b) for r, b in zip(rows, brute(rows), strict=True)]
    assert sorted(got, key=key) == sorted(want, key=key)
    verdict = {w[0]: w[-1] for w in want}
    assert all(verdict[i] for i in range(30)) and not any(verdict[100 + i] for i in range(30)) and all(verdict[200 + i] for i in range(40))
    assert verdict[400] and not any(verdict[400 + i] for i in range(1, 15))  # of near copies the first is kept
    kept = Q.clean(df)
    assert kept.columns == df.columns and kept.count() == sum(w[-1] for w in want)


def test_block_of_lines(spark):
    """200 unlike documents of one host with the same three lines: all three go, from all but the first; every document stays."""
    letters = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    block = ["a first line of the block", " ".join(f"middle{letters(k)}" for k in range(63)), "the last line of the block"]
    rows = [(i, "h", "\n".join([" ".join(f"own{letters(i * 1000 + k)}" for k in range(90)), *block, f"end{letters(i)}"]), None) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in Q.report(df).collect()}
    lost = sum(len(x.split()) for x in block)
    assert [got[i].n_frequent_words for i in range(200)] == [0] + [lost] * 199 and all(got[i].kept for i in range(200))
    out = {r.doc_id: r.text for r in Q.clean(df).collect()}
    assert len(out) == 200 and out[0] == rows[0][2] and all(not set(block) & set(out[i].split("\n")) and len(out[i].split("\n")) == 2 for i in range(1, 200))


def test_lines_removed_and_empty(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    out = {r.doc_id: r.text for r in Q.clean(df, reject=False).collect()}
    assert len(out) == len({r[0] for r in corpus()}) and "Home" in out[0] and "Home" not in out[1] and len(out[1].split("\n")) == 8 and out[300] is None
    assert Q.report(df.limit(0)).count() == 0 and Q.clean(df.limit(0)).count() == 0
