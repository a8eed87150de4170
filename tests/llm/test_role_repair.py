"""Role repair against a plain search over edits, whole conversations at a time."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from markloom.llm import role_repair

SPACE = " \t\n\x0b\x0c\r"


def spoilt(rows):
    """The rows of one conversation after damage, by turn."""
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(turn, role, text)] * (2 if fault == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def cheapest(rows):
    """Uniform-cost search over (rows read, roles made so far's state); no chart, no grammar table."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, made, out = heapq.heappop(heap)
        key = (at, made[-1:] if made != "s" else "s")
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", made):
            return cost, audit, out
        if (key, audit, cost) in done or any(d[0] == key and (d[2], d[1]) < (cost, audit) for d in done if d[0] == key):
            continue
        done.add((key, audit, cost))
        fits = lambda c: re.fullmatch("s?(ua)*u?", made + c) is not None
        for c, role in (("u", "user"), ("a", "assistant")):
            if fits(c) and not audit.endswith("IIII"):
                heapq.heappush(heap, (cost + 2, audit + "I", at, made + c, (*out, (role, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            late = fault == "t"
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, made, out))
            if fault not in "bd":
                if role[:1] and fits(role[:1]) and role[0] in "sua":
                    heapq.heappush(heap, (cost + late, audit + "K", at + 1, made + role[0], (*out, (role, text))))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if fits(c):
                        heapq.heappush(heap, (cost + 2 + late, audit + "R", at + 1, made + c, (*out, (name, text))))


def expected(conv, rows):
    after = spoilt(rows)
    seen, faults = set(), []
    for _, role, text in after:
        left = text.rstrip(SPACE)
        faults.append("b" if not left else "d" if (role, text) in seen else "o" if left[-1] in ".!?" else "t")
        seen.add((role, text))
    turns = {t for t, _, _ in after if t is not None}
    cost, audit, out = cheapest([(r, x, f) for (_, r, x), f in zip(after, faults, strict=True)])
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(after, after[1:], strict=False))
    text = "\n".join(f"{r}:{x}" for r, x in out)
    return conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def made(seed, n):
    rng, rows = random.Random(seed), []
    for conv in [*range(n), None, -7]:
        for turn in range(rng.randrange(1, 9)):
            text = rng.choice(["Hello there.", "what now", "Fine!", "ok?", " \t", "", None, "ünï cödé. ", "cut off,", f"said {turn}."])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "unknown"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role, text))
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def held(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    return sorted((expected(c, x) for c, x in by.items()), key=str)


def test_against_search(spark):
    rows = made(3, 150)
    got = sorted((tuple(r) for r in role_repair.report(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == held(rows)


@pytest.mark.parametrize("size", [1, 2, 3])
def test_conversations_over_many_chunks(spark, size):
    """Chunks of a few rows, dealt out over many ranges, give what whole conversations give."""
    rows = [(5, t, ("user", "assistant", "assistant", "system")[t * 7 % 4], f"line {t % 9}{'.' if t % 4 else ''}") for t in range(40)] + made(11, 8)
    table = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in role_repair.report(table, size).collect()), key=str) == held(rows)


def test_repaired_rows_are_what_is_hashed(spark):
    table = spark.createDataFrame(made(4, 30), SCHEMA)
    hashes = {r.conv_id: r.repaired_sha256 for r in role_repair.report(table).collect()}
    texts = {}
    for r in sorted(role_repair.repaired(table, 2).collect(), key=lambda r: (str(r.conv_id), r.position)):
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, sha in hashes.items():
        assert hashlib.sha256("\n".join(texts.get(conv, [])).encode()).hexdigest() == sha


def test_the_damage_can_drop_all(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = role_repair.report(spark.createDataFrame([(conv, 0, "user", "Hi.")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_no_rows_and_other_columns(spark):
    assert role_repair.report(spark.createDataFrame([], SCHEMA)).count() == 0
    extra = spark.createDataFrame([(*r, "x", 1) for r in made(6, 10)], f"{SCHEMA}, seq string, n int")
    assert sorted((tuple(r) for r in role_repair.report(extra).collect()), key=str) == held(made(6, 10))
