"""Grounding against plain Python that looks at one question after the other, and known declines."""

import random
import re

import pytest
from test_phrases import alone

from markloom.operators import grounding as G

CONCEPTS = [(1, "iron", "metal", "fe_alloy"), (2, "iron ore", "metal", "ore"), (3, "copper", "metals", "ore"), (4, "copper", "metal", "cu_alloy"), (5, "quartz", "category", "metal"), (6, "water", "glass", "sea_water"), (7, "a", "b", "")]
MEMBERS = [(10, 1), (11, 2), (12, 3), (13, 4), (14, 5), (14, 5), (15, 7)]
PIECES = ["iron", "iron ore", "quartz", "copper", "water", "metal", "metals", "ore", "fe alloy", "fe_alloy", "categories", "category", "fine: ore", "fine  ore", "coarse category", "Coarse: categories", "fine", "coarse: ore", "glass", "glass", "(", ")", "-", ".", "is", "of", "a"]


def places(text, phrase):
    return [m.span() for m in re.finditer(re.escape(phrase), text) if alone(text, *m.span())] if phrase else []


def ways(level, label):
    plural = label[:-1] + "ies" if label.endswith("y") else label if label.endswith("s") else label + "s"
    return {label, label.replace("_", " ")} | ({plural} if level == "coarse" else set())


def targets(text):
    labels = {("coarse", c[2]) for c in CONCEPTS} | {("fine", c[3]) for c in CONCEPTS if c[3]}
    asked = list(re.finditer(r"(?i)(?<!\w)(fine|coarse)(?!\w)(?:\s*:\s*|\s+)", text))
    rows = set()
    for q in asked:
        met = {(level, label, text[q.start() : b], q.start(), b) for level, label in labels if level == q[1].lower() for w in ways(level, label) for a, b in places(text, w) if a == q.end() and (q.start(), b) in places(text, text[q.start() : b])}
        if not met:
            return []
        rows |= {r for r in met if r[4] == max(x[4] for x in met)}
    if asked:
        return sorted(rows) if len({r[:2] for r in rows}) == 1 else []
    rows = {(level, label, w, a, b) for level, label in labels for w in ways(level, label) | {f"{level}: {label}", f"{level} {label}"} for a, b in places(text, w)}
    return sorted(r for r in rows if len({x[:2] for x in rows if x[3:] == r[3:]}) == 1)[:32]


def grounded(text):
    if not text or not text.strip() or len(text.encode()) > 16384:
        return "invalid_question", None, None
    found = []
    for name in sorted({c[1] for c in CONCEPTS}):
        spans = places(text, name)
        cids = {c[0] for c in CONCEPTS if c[1] == name}
        if spans and len(cids) > 1:
            return "ambiguous_name", None, None
        if spans and not any(cid in cids for _, cid in MEMBERS):
            return "missing_original_member", None, None
        found += [(name, a, b, min(cids)) for a, b in spans]
    if not found or len(found) > 32:
        return "catalog_too_large" if found else "no_grounded_vocabulary", None, None
    rows = targets(text)
    if not rows or len({r[:2] for r in rows}) > 1:
        return "ambiguous_target" if rows else "no_explicit_target", None, None
    return None, sorted(found), rows


def asked():
    r = random.Random(4)
    rows = [r.choice([" ", " ", ""]).join(r.choice(PIECES[:3] if r.random() < 0.2 else PIECES) for _ in range(r.randint(1, 6))) for _ in range(1500)]
    rows += [f"{a} {r.choice(['of', 'in (', 'with'])} {b}" for a in ("iron", "quartz", "iron ore") for b in ("glass", "categories", "fine: ore", "coarse  category, coarse: categories", "fine ore and coarse glass", "fine:sea_water", "fine: sea water", "xfine ore", "metal", "fe alloy")]
    return [*rows, None, "", " \n", "iron " * 33 + "glass", "iron " * 32 + "glass", "iron glass " + "x" * 16373, "iron glass " + "x" * 16374, "iron fine\tore", "iron éfine ore"]


def test_grounding_like_plain_python(spark):
    rows = list(enumerate(asked()))
    got = G.question_grounding(spark.createDataFrame(rows, "question_id long, text string"), spark.createDataFrame([*CONCEPTS, CONCEPTS[0]], "cid long, name string, coarse string, fine string"), spark.createDataFrame(MEMBERS, "member long, cid long")).collect()
    found = {x.question_id: (x.reason, x.terms and [tuple(t) for t in x.terms], x.targets and [tuple(t) for t in x.targets]) for x in got}
    assert len(got) == len(rows)
    for n, text in rows:
        assert found[n] == grounded(text), text
    assert {x.reason for x in got} == {None, "invalid_question", "ambiguous_name", "missing_original_member", "no_grounded_vocabulary", "catalog_too_large", "no_explicit_target", "ambiguous_target"}


@pytest.mark.parametrize("empty", ["questions", "concepts", "members"])
def test_empty_tables(spark, empty):
    made = {"questions": ([(1, "iron glass")], "question_id long, text string"), "concepts": (CONCEPTS, "cid long, name string, coarse string, fine string"), "members": (MEMBERS, "member long, cid long")}
    tables = [spark.createDataFrame([] if k == empty else rows, schema) for k, (rows, schema) in made.items()]
    want = {"questions": [], "concepts": [(1, "no_grounded_vocabulary")], "members": [(1, "missing_original_member")]}[empty]
    assert [(x.question_id, x.reason) for x in G.question_grounding(*tables).collect()] == want
