import random
import zlib

import numpy as np

from markloom.llm import quality_classifier as Q


def test_pairs_in_linear_time():
    m = Q.Machine(40, 5)
    m.w[:] = np.linspace(-1, 1, 40)
    at, x = np.array([1, 7, 20, 39]), np.array([0.5, 2.0, -1.0, 0.25])
    slow = m.w0 + m.w[at] @ x + sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert abs(m.raw(at, x)[0] - slow) < 1e-12


def corpus():
    r = random.Random(3)
    good, bad = [f"good{i}" for i in range(40)], [f"bad{i}" for i in range(40)]
    docs, labels = [], []
    for i in range(400):
        y = i % 3 != 0
        docs.append((i, " ".join(r.choices(good if y else bad, k=30) + r.choices(good + bad, k=10)), i, None))
        labels.append((i, int(y), 0))
    docs += [(900, None, 0, None), (901, "", 0, None), (None, "good1 good2", 0, None), (5, docs[5][1], 0, None), (902, "word " * 50000, 0, None)]
    labels += [(5, 1, 0), (None, 1, 0), (7, None, 0)]
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, score long, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = Q.report(df, lab).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    truth = {i: y for i, y, _ in labels[:400]}
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(out) > 80 and sum(r.predicted == truth[r.doc_id] for r in out) / len(out) > 0.95
    again = {r.doc_id: r.score for r in Q.report(df.repartition(7), lab.repartition(3)).collect()}
    assert all(again[r.doc_id] == r.score for r in got)  # however the rows are dealt
    few = Q.report(df, lab, max_rows=50).collect()
    assert len(few) == len(docs)
    one = Q.report(df, lab.where("quality = 1")).collect()
    assert all(r.predicted == 1 for r in one)
    assert {r.score for r in Q.report(df, lab.limit(0)).collect()} == {0.5} and Q.report(df.limit(0), lab).count() == 0
