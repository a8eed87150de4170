"""A quality classifier: a factorisation machine over hashed words and the text's structure.

Inputs are the logarithmic counts of words hashed into `BUCKETS` buckets, scaled to unit length, and
structure statistics: shares of characters of several kinds, lengths of words, lines and text, repeated words and lines. Labels, language, source and ids are no inputs.

A score is w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j through the logistic function. The pairs cost
linear time by the identity  sum_{i<j} <v_i,v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Training takes at most `MAX_ROWS` labelled rows, those with the smallest hash of their doc_id (all, if
there are fewer): executors make their inputs, the driver gets these bounded sparse rows and runs
Adagrad in numpy with a fixed seed. Scoring covers every whole text on the executors.

Defined results: null and empty texts are scored like any text without words; without labelled rows, or
with one class only, every score is that class's smoothed share; rows without a label (or with a null doc_id)
don't train; every row gets one score; several labels of a document train as several rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_rows

BUCKETS, RANK, EPOCHS, RATE, DECAY, MAX_ROWS, SEED = 1 << 15, 8, 6, 0.08, 1e-5, 20_000, 7
_UPPER, _DIGIT, _PUNCT, _SYMBOL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?", b"#*$%&|<>{}[]=_^~\\/+@"
STATS = 16
_WORD_MEMO = 400_000


class Features:
    """texts as sparse rows: word buckets first, then STATS structure statistics."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.memo = buckets, {}

    def _bucket(self, word: bytes) -> int:
        if (b := self.memo.get(word)) is None:
            b = xxhash.xxh64_intdigest(word.lower().strip(b".,;:!?\"'()"), 1) % self.buckets
            if len(self.memo) < _WORD_MEMO and len(word) < 40:
                self.memo[word] = b
        return b

    def one(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()
        get, make = self.memo.get, self._bucket
        at, n = np.unique(np.array([b if (b := get(w)) is not None else make(w) for w in words], np.int64), return_counts=True)
        x = np.log1p(n)
        x /= max(1e-9, float(np.sqrt((x * x).sum())))
        stats = self.stats(text, data, words, at, n)
        return np.concatenate([at, self.buckets + np.arange(STATS)]), np.concatenate([x, stats])

    @staticmethod
    def stats(text: str, data: bytes, words: list[bytes], at: np.ndarray, n: np.ndarray) -> np.ndarray:
        chars, nw = max(1, len(text)), max(1, len(words))
        lines = text.split("\n")
        full = [x for x in lines if x.strip()]
        lengths = np.array([len(w) for w in words] or [0])
        of = lambda kind: (len(data) - len(data.translate(None, kind))) / chars
        p = n / nw
        return np.array([
            1.0, np.log1p(len(text)) / 10, np.log1p(len(words)) / 8, float(lengths.mean()) / 10, float(lengths.std()) / 10,
            min(1.0, float(lengths.max()) / 100), of(_UPPER) * 3, of(_DIGIT) * 5, of(_PUNCT) * 10,
            of(_SYMBOL) * 5, len(at) / nw, float(p.max()) if len(p) else 0.0, -float((p * np.log(p)).sum()) / 8 if len(p) else 0.0,
            1 - len(set(full)) / max(1, len(full)), np.log1p(len(full)) / 5, np.log1p(len(text) / max(1, len(full))) / 6,
        ])


class Machine:
    """Weights and factors; score() in time linear in the inputs."""

    def __init__(self, width: int, rank: int = RANK, seed: int = SEED):
        self.w0, self.w = 0.0, np.zeros(width)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (width, rank))

    def raw(self, at: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        vx = self.v[at] * x[:, None]
        s = vx.sum(0)
        return self.w0 + float(self.w[at] @ x) + 0.5 * float((s * s).sum() - (vx * vx).sum()), s

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(at, x)[0], -30, 30))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Machine:
        share = (labels.sum() + 1) / (len(labels) + 2)
        self.w0 = float(np.log(share / (1 - share)))
        if not len(labels) or labels.min() == labels.max():
            self.v[:] = 0
            return self
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))  # both classes weigh the same
        self.w0, gw, gv, g0, rng = 0.0, np.full_like(self.w, 1e-8), np.full_like(self.v, 1e-8), 1e-8, np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                at, x = rows[i]
                raw, s = self.raw(at, x)
                d = weight[i] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[i])
                dw = d * x + DECAY * self.w[at]
                v = self.v[at]
                dv = d * x[:, None] * (s - v * x[:, None]) + DECAY * v
                gw[at] += dw * dw
                gv[at] += dv * dv
                g0 += d * d
                self.w[at] -= RATE * dw / np.sqrt(gw[at])
                self.v[at] -= RATE * dv / np.sqrt(gv[at])
                self.w0 -= RATE * d / np.sqrt(g0)
        return self


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = MAX_ROWS) -> Machine:
    """A machine fitted on labelled rows docs(doc_id, text), labels(doc_id, target)."""
    bounded_batches(docs.sparkSession)
    chosen = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("label_id"), F.col(target).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id", "y").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))  # chosen has max_rows rows of two numbers at most
    made = Features()

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [made.one(t) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in found], pa.binary())], ["doc_id", "y", "at", "x"])

    # a document that is there several times trains once; hence no more rows than labels
    got = map_rows(rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")), use, "doc_id bigint, y int, at binary, x binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.y, r.at))
    inputs = [(np.frombuffer(r.at, np.int32).astype(np.int64), np.frombuffer(r.x, np.float32).astype(np.float64)) for r in got]
    return Machine(BUCKETS + STATS).fit(inputs, np.array([r.y for r in got], np.float64))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((machine, Features()))  # BUCKETS x (RANK + 1) numbers, whatever the data

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine, features = shared.value
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([machine.score(*features.one(t)) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return map_rows(docs.select(F.col("doc_id").cast("bigint"), "text"), use, "doc_id bigint, score double")


def held_out(doc_id: str = "doc_id"):
    """Whether a row is held out from training: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def report(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: held_out, its score, and the prediction; trained on rows that aren't held out."""
    machine = train(docs, labels.where(~held_out()), target, max_rows)
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
