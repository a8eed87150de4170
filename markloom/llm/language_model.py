"""Language model scoring by a hashed maximum-entropy model with a class-factored softmax.

Tokens: A-Z lower-cased, words are runs of anything but ASCII white space, then one end of the text (kept as the empty word).
All rows but those held out are training rows; c is a token's count there, N the sum, V the number of distinct tokens. The base
score is the text's sum of log10((c + 0.1) / (N + 0.1 (V + 1))).

The model's words are the `CLASSES * WIDTH` most frequent ones, classes of `WIDTH` by rank; one more class holds all other tokens, known
or not, which share its probability as the base does. P(word | history) = P(class | history) * P(word | class, history), either
a softmax over a bias, which is the base's probability, and the weights of hashed features of the history:
the word before, the word before that (a skip feature) and, for words, both (a trigram's history). For words the features are hashed with
the class. So a model without weights gives the base score, and every history's probabilities sum to one.

Training goes over all training rows once, in `ROUNDS` rounds by a hash of the rows. In a round, each task starts from the
broadcast weights and makes sparse gradient steps (Adagrad by row of weights) over batches of its tokens; the weights come back in
chunks, and a row's new weights are the tasks' mean by how often they met it. The chunks are added one after the other in
sorted partitions, so their number matters to no task's memory. What reaches the driver is the model, 3 MB at any size of the corpus.

Counts cover every training token: words are counted within tasks, then summed. The most frequent ones, `DICTIONARY` at most, are broadcast (at most
`LONG` bytes each); all others are joined by token, none of them frequent unless there are over DICTIONARY as frequent.
Tokens of over LONG bytes are known by their SHA-256.

Defined results: a null or empty text has one token, its end; null ids train; repeated rows train and are scored row by row; without
training rows every score is that of the formula with N = V = 0, which is 0; other columns are ignored; an empty table gives no rows. Long texts
are read in blocks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, cut, give_back, slices

CLASSES, WIDTH = 31, 32
CLASS_ROWS, WORD_ROWS = 1 << 13, 1 << 14
ROUNDS, FIRST_STEP, STEP, RATE = 2, 1024, 16384, 0.7
DICTIONARY, LONG = 1 << 16, 256
ALPHA = 0.1
#: Words that a task counts before it hands them on.
HELD = 400_000
#: Rows of weights in a chunk.
CHUNK = 1024
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
END = b""
_START = 0x51ED27  # stands for the words before a text


def token_key(word: bytes) -> bytes:
    """What a word is counted by; no word holds a space."""
    return word if len(word) <= LONG else b" " + hashlib.sha256(word).digest()


def words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, a block at a time, without the end."""
    for block in blocks((text or "").encode("utf-8", "surrogatepass").translate(_LOWER)):
        yield block.split()


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of a row's id as text leaves 0 when divided by 10."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, n) over all rows of docs(text), ends included."""
    bounded_batches(docs.sparkSession)

    def rows(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["token", "n"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for some in words(text):
                    found.update(some)
                found[END] += 1
                if len(found) > HELD:
                    yield rows(_keyed(found))
                    found = Counter()
        if found:
            yield rows(_keyed(found))

    return docs.select(F.col("text").cast("string")).mapInArrow(over, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def _keyed(found: Counter) -> Counter:
    for word in [w for w in found if len(w) > LONG]:
        found[token_key(word)] += found.pop(word)
    return found


class Vocabulary(NamedTuple):
    """The frequent words in order of rank, with their counts, and the figures of all tokens."""

    ranks: dict[bytes, int]
    counts: np.ndarray
    total: int
    distinct: int

    def biases(self) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms: of each class's probability, the last class for all other tokens, and of each word's in its class."""
        n = min(len(self.counts), CLASSES * WIDTH)
        mass = np.zeros(CLASSES * WIDTH)
        mass[:n] = self.counts[:n] + ALPHA
        rest = self.total - self.counts[:n].sum() + ALPHA * (self.distinct - n + 1)
        mass = mass.reshape(CLASSES, WIDTH)
        of_class = np.append(mass.sum(1), rest)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.log(of_class / of_class.sum()).clip(-1e9).astype(np.float32), np.nan_to_num(np.log(mass / mass.sum(1, keepdims=True)), nan=-1e9, neginf=-1e9).astype(np.float32)

    def rest(self) -> float:
        """log10 of what the counts of tokens outside the model's words are divided by."""
        n = min(len(self.counts), CLASSES * WIDTH)
        return float(np.log10(self.total - int(self.counts[:n].sum()) + ALPHA * (self.distinct - n + 1)))

    def base(self) -> float:
        return float(np.log10(self.total + ALPHA * (self.distinct + 1)))


class Weights(NamedTuple):
    of_class: np.ndarray  # CLASS_ROWS x (CLASSES + 1)
    of_word: np.ndarray  # WORD_ROWS x WIDTH

    @classmethod
    def none(cls) -> Weights:
        return cls(np.zeros((CLASS_ROWS, CLASSES + 1), np.float32), np.zeros((WORD_ROWS, WIDTH), np.float32))


class Stream:
    """Texts as arrays of tokens with their hashed histories, about STEP tokens at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.get = ranks.get
        self.clear()

    def clear(self) -> None:
        self.ids, self.contexts, self.n = [], [], 0

    def add(self, some: list[bytes], before: np.ndarray) -> np.ndarray:
        """Words that come after the two hashed in before; returns the last two hashed."""
        get = self.get
        ids = np.fromiter(map(get, some, repeat(-1)), np.int64, len(some))
        hashed = ids + 7
        if len(unknown := np.flatnonzero(ids < 0)):
            hashed[unknown] = np.fromiter(map(zlib.crc32, map(some.__getitem__, unknown.tolist())), np.int64, len(unknown)) | 1 << 32
        with_before = np.concatenate([before, hashed])
        self.ids.append(ids)
        self.contexts.append(np.stack([with_before[1:-1], with_before[:-2]], 1))
        self.n += len(ids)
        return with_before[-2:]

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """ids, and the hashed word before and the one before that."""
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int64)
        contexts = np.concatenate(self.contexts) if self.contexts else np.zeros((0, 2), np.int64)
        self.clear()
        return ids, contexts


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64 well-mixed bits of each whole number."""
    x = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def histories(contexts: np.ndarray) -> np.ndarray:
    """Three hashed features of each history, as 64 bits."""
    first, second = _mixed(contexts[:, 0], 1), _mixed(contexts[:, 1], 2)
    return np.stack([first, second, _mixed(first ^ (second >> np.uint64(7)), 3)], 1)


class Model:
    def __init__(self, vocabulary: Vocabulary, weights: Weights):
        self.class_bias, self.word_bias = vocabulary.biases()
        self.weights = weights

    def _logits(self, table: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
        z = table[rows[:, 0]]
        for j in range(1, rows.shape[1]):
            z += table[rows[:, j]]
        z += bias
        z -= z.max(1, keepdims=True)
        return z

    def outputs(self, ids: np.ndarray, contexts: np.ndarray):
        """For all tokens (rows, classes, logits); for the model's words (where, rows, places, logits)."""
        hashed = histories(contexts)
        n = CLASSES * WIDTH
        own = (ids >= 0) & (ids < n)
        classes = np.where(own, ids // WIDTH, CLASSES)
        rows = (hashed[:, :2] & np.uint64(CLASS_ROWS - 1)).astype(np.int64)
        where = np.flatnonzero(own)
        of = classes[where]
        word_rows = (_mixed(hashed[where] + of[:, None].astype(np.uint64), 4) & np.uint64(WORD_ROWS - 1)).astype(np.int64)
        return (rows, classes, self._logits(self.weights.of_class, rows, self.class_bias)), (where, word_rows, ids[where] % WIDTH, self._logits(self.weights.of_word, word_rows, self.word_bias[of]))

    def log10(self, ids: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """log10 of each token's class given its history, and of the word in it if it is one of the model's."""
        (_, classes, z), (where, _, places, y) = self.outputs(ids, contexts)
        at = lambda z, k: z[np.arange(len(k)), k] - np.log(np.exp(z).sum(1))
        out = at(z, classes).astype(np.float64)
        out[where] += at(y, places)
        return out / np.log(10)


class Trainer(Model):
    def __init__(self, vocabulary: Vocabulary, weights: Weights):
        super().__init__(vocabulary, Weights(*(w.copy() for w in weights)))
        self.squares = [np.full(len(w), 1e-6, np.float32) for w in weights]
        self.met = [np.zeros(len(w), np.float32) for w in weights]

    def step(self, ids: np.ndarray, contexts: np.ndarray) -> None:
        first, (where, word_rows, places, y) = self.outputs(ids, contexts)
        for k, (rows, targets, z) in enumerate((first, (word_rows, places, y))):
            if len(rows):
                p = np.exp(z)
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(p)), targets] -= 1
                self._descend(k, rows, p)

    def _descend(self, k: int, rows: np.ndarray, d: np.ndarray) -> None:
        flat = rows.T.ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")  # a radix sort: the tables have 2^16 rows at most
        flat = flat[order]
        starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        at, n = flat[starts], np.diff(np.r_[starts, len(flat)]).astype(np.float32)
        g = np.add.reduceat(d[order % len(d)], starts, axis=0)
        self.met[k][at] += n
        self.squares[k][at] += np.einsum("ij,ij->i", g, g)
        self.weights[k][at] -= (RATE / np.sqrt(self.squares[k][at]))[:, None] * g


def _train_round(docs: DataFrame, vocabulary: Vocabulary, weights: Weights) -> Weights:
    """The tasks' mean weights after one pass over docs(text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, weights))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        vocabulary, weights = shared.value
        trainer, stream, any_row, size = Trainer(vocabulary, weights), Stream(vocabulary.ranks), False, FIRST_STEP
        for batch in batches:
            any_row = any_row or batch.num_rows > 0
            for text in batch.column(0).to_pylist():
                before = np.full(2, _START, np.int64)
                for some in (*words(text), [END]):
                    for at in range(0, len(some), STEP):
                        before = stream.add(some[at : at + STEP], before)
                        if stream.n >= size:
                            trainer.step(*stream.take())
                            size = min(STEP, size + FIRST_STEP // 4)  # a short corpus gets many steps
        if stream.n:
            trainer.step(*stream.take())
        if any_row:
            part = TaskContext.get().partitionId()
            for k, table in enumerate(trainer.weights):
                for at in range(0, len(table), CHUNK):
                    met = trainer.met[k][at : at + CHUNK]
                    if met.any():
                        yield pa.RecordBatch.from_arrays([pa.array([k * 1_000_000 + at], pa.int32()), pa.array([part], pa.int32()), pa.array([met.tobytes()], pa.binary()), pa.array([table[at : at + CHUNK].tobytes()], pa.binary())], ["chunk", "part", "met", "rows"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, met, rows = None, 0, 0
        give = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([met.astype(np.float32).tobytes()], pa.binary()), pa.array([(rows / np.maximum(met, 1)[:, None]).astype(np.float32).tobytes()], pa.binary())], ["chunk", "met", "rows"])
        for batch in batches:
            for chunk, n, w in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if now is not None and chunk != now:
                    yield give()
                    met, rows = 0, 0
                now, n = chunk, np.frombuffer(n, np.float32).astype(np.float64)
                met, rows = met + n, rows + n[:, None] * np.frombuffer(w, np.float32).reshape(len(n), -1)
        if now is not None:
            yield give()

    sent = docs.mapInArrow(over, "chunk int, part int, met binary, rows binary")
    summed = sent.repartition("chunk").sortWithinPartitions("chunk", "part").mapInArrow(added, "chunk int, met binary, rows binary")
    out = Weights(*(w.copy() for w in weights))
    for chunk, met, rows in summed.collect():  # the model, however long the corpus
        table, at = out[chunk // 1_000_000], chunk % 1_000_000
        known = np.frombuffer(met, np.float32) > 0
        table[at : at + len(known)][known] = np.frombuffer(rows, np.float32).reshape(len(known), -1)[known]
    shared.unpersist()
    return out


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The most frequent tokens of counts(token, n), DICTIONARY at most: those with as many occurrences are in it together or not at all.

    The limit comes from a histogram of a few thousand classes, so nothing else is sent to the driver."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    steps = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n") * 64) + 384)  # 1024 is step 1024
    least, held = None, 0
    for r in sorted(counts.groupBy(steps.alias("step")).agg(F.count("*").alias("tokens"), F.min("n").alias("least")).collect(), key=lambda r: -r.step):
        if (held := held + r.tokens) > DICTIONARY:
            break
        least = r.least
    top = sorted(counts.where(F.col("n") >= least).collect(), key=lambda r: (-r.n, r.token)) if least else []
    return Vocabulary({bytes(r.token): i for i, r in enumerate(top)}, np.array([r.n for r in top], np.int64), total[0], total[1])


def train(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Weights:
    """Weights after all rows of docs(doc_id, text), a part of them in each round."""
    bounded_batches(docs.sparkSession)
    weights = Weights.none()
    for k in range(rounds if vocab.total else 0):
        weights = _train_round(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == k).select(F.col("text").cast("string")), vocab, weights)
    return weights


def _scored(docs: DataFrame, vocab: Vocabulary, weights: Weights) -> DataFrame:
    """(row, doc_id, n_tokens, n_known, base, score, rest): a row's sums, a block at a time; rest lists the tokens outside the dictionary, scored as unknown."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocab, weights))
    schema = "row bigint, doc_id bigint, n_tokens bigint, n_known bigint, base double, score double, rest array<struct<token: binary, n: bigint>>"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = ["row", "doc_id", "n_tokens", "n_known", "base", "score", "rest"]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        vocab, weights = shared.value
        model, stream = Model(vocab, weights), Stream(vocab.ranks)
        n_model = CLASSES * WIDTH
        known = np.log10(np.append(vocab.counts, 0) + ALPHA)  # the last for unknown tokens
        outside = np.where(np.arange(len(known)) < min(n_model, len(known) - 1), 0.0, known - vocab.rest())
        known = known - vocab.base()
        pending: list[tuple] = []

        def told() -> pa.RecordBatch:
            ids, contexts = stream.take()
            base, score = known[ids], outside[ids]
            for at in range(0, len(ids), STEP):
                score[at : at + STEP] += model.log10(ids[at : at + STEP], contexts[at : at + STEP])
            ends = np.cumsum([p[2] for p in pending])
            starts = ends - [p[2] for p in pending]
            rows = [(row, doc, n, int((ids[a:b] >= 0).sum()), float(base[a:b].sum()), float(score[a:b].sum())) for (row, doc, n, _), a, b in zip(pending, starts.tolist(), ends.tolist(), strict=True)]
            rest = [p[3] for p in pending]
            each = pa.StructArray.from_arrays([pa.array(chain.from_iterable(rest), pa.binary()), pa.array(chain.from_iterable(r.values() for r in rest), pa.int64())], ["token", "n"])
            listed = pa.ListArray.from_arrays(np.cumsum([0, *map(len, rest)], dtype=np.int32), each)
            pending.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)), listed], names)

        for batch in batches:
            for piece in slices(batch):
                for row, doc, text in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    before = np.full(2, _START, np.int64)
                    for some in (*words(text), [END]):
                        before = stream.add(some, before)
                        ids = stream.ids[-1]
                        rest = _keyed(Counter(map(some.__getitem__, np.flatnonzero(ids < 0).tolist())))
                        pending.append((row, doc, len(some), rest))
                        if stream.n >= STEP:
                            yield told()
        if pending:
            yield told()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(over, schema)


def report(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: its tokens, how many of them training rows hold, and the base's and the model's log10 probability."""
    bounded_batches(docs.sparkSession)
    training = docs.where(~held_out())
    counts = cut(token_counts(training), "lm-counts")
    vocab = vocabulary(counts)
    parts = cut(_scored(docs, vocab, train(training, vocab, rounds)), "lm-parts")
    rest = parts.select("row", F.explode("rest").alias("r")).select("row", "r.token", F.col("r.n").alias("times"))
    gain = F.col("times") * (F.log10(F.col("n") + ALPHA) - F.log10(F.lit(ALPHA)))
    met = rest.join(counts, "token").groupBy("row").agg(F.sum("times").alias("n_known"), F.sum(gain).alias("gain"))
    none = [F.lit(0).cast("bigint").alias("n_tokens"), "n_known", F.col("gain").alias("base"), F.col("gain").alias("score")]
    sums = parts.drop("rest").union(met.select("row", F.lit(None).cast("bigint").alias("doc_id"), *none))
    sums = sums.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    return sums.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(vocab.total).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score")
