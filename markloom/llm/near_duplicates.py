"""Near-duplicates: what SimHash's links leave out, found exactly by the Jaccard similarity of word shingles.

A text's set has the XXH64 of its shingles of `WIDTH` words (A-Z lower-cased; a shorter text is one shingle).
Sets link at a similarity of 4/5 or more, that is at 9 common shingles or more for each 4 of both sizes
together. Candidates are pairs that the caller has (of SimHash's links) and pairs found by prefixes; each is
verified by its whole sets.

Prefixes: with all shingles in one fixed order, two linked sets share one of their first n - ceil(4n/5) + 1. The
order is by how often a shingle's counter (one of `COUNTERS`, by its low bits) is met, so that boilerplate comes last
and brings together only texts that are little else. Any order is exact; no candidate is dropped.

Equal texts count as one (by XXH64; one in 2^64 pairs of unlike texts would be taken for equal). A large group
doesn't become all its pairs: each set of a bucket is first compared with the bucket's smallest; then only pairs
that these links leave in different components are. A bucket that still has over `CROWD` sets isn't paired: similar sets
share a second shingle, after the first one in the order and among their first n - ceil(4n/5) + 2, so its members meet again by both.
Only sets that share two early shingles with many others and aren't similar do become pairs.

Sets are never written for all texts. A text keeps a bit map of four to eight bits for each shingle, in which every
shingle turns over one bit: two maps differ in no more bits than their sets in shingles, so a pair whose maps differ
in over (n + m) / 9 bits isn't similar. Sets are made again only for the pairs that this leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded, components, cut, discard, give_back, map_rows, recorded, slices

WIDTH, SEED, COUNTERS, BLOCK = 5, 42, 1 << 17, 1 << 15
#: A task remembers so many texts, to pass over copies; of more it hands copies on, which changes nothing but the time.
SEEN = 1 << 20
#: A bucket of more sets in several components is parted by a second shingle.
CROWD = 64
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_ALIKE = "5L * least({0}, {1}) >= 4L * greatest({0}, {1})"


def hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The hashes of a text's shingles, repeats included."""
    hash_of, out, words = xxhash.xxh64_intdigest, [], []
    for block in blocks((text or "").encode("utf-8", "surrogatepass").translate(_LOWER)):
        words = words[-(width - 1) :] + block.split()
        joined, starts = b" ".join(words), [0]
        for w in words:
            starts.append(starts[-1] + len(w) + 1)
        out.append(np.array([hash_of(joined[a : b - 1], SEED) for a, b in zip(starts, starts[width:], strict=False)], np.uint64))
    found = np.concatenate(out)
    return found if len(found) else np.array([hash_of(b" ".join(words), SEED)], np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text, sorted, as signed longs."""
    return np.unique(hashes(text, width).view(np.int64))


def majority(found: np.ndarray) -> int:
    """The SimHash fingerprint of shingle hashes, as a signed long: bits set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), BLOCK):
        ones += np.unpackbits(found[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(found)).tobytes(), "big", signed=True)


def bit_map(found: np.ndarray) -> bytes:
    """A set's bit map: the parity of how many shingles fall on each bit; as many bits as a power of two."""
    size = max(64, 1 << (4 * len(found) - 1).bit_length())
    return np.packbits(np.bincount((found.view(np.uint64) & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """In how many bits two maps differ, the larger folded to the size of the smaller."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def _each_once(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, str | None]]]:
    """The (node, text) of a task by slices, each node once as long as there is room to remember them."""
    give_back()
    seen: set[int] = set()
    for batch in batches:
        for piece in slices(batch):
            rows = []
            for node, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                if node not in seen:
                    rows.append((node, text))
                    if len(seen) < SEEN:
                        seen.add(node)
            if rows:
                yield rows


def _survey(texts: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(node, fp, n, bits) of texts(node, text), with SimHash fingerprints, set sizes and bit maps; and how often each counter is met."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(COUNTERS, np.int64)
        for rows in _each_once(batches):
            every = [hashes(t) for _, t in rows]
            sets = [np.unique(h) for h in every]
            met += np.bincount((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            k = len(rows)
            columns = [pa.array([n for n, _ in rows], pa.int64()), pa.array([majority(h) for h in every], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([bit_map(s) for s in sets], pa.binary()), pa.nulls(k, pa.list_(pa.int32())), pa.nulls(k, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "fp", "n", "bits", "c", "m"])
        where = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([where.astype(np.int32)], pa.list_(pa.int32())), pa.array([met[where]], pa.list_(pa.int64()))], ["node", "fp", "n", "bits", "c", "m"])

    both = cut(bounded(texts).mapInArrow(over, "node bigint, fp bigint, n int, bits binary, c array<int>, m array<bigint>"), "near-survey")
    met = np.zeros(COUNTERS, np.int64)  # a fixed number of sums
    sums = both.where("c is not null").select(F.explode(F.arrays_zip("c", "m")).alias("x")).groupBy(F.col("x.c").alias("c")).agg(F.sum("x.m").alias("m")).toArrow()
    met[sums.column("c").to_numpy()] = sums.column("m").to_numpy()
    return both.where("c is null").drop("c", "m").dropDuplicates(["node"]), met


def _prefixes(texts: DataFrame, met: np.ndarray) -> DataFrame:
    """texts(node, text) as (node, s), a row for each shingle of a set's prefix."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each_once(batches):
            nodes, prefix = [], []
            for node, text in rows:
                found = shingles(text)
                first = found[np.lexsort((found, met[found & (COUNTERS - 1)]))[: len(found) - -(-4 * len(found) // 5) + 1]]
                nodes.append(np.full(len(first), node, np.int64))
                prefix.append(first)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (nodes, prefix)], ["node", "s"])

    return bounded(texts).mapInArrow(over, "node bigint, s bigint")


def small(df: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """df(fixed-size columns), to be broadcast if it has so few rows; counted first."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of pairs(a, b) that are similar enough: judged by sizes, then by bit maps, then by the sets."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"))
    size = lambda k: side(k).drop(f"bits_{k}")
    alike = cut(pairs.distinct().join(size("a"), "a").join(size("b"), "b").where(_ALIKE.format("n_a", "n_b")).select("a", "b"), "near-alike")

    def close(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_a, bits_a, n_b, bits_b = (batch.column(k).to_pylist() for k in range(2, 6))
        good = [9 * apart(x, y) <= n + m for n, x, m, y in zip(n_a, bits_a, n_b, bits_b, strict=True)]
        return pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    both = alike.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    pairs = cut(map_rows(bounded(both), close, "a bigint, b bigint"), "near-pairs")
    asked = cut(pairs.select(F.col("a").alias("asked")).union(pairs.select("b")).distinct(), "near-asked")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each_once(batches):
            sets = [shingles(t) for _, t in rows]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), lists], ["node", "shingles"])

    wanted = texts.join(small(asked), F.col("node") == F.col("asked"), "left_semi")
    sets = cut(bounded(wanted).mapInArrow(over, "node bigint, shingles array<bigint>").dropDuplicates(["node"]), "near-sets")
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return cut(pairs.join(left, "a").join(right, "b").where("9L * size(array_intersect(x, y)) >= 4L * (size(x) + size(y))").select("a", "b"), "near-links")


def similar(texts: DataFrame, hinted) -> DataFrame:
    """Links (a, b) that join texts(node, text) as all similar pairs would; hinted(nodes with fingerprints) gives further candidates."""
    nodes, met = _survey(texts)
    nodes = cut(nodes, "near-nodes")
    passing: list[str] = []
    with recorded(passing):
        prefixes = cut(_prefixes(texts, met), "near-prefixes")
    shared = prefixes.groupBy(F.col("s").alias("s0")).agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").select("s0", "a")
    members = cut(prefixes.join(shared, F.col("s") == F.col("s0")).select("s", "node", "a"), "near-members")
    discard(texts.sparkSession, passing)
    stars = members.where("node <> a").select("a", F.col("node").alias("b")).distinct()
    found = _verified(stars.union(hinted(nodes)), texts, nodes)
    roots = components(found, "near-star-cc")
    rooted = members.select("s", "node").distinct().join(roots, "node", "left").select("s", "node", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy(F.col("s").alias("s1")).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("s1")
    left = cut(rooted.join(mixed, F.col("s") == F.col("s1"), "left_semi").join(nodes.select("node", "n"), "node"), "near-mixed")
    crowded = left.groupBy(F.col("s").alias("s1")).agg(F.count("*").alias("members")).where(F.col("members") > CROWD).select("s1")
    crowded = small(cut(crowded, "near-crowded"))
    calm = left.join(crowded, F.col("s") == F.col("s1"), "left_anti")
    met_by = left.join(crowded, F.col("s") == F.col("s1"), "left_semi").groupBy(F.col("node").alias("of")).agg(F.collect_list("s").alias("first"))
    seconds = _second_shingles(texts.join(met_by, F.col("node") == F.col("of")).select("node", "text", "first"), met).distinct()
    twice = cut(seconds.join(left.select("node", "root", "n").distinct(), "node").select("s", "node", "root", "n"), "near-second")
    return found.union(_verified(across(calm).union(across(twice)), texts, nodes))


def across(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of members(s, node, root, n) that share s, may be similar by size, and are of different components."""
    other = members.select(F.col("s").alias("s1"), F.col("node").alias("b"), F.col("n").alias("k"), F.col("root").alias("root_b"))
    met = members.join(other, (F.col("s") == F.col("s1")) & (F.col("node") < F.col("b")) & (F.col("root") != F.col("root_b")))
    return met.where(_ALIKE.format("n", "k")).select(F.col("node").alias("a"), "b")


def _second_shingles(texts: DataFrame, met: np.ndarray) -> DataFrame:
    """texts(node, text, first) as (node, s): each of the first shingles with each later one of the set's prefix for two, as one hash.

    A set of one shingle, similar only to its equals, has the shingle itself."""

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, keys = [], []
        for node, text, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = shingles(text)
            order = found[np.lexsort((found, met[found & (COUNTERS - 1)]))[: len(found) - -(-4 * len(found) // 5) + 2]]
            for x in first:
                later = order[np.flatnonzero(order == x)[0] + 1 :] if len(found) > 1 else order
                keys.append((later * np.int64(0x5851F42D4C957F2D)) ^ np.int64(x))
                nodes.append(np.full(len(later), node, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (nodes, keys)], ["node", "s"])

    return map_rows(bounded(texts), use, "node bigint, s bigint")
