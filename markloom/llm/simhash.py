"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits, one per bit of the XXH64 of the text's word shingles: set if over half the
shingles have it set. Fingerprints link at `BITS` (3) or fewer differing bits. Cut into two segments of
32 bits, one segment of a linked pair differs by one bit at most. So each distinct fingerprint is indexed
under its segments and their 32 one-wildcard variants (one bit left out), 66 keys in all; an equality join
brings pairs together that share a key, and every pair is verified. Of a variant's bucket only pairs that
differ in the wildcard need a look, since equal segments meet in the segment's own bucket.

No bucket is collected unless it is bounded. Segment values that over `DENSE` distinct fingerprints share
are counted first; the buckets they touch are not compared as they are, but split by the other segment,
of which at most three bits may differ: it is cut into four, one part must be equal, and the bucket splits
into four times as many narrower ones, of 39 equal bits. Those still too large split again (45 bits) and
again (50 bits); what is left then is at most 2^14 distinct fingerprints. From a bucket comes a spanning
forest of its links (at most one row for each member), not its pairs. Connected components follow by
alternating stars (see common.components).

deduplicate() works at a similarity of 0.8 over shingles of five words; report() keeps to 3 words and 3 bits.

Defined results: null and empty texts have fingerprint 0 and are linked like any other; rows with the
same or no doc_id are each given a row; a component of only null ids has a null component_id. An empty
table gives an empty result. Texts of any length are hashed in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_duplicates
from .common import bounded, components, cut, map_rows

BITS, SHINGLE, SEED, DENSE, BLOCK = 3, 3, 42, 1024, 1 << 15
#: A-Z become a-z, all else stays.
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    n = max(1, len(words) - width + 1)
    hash_of, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        end = min(n, at + BLOCK)
        tail = starts[at + width : end + width] if len(words) >= width else [len(joined) + 1]
        digests = b"".join([hash_of(joined[a : b - 1], SEED) for a, b in zip(starts[at:end], tail, strict=True)])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(row_no, doc_id, text) as (row_no, doc_id, fp), fp as a signed long."""

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["row_no", "doc_id", "fp"])

    return map_rows(bounded(docs), use, "row_no bigint, doc_id bigint, fp bigint")


def _labels(a: np.ndarray, b: np.ndarray, n: int, labels: np.ndarray | None = None) -> np.ndarray:
    """The smallest index that each of n reaches over the links a-b (and over earlier labels)."""
    labels = np.arange(n) if labels is None else labels
    while True:
        before = labels.copy()
        low = np.minimum(labels[a], labels[b])
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        labels = labels[labels]
        if (labels == before).all():
            return labels


def _forest(bucket: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join what pairs within `bits` join inside the buckets; bucket is sorted, its two
    low bits are the side (pairs of side 0 and 1 count, and all of side 2)."""
    group, side = bucket >> 2, bucket & 3
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(group)))
    keep = np.repeat(sizes > 1, sizes)
    group, side, fp = group[keep], side[keep], fp[keep]
    if not len(fp):
        return fp, fp
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(group)))
    links_a, links_b = [], []
    near = lambda i, j: (np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= bits) & ((side[i] == 2) | (side[i] != side[j]))
    size_of = np.repeat(sizes, sizes)
    small = np.flatnonzero(size_of <= 64)
    for d in range(1, 64):
        i = small[small + d < len(fp)]
        i = i[group[i] == group[i + d]]
        if not len(i):
            break
        i = i[near(i, i + d)]
        links_a.append(i)
        links_b.append(i + d)
        small = small[small + d < len(fp)]
    labels = _labels(np.concatenate(links_a or [starts[:0]]), np.concatenate(links_b or [starts[:0]]), len(fp))
    for start, size in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        step = max(1, (1 << 21) // size)
        for at in range(start, start + size, step):
            rows = np.arange(at, min(at + step, start + size))[:, None]
            cols = np.arange(start, start + size)[None, :]
            i, j = np.nonzero(near(rows, cols) & (rows < cols))
            labels = _labels(i + at, j + start, len(fp), labels)
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return fp[moved], fp[labels[moved]]


def _linked(rows: DataFrame, bits: int) -> DataFrame:
    """(bucket, fp) as links (a, b): buckets come sorted, and are compared as soon as they are complete."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_b, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(b: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            x, y = _forest(b, f, bits)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

        for batch in batches:
            b = np.concatenate([held_b, batch.column(0).to_numpy()])
            f = np.concatenate([held_f, batch.column(1).to_numpy()])
            cutoff = int(np.searchsorted(b >> 2, b[-1] >> 2)) if len(b) else 0
            if cutoff >= BLOCK:
                yield from out(b[:cutoff], f[:cutoff])
                b, f = b[cutoff:], f[cutoff:]
            held_b, held_f = b, f
        yield from out(held_b, held_f)

    dealt = rows.repartition(F.shiftright("bucket", 2)).sortWithinPartitions("bucket")
    return dealt.mapInArrow(over, "a bigint, b bigint").distinct()


def _split(rows: DataFrame, widths: list[int]) -> DataFrame:
    """(key, side, fp, rest) into buckets by one part each of rest, which is cut into parts of these widths."""
    parts, low = [], 0
    for j, w in enumerate(widths):
        part = f"(shiftright(rest, {low}) & {(1 << w) - 1})"
        rest = f"(shiftleft(shiftright(rest, {low + w}), {low}) | (rest & {(1 << low) - 1}))"
        parts.append(f"named_struct('key', xxhash64(key, {j}, {part}), 'rest', {rest})")
        low += w
    return rows.select(F.explode(F.expr(f"array({', '.join(parts)})")).alias("p"), "side", "fp").select("p.key", "side", "fp", "p.rest")


def links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links (a, b) that join distinct fingerprints fps(fp) as all pairs within BITS would."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)
    halves = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("h"), high.alias("v"), low.alias("rest")), F.struct(F.lit(1).alias("h"), low.alias("v"), high.alias("rest")))).alias("s")).select("fp", "s.h", "s.v", "s.rest")
    wild = F.expr("transform(sequence(0, 32), p -> named_struct('key', h * 274877906944 + p * 4294967296 + if(p = 32, v, v & ~shiftleft(1L, p)), 'side', if(p = 32, 2L, shiftright(v, p) & 1L)))")
    keyed = halves.select("fp", "rest", F.explode(wild).alias("k")).select("k.key", "k.side", "fp", "rest")
    dense_values = cut(halves.groupBy("h", "v").agg(F.count("*").alias("n")).where(F.col("n") > dense).select("h", "v"), "simhash-dense")
    plain = lambda rows: rows.select((F.shiftleft("key", 2) + F.col("side")).alias("bucket"), "fp")
    if dense_values.isEmpty():
        return _linked(plain(keyed), BITS)
    hot = dense_values.select(F.explode(wild).alias("k")).select(F.col("k.key").alias("hot_key")).distinct()
    marked = keyed.join(hot, F.col("key") == F.col("hot_key"), "left")
    found = _linked(plain(marked.where("hot_key is null")), BITS)
    rows = marked.where("hot_key is not null").select("key", "side", "fp", "rest")
    for level, widths in enumerate(([8, 8, 8, 8], [6, 6, 6, 6], [5, 5, 4, 4])):
        rows = cut(_split(rows, widths), f"simhash-split{level}")
        if level == 2:
            return found.union(_linked(plain(rows), BITS))
        large = cut(rows.groupBy(F.col("key").alias("large_key")).agg(F.count("*").alias("n")).where(F.col("n") > 2 * dense).select("large_key"), f"simhash-large{level}")
        if large.isEmpty():
            return found.union(_linked(plain(rows), BITS))
        marked = rows.join(large, F.col("key") == F.col("large_key"), "left")
        found = found.union(_linked(plain(marked.where("large_key is null")), BITS))
        rows = marked.where("large_key is not null").select("key", "side", "fp", "rest")
    raise AssertionError


def _classes(rows: DataFrame, dense: int) -> DataFrame:
    """(row_no, doc_id, fp) with component_id."""
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-fps")
    roots = components(links(fps.select("fp"), dense), "simhash-cc")
    rooted = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.join(named, "root").select("fp", "root", "component_id"), "fp")


def report(docs: DataFrame, dense: int = DENSE) -> DataFrame:
    """One row per document: fingerprint and component."""
    rows = cut(fingerprints(docs.select(F.lit(0).cast("bigint").alias("row_no"), F.col("doc_id").cast("bigint"), "text")), "simhash")
    return _classes(rows, dense).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _hints(nodes: DataFrame, dense: int) -> DataFrame:
    """Pairs (a, b) of nodes(node, fp) that join what SimHash links: of equal fingerprints, and within BITS."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("a"))
    same = nodes.join(first, "fp").where("node <> a").select("a", F.col("node").alias("b"))
    side = lambda k: first.select(F.col("fp").alias(f"fp_{k}"), F.col("a").alias(f"node_{k}"))
    near = links(nodes.select("fp").distinct(), dense).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    return same.union(near.join(side("a"), "fp_a").join(side("b"), "fp_b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))


def deduplicate(docs: DataFrame, dense: int = DENSE) -> DataFrame:
    """docs, same columns, with one document of each group of near-duplicates: that of the smallest doc_id (nulls last).

    Near-duplicates are texts whose 5-word shingles have a Jaccard similarity of 0.8 or more, in steps. SimHash
    over the same shingles proposes pairs by its deletion variants, which are verified. At this similarity most pairs
    differ by 4 to 17 bits, which no segments of 64 bits find selectively; the rest is found by prefixes
    (near_duplicates.similar), exactly. Of rows with equal doc_id and text one stays: that whose columns' hash is least.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(text).alias("node"))
    found = near_duplicates.similar(docs.select(F.xxhash64(text).alias("node"), "text"), lambda nodes: _hints(nodes, dense))
    roots = components(found, "near-cc")
    held = cut(rows.groupBy("id", "node").agg(F.count("*").alias("copies")).join(roots, "node", "left").select("id", "node", "copies", F.coalesce("root", "node").alias("root")), "near-held")
    first = held.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("o"))
    judged = cut(held.join(first, "root").select(F.col("id").alias("of_id"), F.col("node").alias("of_node"), "copies", (F.col("id").eqNullSafe(F.col("o.id")) & (F.col("node") == F.col("o.node"))).alias("stays")), "near-judged")
    row = docs.select(F.struct(*docs.columns).alias("row"))
    own = F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("of_id")) & (F.xxhash64(F.coalesce(F.col("row.text"), F.lit(""))) == F.col("of_node"))
    repeated = judged.where("stays and copies > 1").select("of_id", "of_node")
    once = row.join(near_duplicates.small(judged.where("not stays or copies > 1").select("of_id", "of_node")), own, "left_anti")
    if repeated.isEmpty():
        return once.select("row.*")
    least = row.join(repeated, own).groupBy("of_id", "of_node").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return once.select("row.*").unionByName(least.select("row.*"))
