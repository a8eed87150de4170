"""Source divergence audit: how far the sources of a language differ in their use of its terms, and in which terms.

Terms are runs of letters (any character beyond ASCII is one), A-Z lower-cased. A language keeps the V terms that at least
`MIN_DOCS` of its documents hold. A source with N kept terms in all gives a term it has c times the share
p = 1 + floor(10^9 (c + 5) / (N + 5 V)), in exact integers; the language as a whole gives it q alike. Two sources differ by the
sum of |p - p'| over all kept terms; a source's own terms are those with p > q.

Sums over pairs of sources are split by how many sources hold a term. Let b be the share of a term that a source lacks. Then
V |b - b'| is the sum as if both lacked all terms, and what follows corrects it:

* heavy terms (in over `light_limit` sources of their language) fill dense numpy tiles, `TILE_SOURCES` sources by `TILE_TERMS`
  terms; each pair of tiles of the same terms adds |p - p'| - |b - b'|.
* light terms that only one of a pair holds: a source's histogram of light shares, evaluated at the other's b.
* light terms that both hold: postings of at most light_limit sources, paired within the term by numpy and summed by pair in the
  task before anything moves, as |p - p'| + |b - b'| - |p - b'| - |b - p'|.

The parts are whole numbers (64 bits: a sum is at most 2 * 10^9 + 2 V), so their sum is exact whatever the order.

A hot source, language or term is spread: terms are counted within tasks first, sums are partial first, tiles are
bounded, and the joins on (lang, term) have one row a source and term. All pairs of sources of a language are the result itself.

Defined results: null text, lang and source are empty strings; a source without terms is a group like others; a language without
kept terms has pairs of value 0; repeated rows are documents of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, cut, give_back, slices

MIN_DOCS, TOP_TERMS = 30, 50
TILE_SOURCES, TILE_TERMS = 128, 2048
#: A term is light if at most so many sources of its language hold it: an eighth of them, where a pair's posting costs what eight dense entries do.
LIGHT_MOST, LIGHT_SHARE = 512, 8
#: Terms that a task counts before it hands them on.
HELD = 400_000
#: Groups that may be broadcast (a few hundred bytes each), counted first.
BROADCAST_ROWS = 50_000
#: A-Z as a-z, other ASCII but a-z as spaces.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; a null term stands for each group itself."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def rows(found: dict, held: dict) -> pa.RecordBatch:
        flat = [(*group, term.decode("utf-8", "replace"), n, held[group][term]) for group, terms in found.items() for term, n in terms.items()]
        flat += [(*group, None, 0, 0) for group in found]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*flat, strict=True), schema, strict=True)], schema=schema)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        found, held = defaultdict(Counter), defaultdict(Counter)
        for batch in batches:
            for piece in slices(batch):
                for lang, source, text in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    n, once = found[lang, source], held[lang, source]
                    seen: set[bytes] = set()
                    for block in blocks(text.encode().translate(_TERMS)):
                        words = block.split()
                        n.update(words)
                        seen.update(words)
                    once.update(seen)
            if sum(map(len, found.values())) > HELD:
                yield rows(found, held)
                found, held = defaultdict(Counter), defaultdict(Counter)
        if found:
            yield rows(found, held)

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    counted = docs.select(*text).mapInArrow(over, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    parts = {"a": F.lit(1_000_000_000).cast("decimal(10,0)") * (wide(count) + wide(F.lit(5))), "b": wide(total) + wide(F.lit(5)) * wide(terms)}
    return F.call_function("div", parts["a"], parts["b"]) + 1


def _small(df: DataFrame) -> DataFrame:
    """df to be broadcast if it has few rows, else as it is."""
    return F.broadcast(df) if len(df.select(F.lit(1)).take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS else df


def audited(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """groups(lang, source, total, terms, base, n_sources), kept(lang, term, total, holders, q) and held(lang, source, term, n), each written to the shared folder."""
    counts = cut(term_counts(docs), "divergence-counts")
    terms = counts.where("term is not null")
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.count("*").alias("holders"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    kept = cut(kept, "divergence-kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    held = cut(terms.drop("docs").join(kept.select("lang", "term"), ["lang", "term"]), "divergence-held")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    sizes = groups.groupBy("lang").agg(F.count("*").alias("n_sources"))
    base = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(1)
    groups = cut(groups.join(sizes, "lang").withColumn("base", base), "divergence-groups")
    q = share(F.col("n"), F.col("lang_total"), F.col("terms"))
    return groups, kept.join(_small(langs), "lang").select("lang", "term", "holders", q.alias("q")), held


def report(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, light_share: int = LIGHT_SHARE, tile: tuple[int, int] = (TILE_SOURCES, TILE_TERMS)) -> DataFrame:
    """Part `pair`: each other source of the language by its distance; part `term`: a source's own terms, the first `top`."""
    groups, kept, held = audited(docs, min_docs)
    rows = held.join(kept, ["lang", "term"]).join(_small(groups.select("lang", "source", "total", "terms", "base", "n_sources")), ["lang", "source"])
    limit = F.least(F.lit(LIGHT_MOST), F.greatest(F.lit(1), F.floor(F.col("n_sources") / light_share)))
    rows = cut(rows.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "q", "base", (F.col("holders") > limit).alias("heavy"), "n_sources"), "divergence-shares")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    pairs = distances(groups, rows, tile).withColumn("rank", F.row_number().over(by))
    return own.union(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank"))


def distances(groups: DataFrame, rows: DataFrame, tile: tuple[int, int] = (TILE_SOURCES, TILE_TERMS)) -> DataFrame:
    """(lang, source, item, value): every pair of sources, both ways round; the parts of each sum added by pair."""
    parts = _lacking(groups, rows.where("not heavy")).union(_dense(groups, rows.where("heavy"), *tile)).union(_sparse(rows.where("not heavy")))
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", ways.alias("way"), "value").select("lang", "way.*", "value")


def _lacking(groups: DataFrame, light: DataFrame) -> DataFrame:
    """(lang, a, b, v), a < b: what no term gives, and each one's light terms as if the other lacked them.

    Of a histogram, shares beyond every base of the language change alike whatever the base: they are summed up in one entry.
    """
    most = groups.groupBy("lang").agg(F.max("base").alias("most"))
    low = F.col("p") < F.col("most")
    bins = light.join(_small(most), "lang").groupBy("lang", "source", F.when(low, F.col("p")).alias("p")).agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    hist = bins.groupBy("lang", "source").agg(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", "n"))).alias("bins"), F.coalesce(F.sum(F.when(F.col("p").isNull(), F.col("n"))), F.lit(0)).alias("over_n"), F.coalesce(F.sum(F.when(F.col("p").isNull(), F.col("s"))), F.lit(0)).alias("over_s"))
    all_groups = groups.select("lang", "source", "base", "terms").join(hist, ["lang", "source"], "left").na.fill(0, ["over_n", "over_s"])
    one, other = (all_groups.select("lang", F.struct("source", "base", "terms", "bins", "over_n", "over_s").alias(x)) for x in "xy")
    met = one.join(other, "lang").where("x.source < y.source")
    apart = "abs(x.base - y.base)"

    def alone(x: str, y: str) -> str:
        bins = f"aggregate(coalesce({x}.bins, array()), 0L, (sum, h) -> sum + h.n * (abs(h.p - {y}.base) - {apart}))"
        return f"({x}.over_s - {x}.over_n * ({y}.base + {apart}) + {bins})"

    return met.select("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.expr(f"x.terms * {apart} + {alone('x', 'y')} + {alone('y', 'x')}").alias("v"))


_PAIRS = "lang string, a string, b string, v bigint"


def _summed(lang: list, a: list, b: list, v: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(v, pa.int64())], ["lang", "a", "b", "v"])


def _dense(groups: DataFrame, heavy: DataFrame, tile_sources: int, tile_terms: int) -> DataFrame:
    """(lang, a, b, v): corrections by heavy terms, tile by tile.

    Sources and terms fall into blocks by hash, of the tiles' size on average; a source's shares in a block of terms are one
    row, even if it holds none of them, and go to the pairs of blocks that theirs belongs to.
    """
    n_terms = heavy.select("lang", "term").distinct()
    blocks_of = n_terms.groupBy("lang").agg(F.ceil(F.count("*") / tile_terms).alias("n_blocks"))
    at = n_terms.join(_small(blocks_of), "lang").withColumn("t", F.pmod(F.xxhash64("term"), F.col("n_blocks")))
    at = at.withColumn("no", F.row_number().over(Window.partitionBy("lang", "t").orderBy("term")) - 1).select("lang", "term", "t", "no")
    n = F.ceil(F.col("n_sources") / tile_sources)
    none = groups.join(blocks_of, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)).alias("t"), "source", "base", n.alias("n"), F.lit(None).cast("int").alias("no"), F.lit(None).cast("bigint").alias("p"))
    some = heavy.join(at, ["lang", "term"]).select("lang", "t", "source", "base", n.alias("n"), "no", "p")
    lines = some.union(none).groupBy("lang", "t", "source", "base", "n").agg(F.collect_list("no").alias("no"), F.collect_list("p").alias("p"))
    lines = lines.withColumn("own", F.pmod(F.xxhash64("source"), F.col("n"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    lines = lines.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).select("lang", "t", "i", "j", "source", "base", "own", "no", "p")

    def tile(table: pa.Table) -> pa.Table:
        lang, i, j = (table.column(c)[0].as_py() for c in ("lang", "i", "j"))
        sources, base, own = (table.column(c).to_pylist() for c in ("source", "base", "own"))
        base = np.array(base, np.int64)
        no = [x.values.to_numpy(zero_copy_only=False) for x in table.column("no")]
        shares = np.repeat(base[:, None], max(int(x.max(initial=-1)) for x in no) + 1, 1)
        for k, p in enumerate(table.column("p")):
            shares[k, no[k]] = p.values.to_numpy(zero_copy_only=False)
        out: list[list] = [[], [], []]
        rows = np.arange(len(sources))
        of = np.array(own)
        for k, source in enumerate(sources):
            others = rows[k + 1 :] if i == j else rows[of == j] if of[k] == i else rows[:0]
            if len(others):
                v = np.abs(shares[others] - shares[k]).sum(1) - shares.shape[1] * np.abs(base[others] - base[k])
                for o, x in zip(others.tolist(), v.tolist(), strict=True):
                    a, b = sorted((source, sources[o]), key=lambda s: s.encode())
                    out[0].append(a), out[1].append(b), out[2].append(x)
        return pa.Table.from_batches([_summed([lang] * len(out[0]), *out)])

    return lines.groupBy("lang", "t", "i", "j").applyInArrow(tile, _PAIRS)


def _sparse(light: DataFrame) -> DataFrame:
    """(lang, a, b, v): corrections by light terms that both hold, summed by pair within a task as long as it holds few pairs."""
    bounded_batches(light.sparkSession)
    postings = light.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "base"))).alias("at")).where(F.size("at") > 1)  # light_limit at most

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        sums: dict[tuple[str, str, str], int] = defaultdict(int)
        for batch in batches:
            for lang, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sources, p, base = [x["source"] for x in at], np.array([x["p"] for x in at]), np.array([x["base"] for x in at])
                for k in range(len(at) - 1):
                    q, c = p[k + 1 :], base[k + 1 :]
                    v = np.abs(q - p[k]) + np.abs(c - base[k]) - np.abs(p[k] - c) - np.abs(q - base[k])
                    for source, x in zip(sources[k + 1 :], v.tolist(), strict=True):
                        sums[lang, sources[k], source] += x
                if len(sums) > HELD:
                    yield _summed(*zip(*sums, strict=True), list(sums.values()))
                    sums.clear()
        if sums:
            yield _summed(*zip(*sums, strict=True), list(sums.values()))

    return postings.select("lang", "at").mapInArrow(over, _PAIRS)


#: The same figures in DuckDB's SQL.
SQL = rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+')) as term from d),
c as (select lang, source, term, count(*) as n from w group by all),
k as (select lang, term, sum(n)::hugeint as n, sum(docs) as docs from (select lang, term, count(*) as n, count(distinct r) as docs from w group by all) group by all having sum(docs) >= {MIN_DOCS}),
l as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from k group by lang),
g as (select lang, source, coalesce(sum(c.n) filter (k.term is not null), 0)::hugeint as total from (select distinct lang, source from d) left join c using (lang, source) left join k using (lang, term) group by all),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) as p, 1 + (1000000000::hugeint * (k.n + 5)) // (l.total + 5 * l.v) as q
  from g join l using (lang) join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
f as (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
pairs as (select x.lang, x.source, 'pair' as part, y.source as item, coalesce(value, 0)::bigint as value from g x join g y on x.lang = y.lang and x.source <> y.source left join f on f.lang = x.lang and f.source = x.source and f.item = y.source),
terms as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from p where n > 0 and p > q)
select lang, source, part, item, value, row_number() over (partition by lang, source, part order by value desc, encode(item))::int as rank from (select * from pairs union all select * from terms)
qualify part = 'pair' or rank <= {TOP_TERMS}
"""
