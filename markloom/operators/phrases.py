"""Phrases in texts: all places where one stands on its own, names under protected borders, and canonical aliases.

One scan serves both searches: phrases of a-z alone are joined with the texts' runs of a-z; for others an automaton over the phrases (Aho and
Corasick, 1975) runs over each text once, and borders are judged for all of a text's finds at once, as numpy arrays. The automaton is broadcast as long as the phrases have at most
`DICTIONARY_BYTES`; more phrases are parted by their first character (one character's, if still too many, by hash) and scanned part by part, each
part's finds written before the next part is read, so neither the driver nor a worker holds more than one part.

Defined results: null and empty texts hold nothing; null and empty phrases are nowhere; repeated rows are found row by row; an empty
dictionary finds nothing. Positions count code points.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from markloom.functions import rules
from markloom.session import ship_package
from markloom.sources.files import saved

DICTIONARY_BYTES = 64 << 20
#: Bytes that the automaton needs besides a phrase's own.
_NODE = 32
_RUN = "^[a-z]+$"
#: Texts that are looked through at once.
_TEXT_BYTES = 1 << 20

Border = Callable[["Text", np.ndarray, np.ndarray], np.ndarray]


class Classes:
    """Code points by the sets of categories and signs they belong to; each is looked up once."""

    def __init__(self):
        self.known: dict[int, int] = {}

    def of(self, codes: np.ndarray) -> np.ndarray:
        found, at = np.unique(codes, return_inverse=True)
        get, make = self.known.get, self._make
        return np.array([b if (b := get(c)) is not None else make(c) for c in found.tolist()], np.uint8)[at] if len(codes) else np.zeros(0, np.uint8)

    def _make(self, code: int) -> int:
        char = chr(code)
        kind = unicodedata.category(char)
        word = char.isalnum() or char in rules.WORD_JOINERS or kind[0] == "M"
        bits = (kind[0] in "LNM" or kind in rules.GOES_ON_KINDS or char in rules.GOES_ON) << 0
        bits |= (char in rules.OPENING) << 1 | (char in rules.CLOSING) << 2 | (char == ".") << 3
        bits |= word << 4 | (word or kind in rules.COMPACT_KINDS or char in rules.COMPACT) << 5
        self.known[code] = bits
        return bits


_GOES_ON, _OPENS, _CLOSES, _DOT, _WORD, _COMPACT = (1 << k for k in range(6))


class Text:
    """A text's characters as bits, with two cells of nothing at either end."""

    def __init__(self, text: str, classes: Classes):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.bits = np.concatenate([np.zeros(2, np.uint8), classes.of(self.codes), np.zeros(2, np.uint8)])
        self.places = np.arange(len(self.bits))

    def at(self, places: np.ndarray, bit: int) -> np.ndarray:
        return (self.bits[places + 2] & bit) > 0

    def before(self, bit: int) -> np.ndarray:
        """For each cell, the last one up to it that lacks a bit."""
        return np.maximum.accumulate(np.where(self.bits & bit, 0, self.places))

    def after(self, bit: int) -> np.ndarray:
        """For each cell, the first one from it on that lacks a bit."""
        return np.minimum.accumulate(np.where(self.bits & bit, self.places[-1], self.places)[::-1])[::-1]


def standing_alone(text: Text, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a span is a token of its own: not part of a longer one, of a bracketed compound, or of one with a dot inside."""
    bad = text.at(start - 1, _GOES_ON | _CLOSES) | text.at(end, _GOES_ON | _OPENS)
    left, right = text.before(_OPENS)[start + 1] - 2, text.after(_CLOSES)[end + 2] - 2
    bad |= (left < start - 1) & text.at(left, _GOES_ON)
    bad |= (right > end) & text.at(right, _GOES_ON | _OPENS)
    dotted = text.at(end, _DOT) & text.at(end + 1, _GOES_ON) | text.at(start - 1, _DOT) & text.at(start - 2, _GOES_ON)
    return ~(bad | dotted)


def within_words(text: Text, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether neither neighbour goes on a word."""
    return ~(text.at(start - 1, _WORD) | text.at(end, _WORD))


def within_compacts(text: Text, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether neither neighbour goes on a word or a compact identifier (a formula, a charge, a hyphenated code)."""
    return ~(text.at(start - 1, _COMPACT) | text.at(end, _COMPACT))


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for i, phrase in enumerate(phrases):
        made.add_word(phrase, (i, len(phrase)))
    made.make_automaton()
    return made


def finds(made: ahocorasick.Automaton, text: str, apart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, start, end) of all finds; if apart, those of one phrase from left to right without overlaps."""
    which, start, end, last = [], [], [], {}
    for at, (i, n) in made.iter(text):
        if apart and last.get(i, 0) > at + 1 - n:
            continue
        last[i] = at + 1
        which.append(i), start.append(at + 1 - n), end.append(at + 1)
    return np.array(which, np.int64), np.array(start, np.int64), np.array(end, np.int64)


def _parts(phrases: DataFrame, limit: int) -> Iterator[DataFrame]:
    """phrases(phrase) in parts of at most `limit` bytes."""
    weight = F.octet_length("phrase") + F.length("phrase") * _NODE
    first = phrases.groupBy(F.substring("phrase", 1, 1).alias("c")).agg(F.sum(weight).alias("n")).orderBy("c").collect()  # a row a character at most
    if sum(r.n for r in first) <= limit:
        yield phrases
        return
    held, size = [], 0
    for r in [*first, None]:
        if held and (r is None or size + r.n > limit):
            many = -(-size // limit)
            part = phrases.where(F.substring("phrase", 1, 1).isin(held))
            yield from (part.where(F.pmod(F.xxhash64("phrase"), F.lit(2 * many)) == k) for k in range(2 * many)) if many > 1 else [part]
            held, size = [], 0
        if r is not None:
            held, size = [*held, r.c], size + r.n


def runs(texts: list[str], border: Border, classes: Classes) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(text, run, start, end): the whole runs of a-z in texts that a border lets pass, all at once. Between two texts stands a line feed, which no border sees over."""
    all_of, first = Text("\n".join(texts), classes), np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    turns = np.diff(np.concatenate([[0], (all_of.codes >= 97) & (all_of.codes <= 122), [0]]).astype(np.int8))
    start, end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    good = border(all_of, start, end)
    start, end = start[good], end[good]
    ends = np.cumsum(end - start)
    cells = np.repeat(start - ends + (end - start), end - start) + np.arange(ends[-1] if len(ends) else 0)
    named = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(all_of.codes[cells].astype(np.uint8)))
    row = np.searchsorted(first, start, "right") - 1
    return row, named, start - first[row], end - first[row]


def places(texts: list[str], made: ahocorasick.Automaton, border: Border, classes: Classes, apart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, phrase, start, end): the automaton's finds in texts that a border lets pass, judged for all texts at once, as in runs."""
    held, met, first, size = [], [], [], 0
    for k, text in enumerate(texts):
        found = finds(made, text, apart)
        if len(found[0]):
            held.append(text), met.append((np.full(len(found[0]), k), *found)), first.append(np.full(len(found[0]), size))
            size += len(text) + 1
    if not held:
        return (np.zeros(0, np.int64),) * 4
    row, which, start, end = (np.concatenate(x) for x in zip(*met, strict=True))
    at = np.concatenate(first)
    good = border(Text("\n".join(held), classes), start + at, end + at)
    return row[good], which[good], start[good], end[good]


def _slices(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch, whose first column is a text, in pieces of some _TEXT_BYTES."""
    size = np.cumsum(pa.compute.binary_length(whole.column(0)).to_numpy(zero_copy_only=False)) // _TEXT_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(whole)]
    for a, z in zip(cuts, cuts[1:], strict=False):
        yield whole.slice(a, z - a)


def scan(texts: DataFrame, phrases: DataFrame, border: Border, apart: bool, limit: int = DICTIONARY_BYTES) -> DataFrame:
    """texts' columns but text, with (phrase, start, end) of all finds of phrases(phrase) that a border lets pass.

    No border passes beside a letter, so a phrase of a-z alone is a whole run of these in a text: the texts' runs meet such phrases by equality,
    which reads the texts once, however many phrases there are. The automaton finds the others."""
    spark = texts.sparkSession
    ship_package(spark)
    keys = [c for c in texts.columns if c != "text"]
    rows = texts.where("text <> ''").select("text", *keys)
    schema = StructType([*(texts.schema[c] for c in keys), *StructType.fromDDL("phrase string, start int, `end` int")])
    arrow = to_arrow_schema(schema)
    wanted = saved(phrases.where("phrase <> ''").select("phrase").distinct(), "wanted-phrases")
    plain, other = wanted.where(F.col("phrase").rlike(_RUN)), wanted.where(~F.col("phrase").rlike(_RUN))

    def over_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes()
        for whole in batches:
            for batch in _slices(whole):
                row, named, start, end = runs(batch.column(0).to_pylist(), border, classes)
                own = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*own.columns[1:], named, pa.array(start, pa.int32()), pa.array(end, pa.int32())], schema=arrow)

    def part(some: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast([r.phrase for r in some.collect()])  # `limit` bytes at most

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            made, classes = automaton(phrases), Classes()
            if not phrases:
                return
            for whole in batches:
                for batch in _slices(whole):
                    row, which, start, end = places(batch.column(0).to_pylist(), made, border, classes, apart)
                    own = batch.take(pa.array(row))
                    named = pa.array(phrases, pa.string()).take(pa.array(which)) if len(phrases) < len(which) else pa.array([phrases[w] for w in which.tolist()], pa.string())
                    yield pa.RecordBatch.from_arrays([*own.columns[1:], named, pa.array(start, pa.int32()), pa.array(end, pa.int32())], schema=arrow)

        return rows.mapInArrow(over, schema)

    met = [] if plain.isEmpty() else [rows.mapInArrow(over_runs, schema).join(plain, "phrase", "left_semi").select(*schema.names)]
    if not met or not other.isEmpty():
        parts = list(_parts(other, limit))
        met += [part(parts[0])] if len(parts) == 1 else [saved(part(p), "phrases") for p in parts]
    return reduce(DataFrame.union, met)


def phrase_spans(texts: DataFrame, phrases: DataFrame, limit: int = DICTIONARY_BYTES) -> DataFrame:
    """texts' columns but text, (phrase, start, end): where phrases(phrase) stand alone in texts, literally."""
    return scan(texts, phrases, standing_alone, True, limit)


def _classed(names: DataFrame, blocked: list[str]) -> DataFrame:
    """names(name, cid) with the form to search and how: `blocked` (a reserved label, or one that several concepts share but for case),
    `folded` (phrases and long words in lower case) or `exact`."""
    key = _casefold(F.col("name"))
    rows = names.where("name <> ''").select("name", "cid", key.alias("key"))
    shared = rows.groupBy("key").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo <> hi").select("key", F.lit(True).alias("shared"))
    blind = F.col("name").contains(" ") | ((F.length("name") > 4) & F.col("name").rlike(r"^\p{L}+$") & ~F.col("name").rlike(r"[\p{Lu}\p{Lt}]") & F.col("name").rlike(r"[\p{Ll}ªº]"))
    how = F.when(F.col("shared").isNotNull() | F.col("key").isin(*blocked, ""), "blocked").when(blind, "folded").otherwise("exact")
    rows = rows.join(shared, "key", "left").withColumn("how", how)
    return rows.select("name", "cid", "how", F.when(F.col("how") == "exact", F.col("name")).otherwise(F.col("key")).alias("phrase"))


@F.pandas_udf(StringType())
def _casefold_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t.casefold())


def _casefold(text: Column) -> Column:
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.lower(text)).otherwise(_casefold_udf(text))


def protected_matches(texts: DataFrame, names: DataFrame, blocked: list[str] | None = None, limit: int = DICTIONARY_BYTES) -> DataFrame:
    """texts' columns but text, (name, cid, how): the names(name, cid) in texts, each once a row of texts.

    Compact names keep their case and must not touch signs that go on an identifier; phrases and long words are found in any case at
    word borders; blocked names are told as such, so that nobody takes them for a concept."""
    classed = saved(_classed(saved(names.select("name", "cid"), "given-names"), blocked or []), "names")
    keys = [c for c in texts.columns if c != "text"]
    rows = texts.select("text", F.struct(*keys, F.monotonically_increasing_id().alias("_row")).alias("own"))
    rows = saved(rows, "named-texts")
    folded = rows.select("own", _casefold(F.col("text")).alias("text"))
    out = []
    for how, over, border in (("exact", rows.select("own", "text"), within_compacts), ("folded", folded, within_words), ("blocked", folded, within_compacts)):
        mine = classed.where(F.col("how") == how)
        found = scan(over, mine.select("phrase"), border, False, limit).select("own", "phrase").distinct()
        out.append(found.join(mine, "phrase").select("own", "name", "cid", "how"))
    return reduce(DataFrame.union, out).select("own.*", "name", "cid", "how").drop("_row")


# ---- aliases ----

_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t).strip())


@F.pandas_udf(StringType())
def _lower(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t.lower())


def lexical(name: Column) -> Column:
    """A name's spelling: composed, script digits and dashes plain, white space single; compact identifiers and charges keep their
    case, all else is in lower case and American. Null for blank names and those over 256 characters."""
    plain = name.rlike(r"^[\x00-\x7F]*$")
    composed = F.when(plain, F.regexp_replace(name, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")).otherwise(_composed(name))
    value = F.regexp_replace(F.translate(F.translate(composed, *rules.SCRIPT_SIGNS), rules.DASHES, "-" * len(rules.DASHES)), f"{_SPACE}+", " ")
    charged = value.rlike(rules.CHARGED)
    compact = (~value.contains(" ") | charged) & value.rlike(r"[\p{Lu}\p{Nd}\p{No}+\-*()\[\]]")
    lower = F.when(value.rlike(r"^[\x00-\x7F]*$"), F.lower(value)).otherwise(_lower(value))
    for british, american in rules.SPELLINGS.items():
        lower = F.regexp_replace(lower, rf"(?U)\b{british}\b", american)
    usable = F.length(F.regexp_replace(name, f"{_SPACE}+", "")).between(1, 256) & (F.length(name) <= 256)
    return F.when(usable, F.when(compact, F.regexp_replace(value, r" ([+-])$", "$1")).otherwise(lower))


def singular(value: Column) -> Column:
    """What a plural might be the plural of; others stay."""
    n = F.length(value)
    ending = lambda *ends: reduce(lambda a, b: a | b, [value.endswith(e) for e in ends])
    less = lambda k: F.substring(value, 1, n - k)
    form = F.when(ending("ies") & (n > 5), F.concat(less(3), F.lit("y"))).when(ending("sses"), less(2)).when(ending("s") & ~ending("ss", "us", "is"), less(1)).otherwise(value)
    return F.when((n > 4) & value.rlike("^[a-z -]+$"), form).otherwise(value)


def alias_canon(names: DataFrame, corpus: DataFrame) -> DataFrame:
    """names(name) with canonical: its lexical form, or the singular of it if corpus(name) has that and the relation isn't a chain.

    The corpus answers by a semi-join for singulars and an anti-join for what their own singulars would be.

    Forms are written before they are asked for: a filter on them would be worked out below a grouping of names, for each of its rows."""
    forms = saved(names.select("name", lexical(F.col("name")).alias("value")), "alias-forms")
    told = forms.select(F.col("value").alias("form")) if corpus is names else saved(corpus.select(lexical(F.col("name")).alias("form")), "corpus-forms")
    known = told.where("form is not null").distinct()
    rows = forms.withColumn("single", singular(F.col("value")))
    asked = rows.where("single <> value").select("single").distinct()
    there = asked.join(known, asked.single == known.form, "left_semi")
    shorter = F.when(F.col("single").endswith("s"), F.expr("left(single, length(single) - 1)"))
    sure = there.join(known, shorter == known.form, "left_anti").withColumnRenamed("single", "sure")
    return rows.join(sure, F.col("single") == F.col("sure"), "left").select("name", F.coalesce("sure", "value").alias("canonical"))
