r"""Surrogates for personal data, in built-in functions only.

One pattern finds the entities of a text: e-mail, IPv4 and IPv6 addresses, telephone numbers (with a country code,
and the national forms of `NATIONAL`), card numbers with a valid check digit, US social security numbers, access keys,
values after words such as `password =` or `"token":`, and names after a title. Every loop of the pattern is over
single characters or has a small bound, so that no text, however long, makes the matcher recurse.

Names. A title is followed by given names or initials and a family name (particles, hyphens, apostrophes). A text that
names someone so is searched again for the same full name and the same family name without a title. Each given
and each family name is an entity of its own, so `Mr John Smith`, `Mr Smith`, `John Smith` and `Smith` agree on the
family name. A given name has the gender of its title; without one, that of the same given name in this text, else in
the corpus, if these have one gender only.

Each distinct entity, in its canonical form (numbers without separators, addresses and names in lower case), gets a
surrogate that depends on the secret key, the kind and the canonical form alone, so that every mention in any document
gets the same one. It keeps the kind and the format: character classes, lengths, separators, country code, private
address ranges, card check digits, the reserved example domains; names keep gender, script, particles and hyphens.

A surrogate may be nobody else's: it must differ from those of all other entities and from all entities of the corpus
(given and family names count as one kind). Those that clash are drawn again, with the number of the attempt as a
further input; the entity that sorts first keeps the contested one. Later attempts widen what is drawn from: names,
e-mail addresses, secrets, telephone and social security numbers grow longer, private addresses move to 10/8 and from
there to public ones; so a range that is full of real addresses has a way out. The tables that meet in these joins
hold distinct entities, so hot entities don't weigh.

The table is scanned once, and written with what was found. Texts return to their rows by their digest: only texts
with entities are shuffled, and copies of a text only once. The key reaches the executors as a column of a small
table, a derived key for each kind, and so is in no plan and no event log.

Not found: names without any titled mention in the same text; titles not in the lists; e-mail addresses of over 64
characters before the @ or 250 after it (they aren't valid).

Defined results: a null text stays null, an empty one empty, both with no entities; a text that holds
none comes back as it is; repeated rows are treated alike; other columns are handed through by replace().
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

#: Titles that tell the gender, titles that don't, and particles of family names.
MALE_TITLES = ["Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Господин", "Κύριος"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Госпожа", "Κυρία"]
NEUTRAL_TITLES = ["Dr", "Doctor", "Prof", "Professor"]
PARTICLES = ["van", "von", "der", "den", "de", "del", "della", "da", "di", "la", "le", "du", "dos", "ten", "ter", "zu", "bin"]
#: Syllables of made-up names, by script; the last syllable by gender.
NAME_PARTS = {
    "latin": {"start": "Al Bren Cor Dar El Fen Gar Hal Jor Kel Lor Mar Nor Or Per Quin Ros Sal Tor Vel", "middle": "a e i o u an en in on ar er or al el ol", "m": "mund rick ton vin bert dan", "f": "lia nina dra belle rina tha", "n": "is en yn al"},
    "cyrillic": {"start": "Ал Бор Вел Гор Дар Евг Зор Кир Лад Мир Ник Ол Рад Свят Тих Яр", "middle": "а е и о у ан ен ин ов ар", "m": "слав мир дан бор", "f": "слава мира дана лина", "n": "ай ень"},
    "greek": {"start": "Αλ Βασ Γερ Δαμ Ελ Ζην Θεο Ιασ Καλ Λεων Μαρ Νικ Ορ Παν", "middle": "α ε ι ο αν εν ιν αρ", "m": "ιος ων ας ης", "f": "ια ινη α ω", "n": "ι ω"},
}
_TOKEN = r"\p{Lu}[\p{L}\p{M}]{0,40}+(?:['’]\p{Lu}[\p{L}\p{M}]{1,40}+|-\p{L}[\p{L}\p{M}]{0,40}+){0,3}(?![\p{L}\p{M}\p{Nd}])"
_FAMILY = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{_TOKEN}"
_TITLES = rf"(?:(?:{'|'.join(MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES)})\.? ){{1,3}}"
_NO_LETTER, _END = r"(?<![\p{L}\p{M}\p{Nd}])", r"(?![\p{L}\p{M}\p{Nd}])"
_SECRET_WORD = r"(?:[Pp]assword|PASSWORD|[Pp]asswd|PASSWD|[Pp]wd|PWD|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY|[Aa]ccess[_-]?[Kk]ey|ACCESS[_-]?KEY)"
_SECRET_VALUE = r"[A-Za-z0-9_/+-]{8,}+"
#: National forms of telephone numbers.
NATIONAL = [r"\(\d{3}\) ?\d{3}[.-]\d{4}", r"\d{3}-\d{3}-\d{4}", r"\d{3}\.\d{3}\.\d{4}", r"0\d{2,4}[ /-]\d{5,8}"]
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9.-]{1,250}\.[A-Za-z]{2,24}+(?![A-Za-z0-9-])",
    "secret": rf"{_SECRET_WORD}[A-Za-z0-9_-]{{0,30}}+[\"']? ?[=:] ?[\"']?{_SECRET_VALUE}",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "phone": rf"(?<![\d+])\+\d{{1,3}}[ .-]?\(?\d{{2,4}}\)?[ .-]?\d{{3,4}}[ .-]?\d{{3,4}}(?!\d)|(?<![\d.,/+-])(?:{'|'.join(NATIONAL)})(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)(?!\d|\.\d)",
    "ip6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "card": r"(?<![\d-])(?:\d{4}[ -]\d{6}[ -]\d{5}|\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7})(?![\d-])",
    "name": rf"{_NO_LETTER}{_TITLES}(?:(?:\p{{Lu}}\.|{_TOKEN}) ){{0,5}}{_FAMILY}",
}
#: Inside a word of small letters only a secret's word can begin, so that most places are passed over by one test.
PATTERN = f"(?:{KINDS['secret']})|(?<![a-z](?=[a-z]))(?:{'|'.join(f'(?:{p})' for k, p in KINDS.items() if k != 'secret')})"
#: What any entity has; texts without it are passed over by this alone.
_HINT = rf"[0-9@]|::|{_SECRET_WORD}|{_TITLES}"
_MAX_ROUNDS = 40
_PARSED = "digest string, at int, raw string, kind string, title string, given string, particles string, family string, gender string"


def _kind(raw: Column) -> Column:
    """The kind of a mention; null for what looks like a card or an address and isn't one."""
    out = F.when(raw.rlike(f"^(?:{KINDS['email']})$"), "email").when(raw.rlike(f"^(?:{KINDS['secret']})$"), "secret")
    for name in ("access_key", "phone", "ssn", "ip"):
        out = out.when(raw.rlike(f"^(?:{KINDS[name]})$"), name)
    digits, groups = F.regexp_replace(raw, "[ -]", ""), F.size(F.split(raw, ":"))
    is_v6 = raw.rlike("[0-9]") & ((groups == 8) | (raw.contains("::") & (groups <= 8)))
    return out.when(raw.rlike(r"^[0-9A-Fa-f:]+$") & raw.contains(":"), F.when(is_v6, "ip6")).when(raw.rlike(r"^[\d -]+$"), F.when(F.length(digits).between(13, 19) & F.call_function("luhn_check", digits), "card")).otherwise("name")


def _canonical() -> Column:
    raw = F.col("raw")
    return (
        F.when(F.col("kind").isin("phone", "card", "ssn"), F.regexp_replace(raw, r"[^0-9]", ""))
        .when(F.col("kind").isin("email", "ip6"), F.lower(raw))
        .when(F.col("kind") == "secret", F.regexp_extract(raw, rf"{_SECRET_VALUE}$", 0))
        .otherwise(raw)
    )


# What is drawn, in SQL over the columns kind, canonical, gender, n (the attempt) and k (the kind's derived key).
_SEED = "concat(kind, '|', gender, '|', canonical, '|', n)"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _stream(seed: str, length: str) -> str:
    """A keyed stream: an array of blocks of 64 hex digits, two digits for each of `length` characters."""
    return f"transform(sequence(0, cast({length} / 32 as int)), b -> sha2(concat(k, sha2(concat(k, {seed}, '|', b), 256)), 256))"


def _byte(i: str) -> str:
    """The i-th number (0 to 255) of the stream s."""
    return f"cast(conv(substring(get(s, cast(({i}) / 32 as int)), 1 + 2 * (({i}) % 32), 2), 16, 10) as int)"


def _redraw(text: str, seed: str = _SEED, start: str = "0", hex_only: str = "false") -> str:
    """text, each character from `start` on drawn anew from its class; in linear time."""
    pick = lambda chars: f"substring('{chars}', 1 + {_byte('i')} % {len(chars)}, 1)"
    drawn = f"case when i < lead then c when c rlike '[0-9]' then {pick('0123456789')} when hexed and c rlike '[a-f]' then {pick('abcdef')} when hexed and c rlike '[A-F]' then {pick('ABCDEF')} when c rlike '[a-z]' then {pick('abcdefghijklmnopqrstuvwxyz')} when c rlike '[A-Z]' then {pick('ABCDEFGHIJKLMNOPQRSTUVWXYZ')} else c end"
    return _let("hexed", hex_only, _let("lead", start, _let("s", _stream(seed, f"length({text})"), f"array_join(transform(split({text}, ''), (c, i) -> {drawn}), '')")))  # what is bound is worked out once, not for each character


def _syllable(script: str, which: str, at: str) -> str:
    words = NAME_PARTS[script][which].split()
    return f"element_at(array({', '.join(repr(x) for x in words)}), 1 + (256 * {_byte(at)} + {_byte(f'{at} + 1')}) % {len(words)})"


def _made_name(script: str) -> str:
    """A given name, by gender, or a family name, for each part of a hyphenated one, after a kept O' or the like. Later attempts add syllables."""
    middles = lambda n, at: f"array_join(transform(sequence(1, {n}), j -> {_syllable(script, 'middle', f'{at} + 2 * j')}), '')"
    last = lambda at: f"case gender when 'm' then {_syllable(script, 'm', at)} when 'f' then {_syllable(script, 'f', at)} else {_syllable(script, 'n', at)} end"
    parts = lambda middle, end: f"array_join(transform(split(canonical, '-'), (w, p) -> concat(upper(regexp_extract(w, '^[^\\'’]+[\\'’]', 0)), {_syllable(script, 'start', '64 * p')}, {middles(middle, '64 * p + 4')}, {end})), '-')"
    given, family = parts("1 + n div 2", last("64 * p + 2")), parts("2 + n div 2", _syllable(script, "m", "64 * p + 2"))
    return _let("s", _stream(_SEED, "320"), f"if(kind = 'given', {given}, {family})")


def _address() -> str:
    b = [_byte(str(j)) for j in range(4)]
    narrow = r"^(192\\.168|169\\.254)\\."
    twelve = r"^172\\.(1[6-9]|2[0-9]|3[01])\\."
    private = r"^(10|192\\.168|169\\.254|172\\.(1[6-9]|2[0-9]|3[01]))\\."
    return _let("s", _stream(_SEED, "4"), f"""case when n < 8 and canonical rlike '{narrow}' then concat_ws('.', substring_index(canonical, '.', 2), {b[2]}, {b[3]})
        when n < 8 and canonical rlike '{twelve}' then concat_ws('.', '172', 16 + {b[1]} % 16, {b[2]}, {b[3]})
        when n < 24 and canonical rlike '^127\\\\.' then concat_ws('.', '127', {b[1]}, {b[2]}, {b[3]})
        when n < 24 and canonical rlike '{private}' then concat_ws('.', '10', {b[1]}, {b[2]}, {b[3]})
        else concat_ws('.', 11 + {b[0]} % 89, {b[1]}, {b[2]}, {b[3]}) end""")


def _candidate() -> Column:
    """The surrogate of (kind, canonical, gender) at attempt `n`, in canonical form (names capitalised)."""
    longer = "repeat('0', greatest(0, n - 8))"  # should a short format have no room left
    local, domain = f"concat(split_part(canonical, '@', 1), {longer})", "split_part(canonical, '@', 2)"
    label = "regexp_replace(split_part(canonical, '@', 2), '\\\\.[^.]+$', '')"
    tld = f"if({domain} rlike '\\\\.(com|net|org)$', regexp_extract({domain}, '[^.]+$', 0), 'org')"
    email = f"concat({_redraw(local)}, '@', {_redraw(label, f"concat('domain|', {domain})")}, '.example.', {tld})"
    hexed = "canonical rlike '^[0-9a-f]+$|^[0-9A-F]+$'"
    number = f"concat(canonical, {longer})"
    card = _let("p", f"substring({_redraw('canonical', start='1')}, 1, length(canonical) - 1)", "element_at(filter(transform(sequence(0, 9), d -> concat(p, d)), y -> luhn_check(y)), 1)")
    six = _redraw("canonical", start="if(canonical rlike '^(f[cd]|fe80|2001)', 4, 0)", hex_only="true")
    cases = {
        "email": email,
        "secret": f"concat({_redraw('canonical', hex_only=hexed)}, {_redraw(longer, f"concat('longer|', {_SEED})")})",
        "access_key": _redraw("canonical", start="4"),
        "phone": _redraw(number, start="greatest(if(canonical like '0%', 1, 0), length(canonical) - 9)"),
        "ssn": _redraw(number),
        "card": card,
        "ip": _address(),
        "ip6": six,
        "initial": _redraw("upper(canonical)"),
    }
    name = f"case when canonical rlike '[\\\\u0400-\\\\u04FF]' then {_made_name('cyrillic')} when canonical rlike '[\\\\u0370-\\\\u03FF]' then {_made_name('greek')} else {_made_name('latin')} end"
    return F.expr(f"case kind {' '.join(f"when '{k}' then {v}" for k, v in cases.items())} else {name} end")


def _formatted() -> Column:
    """The surrogates `made` of a mention's parts, in its format."""
    digits = _let("s", "split(made[0], '')", "aggregate(split(raw, ''), named_struct('t', array(''), 'i', 0), (a, c) -> if(c rlike '[0-9]', named_struct('t', array_append(a.t, s[a.i]), 'i', a.i + 1), named_struct('t', array_append(a.t, c), 'i', a.i)), a -> concat(array_join(a.t, ''), array_join(slice(s, a.i + 1, greatest(0, size(s) - a.i)), '')))")
    value = f"concat(regexp_replace(raw, '{_SECRET_VALUE}$', ''), made[0])"
    case = lambda old, new: f"if(length({old}) > 1 and upper({old}) = {old}, upper({new}), {new})"
    names = f"concat(title, array_join(transform(slice(made, 1, size(made) - 1), (x, i) -> concat({case("split(given, ' ')[i]", 'x')}, ' ')), ''), particles, {case('family', 'element_at(made, -1)')})"
    return F.expr(f"case when kind in ('phone', 'card', 'ssn') then {digits} when kind = 'secret' then {value} when kind = 'name' then {names} else made[0] end")


def _keys(df: DataFrame, key: str) -> DataFrame:
    """(of_kind, k): a key for each kind, derived from the secret one; rows of the JVM, which plans show without values."""
    spark, jvm = df.sparkSession, df.sparkSession.sparkContext._jvm
    rows = jvm.java.util.ArrayList()
    for kind in [*KINDS, "given", "family", "initial"]:
        cells = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 2)
        cells[0], cells[1] = kind, hmac.new(key.encode(), kind.encode(), hashlib.sha256).hexdigest()
        rows.add(jvm.org.apache.spark.sql.RowFactory.create(cells))
    schema = jvm.org.apache.spark.sql.types.StructType.fromDDL("of_kind string, k string")
    return DataFrame(spark._jsparkSession.createDataFrame(rows, schema), spark)


def surrogates(mentions: DataFrame, key: str) -> DataFrame:
    """mentions(raw, kind, title, given, particles, family, gender) distinct, with their replacement."""
    spoken = F.struct(F.lit("family").alias("kind"), F.lower("family").alias("canonical"), F.lit("").alias("gender"))
    word = lambda t: F.when(t.endswith("."), F.struct(F.lit("initial").alias("kind"), F.lower(t).alias("canonical"), F.lit("").alias("gender"))).otherwise(F.struct(F.lit("given").alias("kind"), F.lower(t).alias("canonical"), F.col("gender").alias("gender")))
    given = F.when(F.col("given") == "", F.array().cast("array<struct<kind:string,canonical:string,gender:string>>")).otherwise(F.transform(F.split("given", " "), word))
    parts = F.when(F.col("kind") == "name", F.concat(given, F.array(spoken))).otherwise(F.array(F.struct("kind", _canonical().alias("canonical"), F.lit("").alias("gender"))))
    known = cut(mentions.distinct().withColumn("parts", parts), "pii-mentions")
    split = known.select("raw", "gender", F.posexplode("parts").alias("at", "p")).select("raw", F.col("gender").alias("g"), "at", "p.*")
    space = F.when(F.col("kind").isin("given", "family"), "name").otherwise(F.col("kind"))
    entities = split.select("kind", "canonical", "gender").distinct()
    todo, done = entities.withColumn("n", F.lit(0)), None
    real = entities.select(space.alias("space"), F.col("canonical").alias("form")).distinct().withColumn("real", F.lit(True))
    keys = _keys(mentions, key)
    for _ in range(_MAX_ROUNDS):
        made = todo.join(F.broadcast(keys), F.col("kind") == F.col("of_kind")).withColumn("surrogate", _candidate()).drop("k", "of_kind")
        drawn = cut(made.withColumn("space", space).withColumn("form", F.when(F.col("space") == "name", F.lower("surrogate")).otherwise(F.col("surrogate"))), "pii-drawn")
        who = F.struct("kind", "canonical", "gender")
        first = drawn.groupBy("space", "form").agg(F.min(who).alias("owner"))
        judged = drawn.join(first, ["space", "form"]).join(real, ["space", "form"], "left")
        if done is not None:
            judged = judged.join(done.select("space", "form").distinct().withColumn("taken", F.lit(True)), ["space", "form"], "left")
        else:
            judged = judged.withColumn("taken", F.lit(None).cast("boolean"))
        good = (F.col("kind") == "initial") | ((F.col("owner") == who) & F.col("real").isNull() & F.col("taken").isNull())
        judged = cut(judged.withColumn("good", good), "pii-judged")
        fine = judged.where("good").select("kind", "canonical", "gender", "space", "form", "surrogate")
        done = fine if done is None else done.unionByName(fine)
        todo = judged.where("not good").select("kind", "canonical", "gender", (F.col("n") + 1).alias("n"))
        if todo.isEmpty():
            back = split.join(done.select("kind", "canonical", "gender", "surrogate"), ["kind", "canonical", "gender"])
            made = back.groupBy("raw", "g").agg(F.array_sort(F.collect_list(F.struct("at", "surrogate"))).alias("m")).select(F.col("raw").alias("of"), "g", F.expr("transform(m, x -> x.surrogate)").alias("made"))
            return known.join(made, (F.col("raw") == F.col("of")) & (F.col("gender") == F.col("g"))).withColumn("replacement", _formatted()).drop("of", "g", "made", "parts")
    raise RuntimeError("surrogates still clash")


def _empty(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def _searched(texts: DataFrame) -> DataFrame:
    """texts(digest, body, mentions) with `pattern`; texts with names are searched again for these names without a title."""
    border = lambda x: F.concat(F.lit(rf"|{_NO_LETTER}(?=\p{{L}})(?:"), x, F.lit(f"){_END}"))
    names = F.transform(F.filter("mentions", lambda m: m.rlike(f"^(?:{KINDS['name']})$")), lambda m: F.regexp_replace(m, f"^{_TITLES}", ""))
    told = F.array_distinct(F.concat(F.col("names"), F.transform("names", lambda x: F.regexp_extract(x, f"{_FAMILY}$", 0))))
    longest = F.transform(F.sort_array(F.transform(told, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))), asc=False), lambda s: F.concat(F.lit(r"\Q"), s["x"], F.lit(r"\E")))
    more = F.when(F.size("names") == 0, F.lit("")).otherwise(border(F.array_join(longest, "|")))
    found = texts.withColumn("names", names).withColumn("pattern", F.concat(F.lit(PATTERN), more))
    again = F.when(F.size("names") == 0, F.col("mentions")).otherwise(F.call_function("regexp_extract_all", F.col("body"), F.col("pattern"), F.lit(0)))
    return cut(found.withColumn("mentions", again).drop("names"), "pii-texts")


def _parsed(texts: DataFrame) -> DataFrame:
    """(digest, at, raw, kind, title, given, particles, family, gender) of every mention; kind is null where it is no entity."""
    raw, name = F.col("raw"), F.col("kind") == "name"
    of_name = lambda c: F.when(name, c).otherwise(F.lit(""))
    rest, own = F.regexp_replace(raw, f"^{_TITLES}", ""), lambda words: F.col("title").rlike(rf"(?:^|[ .])(?:{'|'.join(words)})\.? ")
    spoken = texts.select("digest", F.posexplode("mentions").alias("at", "raw")).withColumn("kind", _kind(raw))
    spoken = spoken.withColumn("title", of_name(F.regexp_extract(raw, f"^{_TITLES}", 0))).withColumn("whole", of_name(F.regexp_extract(rest, f"{_FAMILY}$", 0)))
    spoken = spoken.withColumn("given", of_name(F.rtrim(F.expr("substring(raw, 1 + length(title), length(raw) - length(title) - length(whole))")))).withColumn("family", of_name(F.regexp_extract("whole", f"{_TOKEN}$", 0)))
    spoken = spoken.withColumn("particles", F.expr("substring(whole, 1, length(whole) - length(family))")).drop("whole")
    spoken = cut(spoken.withColumn("told", F.when(own(MALE_TITLES), "m").when(own(FEMALE_TITLES), "f")), "pii-spoken")
    first = F.element_at(F.split("given", " "), 1)
    same = W.partitionBy("digest", first)
    of_text = F.when(F.min("told").over(same) == F.max("told").over(same), F.min("told").over(same))
    named = spoken.where("given <> ''").withColumn("of_text", of_text)
    single = spoken.where("given <> '' and told is not null").groupBy(first.alias("known_given")).agg(F.min("told").alias("lo"), F.max("told").alias("hi")).where("lo = hi").select("known_given", F.col("lo").alias("of_corpus"))
    named = named.join(single, first == F.col("known_given"), "left").withColumn("gender", F.coalesce("told", "of_text", "of_corpus", F.lit("n")))
    others = spoken.where("given = ''").withColumn("gender", F.lit(""))
    columns = [c.split()[0] for c in _PARSED.split(", ")]
    return cut(named.select(columns).unionByName(others.select(columns)), "pii-parsed")


def replace(docs: DataFrame, key: str, text: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
    """docs, same columns, entities in `text` replaced; with counts=(name, name) also how many, and of which kinds."""
    row = docs.select(F.struct(*docs.columns).alias("row"))
    body = F.col("row").getField(text)
    found = F.when(body.rlike(_HINT), F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0)))
    scanned = cut(row.withColumn("mentions", F.coalesce(found, _empty())), "pii-scanned")
    with_some = scanned.where(F.size("mentions") > 0).withColumn("digest", F.md5(body))
    texts = _searched(with_some.select("digest", body.alias("body"), "mentions").dropDuplicates(["digest"]))
    spoken = _parsed(texts)
    named = surrogates(spoken.where("kind is not null").drop("digest", "at"), key).select("raw", "gender", "replacement")
    ordered = spoken.join(named, ["raw", "gender"], "left").groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("replacement", "raw").alias("new"), "kind"))).alias("m"))
    parts = F.call_function("split", F.col("body"), F.col("pattern"), F.lit(-1))
    woven = F.array_join(F.flatten(F.zip_with(parts, F.concat(F.expr("transform(m, x -> x.new)"), F.array(F.lit(""))), lambda p, s: F.array(p, s))), "")
    told = "filter(transform(m, x -> x.kind), x -> x is not null)"
    made = texts.join(ordered, "digest").select("digest", woven.alias("woven"), F.expr(f"cast(size({told}) as bigint)").alias("n"), F.expr(f"array_join(array_sort(array_distinct({told})), ',')").alias("kinds"))
    extra = lambda n, k: [] if counts is None else [n.alias(counts[0]), k.alias(counts[1])]
    same = lambda new: [F.col("row").getField(c).alias(c) if c != text else new.alias(c) for c in docs.columns]
    changed = with_some.join(made, "digest").select(*same(F.col("woven")), *extra(F.col("n"), F.col("kinds")))
    plain = scanned.where(F.size("mentions") == 0).select(*same(body), *extra(F.lit(0).cast("bigint"), F.lit("")))
    return plain.unionByName(changed)


def report(docs: DataFrame, key: str) -> DataFrame:
    """One row per document: the text with surrogates, how many entities it had and of which kinds."""
    return replace(docs.select("doc_id", "text"), key, counts=("n_entities", "kinds"))
