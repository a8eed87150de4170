"""Grounding of questions: the names of concepts that they literally hold, the one kind of target they ask for, or why neither.

A question is declined with the first reason that applies: it is blank or too long; a name it holds (the least, by code points) belongs to
several concepts or to one without members; it holds no name, or over 32 places of names; it names no target, or several. Targets are
labels of two levels. Where a question qualifies a label (`fine: alloys`), every qualifier must be followed by a label of its level, of
which the longest counts; else labels count wherever they stand alone, unless the same words are labels of several targets.

Names and labels are found by the automaton of operators/phrases.py. What comes together by question are places in its own text, which
is 16,384 bytes long at most.

Defined results: null texts are blank; null or empty names and labels are never found; repeated concepts and members count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from markloom.functions import rules
from markloom.operators.phrases import phrase_spans
from markloom.sources.files import saved

MAX_BYTES, MAX_PLACES = 16_384, 32
LEVELS = ("coarse", "fine")


def _plural(label: Column) -> Column:
    return F.when(label.endswith("y"), F.concat(F.expr("left(label, length(label) - 1)"), F.lit("ies"))).when(label.endswith("s"), label).otherwise(F.concat(label, F.lit("s")))


def label_phrases(concepts: DataFrame) -> DataFrame:
    """(level, target, phrase, bare): every way to write a label; bare ones don't name their level."""
    labels = concepts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(k).alias("label")) for k in LEVELS])).alias("l")).select("l.*").where("label <> ''").distinct()
    label, level = F.col("label"), F.col("level")
    plain = F.array(label, F.replace(label, F.lit("_"), F.lit(" ")), F.when(level == "coarse", _plural(label)))
    full = F.array(F.concat(level, F.lit(": "), label), F.concat(level, F.lit(" "), label))
    ways = F.transform(F.array_distinct(F.array_compact(plain)), lambda p: F.struct(p.alias("phrase"), F.lit(True).alias("bare")))
    every = F.concat(ways, F.transform(full, lambda p: F.struct(p.alias("phrase"), F.lit(False).alias("bare"))))
    return labels.select("level", label.alias("target"), F.explode(every).alias("w")).select("level", "target", "w.phrase", "w.bare")


def qualifiers(texts: DataFrame) -> DataFrame:
    """(question_id, level, start, end): where texts qualify a label, up to the label."""
    between, found = F.split("text", rules.QUALIFIER), F.regexp_extract_all("text", F.lit(rules.QUALIFIER), F.lit(0))
    parts = texts.select("question_id", between.alias("between"), found.alias("found")).select("question_id", "between", "found", F.posexplode("found").alias("k", "words"))
    before = "aggregate(slice(between, 1, k + 1), 0, (s, x) -> s + length(x)) + aggregate(slice(found, 1, k), 0, (s, x) -> s + length(x))"
    return parts.withColumn("start", F.expr(before)).select("question_id", F.lower(F.regexp_extract("words", "^[A-Za-z]+", 0)).alias("level"), "start", (F.col("start") + F.length("words")).alias("end"))


def target_places(texts: DataFrame, concepts: DataFrame) -> DataFrame:
    """(question_id, level, target, phrase, start, end): the targets that texts(question_id, text) name, 32 places a text at most."""
    ways = saved(label_phrases(concepts), "label-phrases")
    found = saved(phrase_spans(texts.select("question_id", "text"), ways.select("phrase")).join(ways, "phrase"), "label-places")
    asked = saved(qualifiers(texts), "qualifiers")
    # with qualifiers: a label right after each of them, both together standing alone, the longest
    after = found.where("bare").select("question_id", "level", "target", F.col("start").alias("label_start"), F.col("end").alias("label_end")).join(asked.withColumnRenamed("end", "label_start"), ["question_id", "level", "label_start"])
    whole = after.join(texts.select("question_id", "text"), "question_id").withColumn("phrase", F.expr("substring(text, start + 1, label_end - start)")).select("question_id", "level", "target", "start", F.col("label_end").alias("end"), "phrase").distinct()
    whole = saved(whole, "qualified")
    apart = phrase_spans(texts.select("question_id", "text"), whole.select("phrase").distinct()).select("question_id", "phrase", "start", "end")
    stood = whole.join(apart, ["question_id", "phrase", "start", "end"]).withColumn("longest", F.max("end").over(W.partitionBy("question_id", "start"))).where(F.col("end") == F.col("longest")).drop("longest")
    met = asked.select("question_id", "start").distinct().join(stood.select("question_id", "start").distinct().withColumn("met", F.lit(True)), ["question_id", "start"], "left")
    # targets are few: the least and the greatest differ if there are several
    one = stood.groupBy("question_id").agg((F.min(F.struct("level", "target")) == F.max(F.struct("level", "target"))).alias("one")).where("one").select("question_id")
    good = met.groupBy("question_id").agg(F.bool_and(F.col("met").isNotNull()).alias("all")).where("all").select("question_id").join(one, "question_id")
    qualified = stood.join(good, "question_id", "left_semi")
    # without: labels anywhere, but for words that are labels of several targets
    plain = found.join(asked.select("question_id").distinct(), "question_id", "left_anti").select("question_id", "level", "target", "phrase", "start", "end").distinct()
    shared = plain.groupBy("question_id", "start", "end").agg((F.min(F.struct("level", "target")) != F.max(F.struct("level", "target"))).alias("shared")).where("shared").drop("shared")
    free = plain.join(shared, ["question_id", "start", "end"], "left_anti")
    columns = ["question_id", "level", "target", "phrase", "start", "end"]
    every = qualified.select(*columns).unionByName(free.select(*columns))
    order = W.partitionBy("question_id").orderBy("level", "target", "phrase", "start")
    return every.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= MAX_PLACES).drop("_n")


def question_grounding(questions: DataFrame, concepts: DataFrame, members: DataFrame) -> DataFrame:
    """(question_id, reason, terms, targets) for questions(question_id, text), concepts(cid, name, coarse, fine), members(member, cid).

    reason is null where a question is grounded; only then terms(term, start, end, cid) and targets(level, target, phrase, start, end) are given."""
    sound = questions.select("question_id", "text").where(r"text rlike '\\S' and octet_length(text) <= " + str(MAX_BYTES))
    # questions may come from one small file, which would be one task's work in each search below
    sound = saved(sound.repartition(sound.sparkSession.sparkContext.defaultParallelism, "question_id"), "questions")
    borne = members.select("cid").distinct().withColumn("borne", F.lit(True))
    names = concepts.where("name <> ''").join(borne, "cid", "left").groupBy("name").agg(F.min("cid").alias("cid"), (F.min("cid") != F.max("cid")).alias("several"), F.bool_or(F.col("borne").isNotNull()).alias("borne"))
    spans = phrase_spans(sound, names.select(F.col("name").alias("phrase"))).withColumnRenamed("phrase", "name")
    places = saved(spans.join(names, "name"), "term-places")
    fault = F.when(F.col("several"), "ambiguous_name").when(~F.col("borne"), "missing_original_member")
    by_term = places.groupBy("question_id").agg(F.min(F.when(fault.isNotNull(), F.struct("name", fault.alias("fault"))))["fault"].alias("fault"), F.count("*").alias("places"))
    fit = by_term.where(F.col("fault").isNull() & (F.col("places") <= MAX_PLACES)).select("question_id")
    terms = places.join(fit, "question_id").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(F.col("name").alias("term"), "start", "end", "cid"))).alias("terms"))
    found = saved(target_places(sound, concepts), "target-places")
    kind = F.struct("level", "target")
    targets = found.groupBy("question_id").agg((F.min(kind) != F.max(kind)).alias("many"), F.array_sort(F.collect_list(F.struct("level", "target", "phrase", "start", "end"))).alias("targets"))
    met = questions.select("question_id").distinct().join(sound.select("question_id", F.lit(True).alias("sound")).distinct(), "question_id", "left").join(by_term, "question_id", "left").join(terms, "question_id", "left").join(targets, "question_id", "left")
    reason = (
        F.when(F.col("sound").isNull(), "invalid_question")
        .when(F.col("fault").isNotNull(), F.col("fault"))
        .when(F.col("places").isNull(), "no_grounded_vocabulary")
        .when(F.col("places") > MAX_PLACES, "catalog_too_large")
        .when(F.col("targets").isNull(), "no_explicit_target")
        .when(F.col("many"), "ambiguous_target")
    )
    judged = met.withColumn("reason", reason)
    return judged.select("question_id", "reason", *[F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in ("terms", "targets")])
