"""Which edges a round bears out: planted records of every kind."""

from markloom.operators import feedback


def test_reasons_and_union(spark):
    support = [("s", 1, "ab", "cd", r) for r in (1, 2, 3, 4, 5, 6)] + [("s", 1, "ab", "ef", 9), ("s", 2, "ab", "cd", 1), ("t", 1, "ab", "cd", 1), ("s", 2, "gh", "日本", 7)]
    frozen = [
        ("s", 1, 1, ["ab", "cd"], "Here AB meets cd."),
        ("s", 1, 2, ["ab"], "ab cd"),
        ("s", 1, 3, ["ab", "cd"], "ab cd\nReferences:\n[1] x"),
        ("s", 1, 4, ["ab", "cd"], "abc cd"),
        ("s", 1, 5, ["ab", "cd"], "ab cd. All rights reserved."),
        ("s", 1, 6, ["ab", "cd"], None),
        ("s", 2, 1, ["ab", "cd"], "cd, ab: see the references in the text"),
        ("s", 2, 7, ["gh", "日本"], "ghx日本語"),
        ("s", 3, 9, ["ab", "ef"], "ab ef"),
    ]
    judged = feedback.judged_support(spark.createDataFrame(support, "scope string, round int, a string, b string, record_id int"), spark.createDataFrame(frozen, "scope string, round int, record_id int, marks array<string>, text string"))
    got = {(r.scope, r["round"], r.record_id): r.reason for r in judged.collect()}
    assert got == {("s", 1, 1): None, ("s", 1, 2): "marks_conflict", ("s", 1, 3): "bibliography_or_metadata", ("s", 1, 4): "endpoint_absent", ("s", 1, 5): "bibliography_or_metadata", ("s", 1, 6): "endpoint_absent",
                   ("s", 1, 9): "not_frozen_in_round", ("s", 2, 1): None, ("t", 1, 1): "not_frozen_in_round", ("s", 2, 7): "endpoint_absent"}
    edges = feedback.qualified_edges(judged)
    told = {tuple(r)[:4]: tuple(r)[4:] for r in edges.collect()}
    assert told["s", 1, "ab", "cd"] == (6, 1, 0, True, "bibliography_or_metadata,endpoint_absent,marks_conflict")
    assert told["s", 1, "ab", "ef"] == (1, 0, 1, False, "no_qualified_support,not_frozen_in_round")
    assert [tuple(r) for r in feedback.union_graph(edges).collect()] == [("s", "ab", "cd", 2, 1, 2)]
    assert feedback.qualified_edges(judged.limit(0)).count() == 0


def test_marks_are_looked_for_once_a_record(spark):
    """Every pair of a record brought its text along, and both its marks were looked for in it again."""
    from pyspark.sql import functions as F

    from markloom.functions import text as T

    marks = ["ab", "a.b", "x-y", "K2", "日本", "straße", None, "ſo"]
    texts = ["AB a.b axb", "x-y x-yz K2", "日本語 STRASSE", "ſo so", "", None]
    rows = spark.createDataFrame([(i, marks, t) for i, t in enumerate(texts)], "id int, marks array<string>, text string").withColumn("text", F.coalesce("text", F.lit("")))
    want = {(r.id, r.mark.lower()) for r in rows.select("id", F.explode("marks").alias("mark"), "text").where(T.hit(F.col("mark"), F.col("text"))).collect()}
    got = {(r.id, m) for r in rows.select("id", T.standing(F.col("marks"), F.col("text")).alias("there")).collect() for m in r.there}
    assert got == want and len(want) == 7
    sets = spark.createDataFrame([("s", 1, 1, ["cd", "ab", "ef"]), ("s", 1, 2, ["ab", "cd"])], "scope string, round int, record_id int, m array<string>")
    frozen = spark.createDataFrame([("s", 1, 1, ["cd", "ab", "ef"], "ab, cd")], "scope string, round int, record_id int, marks array<string>, text string")
    judged = feedback.judged_records(sets, frozen)
    assert {(r.a, r.b, r.record_id, r.reason) for r in judged.collect()} == {("ab", "cd", 1, None), ("ab", "ef", 1, "endpoint_absent"), ("cd", "ef", 1, "endpoint_absent"), ("ab", "cd", 2, "not_frozen_in_round")}
