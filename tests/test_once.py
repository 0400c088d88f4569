"""Texts that are read once however many of their parts are used."""

from pyspark.sql import functions as F

from claimweave.functions import judgement as J
from claimweave.functions import vectors as V
from claimweave.plans import catalogue


def test_answers_are_parsed_once(spark, sf):
    plan = catalogue.judgement_normalised(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("from_json(") + plan.lower().count("jsontostructs") <= 1
    assert plan.lower().count("parse_json") <= 2 or plan.count("parseJson") <= 2


def test_embedding_by_slots_equals_the_plain_count(spark):
    texts = [("a b a, c", "a b"), ("", "x"), ("Ring ring RING 7", "ring"), (None, "x"), ("same same", "same")]
    df = spark.createDataFrame(texts, "a string, b string")
    plain = lambda c: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.size(F.filter(V.word_slots(F.col(c)), lambda s: s == i)).cast("float"))
    rows = df.select(plain("a").alias("p"), V.hash_embedding(F.col("a")).alias("h"), V.cosine(plain("a"), plain("b")).alias("c"), V.slot_cosine(V.word_slots(F.col("a")), V.word_slots(F.col("b"))).alias("s")).collect()
    assert all(r.p == r.h and r.c == r.s for r in rows) and rows[0].s is not None


def test_embedding_has_no_lambda_within_a_lambda_for_words(spark, sf):
    plan = catalogue.embedded_claims(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_remove" in plan and "zip_with" not in plan


def test_kinds_of_answers(spark):
    answers = [("```json\n{\"contradicts\": true, \"severity\": \"HIGH\"}\n```", True, "high"), ("Sure: {\"contradiction\": \"yes\"} done", True, "medium"), ("{\"contradicts\": \"false\"}", False, "none"), ("{oops", False, "none"), (None, False, "none"), ("no { and } here", False, "none")]
    df = spark.createDataFrame([(a,) for a, *_ in answers], "a string")
    assert [(r.v.contradicts, r.v.severity) for r in df.select(J.judgement(F.col("a")).alias("v")).collect()] == [(y, s) for _, y, s in answers]
