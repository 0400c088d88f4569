import pytest
from pyspark.sql import functions as F

from claimweave.functions import judgement as J
from claimweave.functions import text as T


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "source, span, want",
    [
        ("Margins grew to 75%.", "Margins grew", "Margins grew"),
        ("Margins\n grew to", "  Margins grew to ", "Margins\n grew to"),
        ("a (b) [c] \\E d", "(b)  [c]   \\E d", "(b) [c] \\E d"),
        ("abc", "abd", None), ("abc", "  ", None), ("abc", None, None), (None, "a", None),
    ],
)
def test_verbatim_span(spark, source, span, want):
    df = spark.createDataFrame([(source, span)], "s string, q string")
    assert df.select(T.verbatim_span(F.col("s"), F.col("q")).alias("x")).first().x == want


def test_normalise(spark):
    assert one(spark, T.normalise(F.lit(" “A’s” –\n\t b  "))) == "\"A's\" - b"
    assert one(spark, T.collapse(F.lit(" “a”  b "))) == "“a” b"


def test_headings(spark):
    for text, tag, want in [("Item 1A. Risk", "p", True), ("PART II", "div", True), ("Items", "p", False), ("x", "h3", True), ("Partial", "p", False)]:
        assert one(spark, T.is_heading(F.lit(tag), F.lit(text))) is want


def test_citations_and_grounding(spark):
    a, b = "0123456789abcdef", "fedcba9876543210"
    assert one(spark, T.citations(F.lit(f"x [{b}] 【{a} *synthetic*】 [{b}] [{a}0] [abc]"))) == [b, a]
    for draft, found, want in [(f"[{a}]", [a], True), (f"[{a}]", [b], False), ("no mark", [], True), (" \n", [a], False), (f"[{a}]", None, False)]:
        df = spark.createDataFrame([(draft, found)], "d string, r array<string>")
        assert df.select(T.grounded(F.col("d"), F.col("r")).alias("x")).first().x is want


def test_keywords(spark):
    assert one(spark, T.keywords(F.lit("what did they say about China"))) == ["china"]


def test_topic_pattern(spark):
    p = T.topic_pattern(["gross margin", "C++ (x)", ""])
    for text, want in [("Gross MARGIN rose", True), ("grossmargin", False), ("marginé", False), ("gross marginé", False)]:
        assert one(spark, F.lit(text).rlike(p)) is want
    assert one(spark, F.lit("x").rlike(T.topic_pattern([]))) is False


@pytest.mark.parametrize(
    "answer, want",
    [
        ('{"contradicts": true, "severity": "HIGH ", "reasoning": "r"}', (True, "high", "r")),
        ('{"is_contradiction": true, "explanation": "e"}', (True, "medium", "e")),
        ('{"contradicts": false, "severity": "high"}', (False, "none", "")),
        ("```json\n{\"contradiction\": true, \"severity\": \"grave\"}\n```", (True, "medium", "")),
        ("so: {\"contradicts\": true, \"severity\": \"low\"}!", (True, "low", "")),
        ("nothing", (False, "none", "")),
    ],
)
def test_judgement(spark, answer, want):
    assert tuple(one(spark, J.judgement(F.lit(answer)))) == want


def test_severities():
    assert J.severities_at_least("medium") == ["medium", "high"]
    assert J.severities_at_least("bogus") == ["low", "medium", "high"]


def test_raw_claims(spark):
    answer = '[{"topic_name": "t", "source_quote": "q", "claim": "c", "value_numeric": 3}, {"topic": "", "topicId": "u", "value_numeric": "3"}]'
    rows = spark.range(1).select(F.explode(J.raw_claims(F.lit(answer))).alias("c")).select(J.claim_fields(F.col("c")).alias("f")).select("f.*").collect()
    assert [(r.topic, r.quote_span, r.claim_text, r.value_numeric) for r in rows] == [("t", "q", "c", 3.0), ("u", "", "", None)]
