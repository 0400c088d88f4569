import pytest
from pyspark.sql import functions as F

from claimweave.functions import judgement as J
from claimweave.operators import graph as G
from claimweave.plans import adapters as A
from claimweave.plans.reads import read
from claimweave.sources.files import raw_pages

ODD = ["7' OR '1'='1", "%", "_", '"7"', "7\\", ":ticker", "{claims}", ""]


@pytest.fixture(scope="module")
def graph(spark, sf):
    return A.graph(spark, sf)


def own(df, ticker, columns):
    return [tuple(r) for r in df.filter(F.col("ticker") == ticker).select(columns).collect()]


def test_reads_give_the_rows_of_the_operators(graph):
    topics = read(graph, "topics", ticker="7")
    assert [tuple(r) for r in topics.collect()] == own(G.topic_counts(graph), "7", topics.columns) != []
    topic = topics.first().topic
    timeline = read(graph, "timeline", ticker="7", topic=topic)
    assert [tuple(r) for r in timeline.collect()] == own(G.claim_timeline(graph).filter(F.col("topic") == topic), "7", timeline.columns) != []
    speakers = read(graph, "speakers", ticker="7")
    assert [tuple(r) for r in speakers.collect()] == own(G.speaker_counts(graph), "7", speakers.columns) != []
    levels = J.severities_at_least("medium")
    ticker = G.contradiction_rows(graph, levels).first().ticker
    found = read(graph, "contradictions", ticker=ticker, severities=F.array(*map(F.lit, levels)))
    assert [tuple(r) for r in found.collect()] == own(G.contradictions(graph, levels), ticker, found.columns) != []
    terms = ["ring", "blue"]
    hits = read(graph, "keyword", ticker="7", terms=F.array(*map(F.lit, terms)), limit=8)
    assert sorted(tuple(r) for r in hits.collect()) == sorted(own(G.keyword_search(graph, terms, 8), "7", hits.columns)) != []
    claim = timeline.first().claim_id
    assert read(graph, "owns", ticker="7", claim_id=claim).first().owns and not read(graph, "owns", ticker="8", claim_id=claim).first().owns


@pytest.mark.parametrize("ticker", ODD)
def test_values_are_no_part_of_the_text(graph, ticker):
    assert read(graph, "topics", ticker=ticker).isEmpty()


def test_raw_pages_are_read_whole(spark, tmp_path):
    texts = {"a.html": "<p>é\n\n𝄞</p>", "b.html": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    assert {r.path.rsplit("/", 1)[1]: r.html for r in raw_pages(spark, str(tmp_path)).collect()} == {"a.html": texts["a.html"]}
