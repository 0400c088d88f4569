"""Readers as table functions of SQL."""

import pytest

from claimweave.sources import files, table_functions
from claimweave.sources.html import page_blocks

PAGES = [("a", "<body><p>One é</p><div><table><tr><td>1</td><td>2</td></tr></table></div></body>"), ("b", None), ("c", ""), (None, "<p>No name"), ("d", "plain words"), ("a", "<p>again</p>")]


@pytest.fixture(scope="module")
def sql(spark):
    table_functions.register(spark)
    return spark.sql


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_blocks_of_pages_from_sql(spark, sql):
    pages = spark.createDataFrame(PAGES, "document_id string, html string")
    assert rows_of(sql("SELECT * FROM page_blocks(TABLE({pages}))", pages=pages)) == rows_of(page_blocks(pages)) != []
    turned = pages.selectExpr("html", "1 AS pos", "document_id")
    assert rows_of(sql("SELECT * FROM page_blocks(TABLE({t}))", t=turned)) == rows_of(page_blocks(pages))
    assert sql("SELECT * FROM page_blocks(TABLE({t}))", t=pages.limit(0)).isEmpty()


def test_blocks_of_the_test_pages_join_as_any_relation(spark, sql, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").selectExpr("CAST(page_id AS STRING) AS document_id", "html")
    found = sql("SELECT p.document_id, count(*) AS n FROM page_blocks(TABLE({pages})) b JOIN {pages} p ON p.document_id = b.document_id GROUP BY ALL", pages=pages)
    assert rows_of(found) == rows_of(page_blocks(pages).groupBy("document_id").count())


def test_turns_of_transcripts_from_sql(spark, sql, tmp_path):
    body = "document_id: t1\ndate: 2024-01-02\ncompany: {ticker: ABC, name: A}\nturns:\n- {speaker: X, role: CEO, text: Hello}\n- {speaker: Y, text: 'é'}\n"
    (tmp_path / "t.yaml").write_text(body, encoding="utf-8")
    raw = spark.read.text(str(tmp_path / "t.yaml"), wholetext=True)
    assert rows_of(sql("SELECT * FROM transcript_turns(TABLE({raw}))", raw=raw)) == rows_of(files.transcripts(spark, str(tmp_path / "t.yaml"))) != []
    odd = spark.createDataFrame([(None,), ("",), ("a: [",), ("just words",), ("turns: 5",)], "value string")
    assert sql("SELECT * FROM transcript_turns(TABLE({odd}))", odd=odd.filter("value IS NULL OR value <> 'turns: 5'")).isEmpty()
