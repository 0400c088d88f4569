import json
import random

import pytest
from pyspark.sql import functions as F

from claimweave.functions import text as T
from claimweave.operators import chunks as C
from claimweave.operators import upsert as U
from claimweave.plans.store import TABLES, GraphStore, process_pages
from claimweave.schemas import KEYS

PAGE = "document_id string, html string, doc_type string, date string, period string, source_url string, source_type string, raw_ref string, ticker string, company_name string, cik long"
LONG = "We expect our gross margin to hold at the level of the last quarter, as we said before, in all regions."


def pages(spark):
    def page(i, text, ticker="X", kind="real"):
        return (i, f"<body><h1>Item 1. Business</h1><p>{text}</p><p>short margin</p></body>", "10-K", f"2024-01-0{i[-1]}", None, "u", kind, "r", ticker, f"Name {i}", 1)

    return spark.createDataFrame([page("d1", LONG), page("d2", LONG.replace("hold", "fall")), page("d3", "Nothing of interest stands here, although it is quite a long paragraph about the weather."), page("d4", "We said margin will double.", kind="synthetic")], PAGE)


def call(text, attempt):
    word = next((w for w in ("hold", "fall", "double") if w in text), None)
    return [{"topic": "margin", "quote_span": text.split(",")[0], "claim_text": text, "stance": word, "speaker": "CFO", "role": "r", "value_numeric": 5}] if word else []


def judge(pair):
    return json.dumps({"contradicts": pair["a_stance"] != pair["b_stance"], "severity": "high", "reasoning": "they differ"})


def test_processing_is_idempotent_and_keeps_keys(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/g")
    topics = spark.createDataFrame([("margin", "Gross margin", None, ["margin"])], "id string, name string, description string, aliases array<string>")
    first = process_pages(store, pages(spark), topics, call, judge, now="2024-02-01")
    assert first == {"documents": 3, "claims": 3, "failed": 0, "indexed": 3, "contradictions": 2}  # synthetic against real only
    snapshot = {n: sorted(map(str, store.table(n).collect())) for n in TABLES}
    assert process_pages(store, pages(spark), topics, call, judge, now="2024-02-01") == first | {"indexed": 0}
    assert snapshot == {n: sorted(map(str, store.table(n).collect())) for n in TABLES}
    for name, key in KEYS.items():
        assert U.duplicate_keys(store.table(name), key).isEmpty(), name
    company = store.table("companies").collect()
    assert [(c.ticker, c.name) for c in company] == [("X", "Name d1")]  # the first document's spelling stays
    bad = store.table("claims").join(store.table("chunks"), "chunk_id").where("instr(text, quote_span) = 0")
    assert bad.isEmpty() and store.table("contradictions").where("a_id >= b_id").isEmpty()
    store.reset()
    assert all(store.table(n).isEmpty() for n in TABLES)


def test_quotes_are_repaired_and_aliases_read(spark):
    text = "Our  gross\nmargin held at 5 percent, up."
    answers = [
        [{"topicId": "margin", "source_quote": " gross margin held ", "claim": "c", "value_numeric": 5}, {"topic": "margin", "span": "never said"}, {"topic": "other", "quote": "up"}, {"topic": "margin", "quote": ""}],
        [{"topic": "margin", "quote_span": "ross margin hel", "text": "t", "stance": "s", "value_numeric": "5"}, {"topic": "margin", "quote": "still not"}],
        [{"topic_id": "margin", "quote": "up.", "value_numeric": True}],
    ]
    rows = spark.createDataFrame([("k", "d", text)], "chunk_id string, document_id string, text string")
    got = {r.quote_span: r for r in C.claims_in(C.extracted(rows, lambda _, n: answers[n], ["margin"])).collect()}
    assert set(got) == {"gross\nmargin held", "ross\nmargin hel", "up."} and all(q in text for q in got)
    assert {r.attempts for r in got.values()} == {3} and [got[q].claim_text for q in sorted(got)] == ["c", "t", ""]
    assert got["gross\nmargin held"].value_numeric == 5 and got["up."].value_numeric == 1 and got["ross\nmargin hel"].value_numeric is None
    once = C.claims_in(C.extracted(rows, lambda _, n: answers[2] if not n else 1 / 0, ["margin"])).collect()
    assert [r.attempts for r in once] == [1]


def test_python_and_column_forms_of_the_repair_agree(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        words = [rng.choice(["a", "ab", "b.", "(c", "\\d", "é"]) for _ in range(12)]
        text = "".join(w + rng.choice([" ", "  ", "\n", "\t "]) for w in words)
        lo = rng.randrange(10)
        quote = rng.choice([" ", "\n"]).join(words[lo : lo + rng.randrange(1, 4)])[rng.randrange(2) :]
        rows.append((text, quote + rng.choice(["", "", "x"])))
    got = spark.createDataFrame(rows, "t string, q string").select("t", "q", T.verbatim_span(F.col("t"), F.col("q")).alias("v")).collect()
    assert [C.verbatim_piece(r.t, r.q) for r in got] == [r.v for r in got]


def test_only_new_or_changed_claims_are_embedded(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/g")
    topics = spark.createDataFrame([("margin", "Gross margin", None, ["margin"])], "id string, name string, description string, aliases array<string>")
    process_pages(store, pages(spark), topics, call, judge, now="2024-02-01")
    assert {r.value_numeric for r in store.table("claims").collect()} == {5.0}
    before = sorted(map(str, store.table("claim_vectors").collect()))
    store.index_claims(lambda text: F.array(F.raise_error(F.concat(F.lit("embedded again: "), text)).cast("float")))
    assert before == sorted(map(str, store.table("claim_vectors").collect()))


def two_companies(spark, text="hold", second="Y"):
    def page(i, said, ticker):
        return (i, f"<body><h1>Item 1. Business</h1><p>{LONG.replace('hold', said)}</p></body>", "10-K", "2024-01-01", None, "u", "real", "r", ticker, f"Name {ticker}", 1)

    return spark.createDataFrame([page("a1", text, "X"), page("a2", "fall", "X"), page("b1", "hold", second), page("b2", "fall", second)], PAGE)


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def stored(spark, path):
    topics = spark.createDataFrame([("margin", "Gross margin", None, ["margin"])], "id string, name string, description string, aliases array<string>")
    return GraphStore(spark, f"file://{path}/g", buckets=2), topics


def test_a_merge_writes_its_companys_files_only_and_reads_prune(spark, tmp_path):
    store, topics = stored(spark, tmp_path)
    assert process_pages(store, two_companies(spark), topics, call, judge)["contradictions"] == 2
    before, other = files(tmp_path / "g"), sorted(map(str, store.table("claims", ["Y"]).collect()))
    process_pages(store, two_companies(spark, "double").filter("ticker = 'X'"), topics, call, judge)
    changed = {n for n in files(tmp_path / "g").keys() ^ before.keys()} | {n for n, t in files(tmp_path / "g").items() if before.get(n) != t}
    assert changed and all("of_company=X" in n for n in changed)
    assert other == sorted(map(str, store.table("claims", ["Y"]).collect()))
    plan = store.table("claims", ["X"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [of_company" in plan.replace("isnotnull(of_company#", "of_company#") and len(store.table("claims", ["X"]).inputFiles()) < len(store.table("claims").inputFiles())


def test_joins_of_stored_tables_need_no_exchange(spark, tmp_path):
    store, topics = stored(spark, tmp_path)
    process_pages(store, two_companies(spark), topics, call, judge)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = store.table("claims").join(store.table("about"), "claim_id").join(store.table("made"), "claim_id")
        assert joined.count() == 4 and "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        counted = store.table("claims").groupBy("claim_id").count()
        assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_a_repeated_key_fails_before_anything_is_written(spark, tmp_path):
    store, topics = stored(spark, tmp_path)
    process_pages(store, two_companies(spark), topics, call, judge)
    before = files(tmp_path / "g")
    twice = store.stored("claims", ["X"])
    with pytest.raises(Exception, match="a key of claims occurs twice"):
        store.put("claims", twice.unionByName(twice), ["X"])
    assert files(tmp_path / "g") == before


def test_a_document_that_moves_and_companies_that_become_empty(spark, tmp_path):
    store, topics = stored(spark, tmp_path)
    process_pages(store, two_companies(spark, second="it's/a=b"), topics, call, judge)
    assert {r.ticker for r in store.table("documents").collect()} == {"X", "it's/a=b"}
    process_pages(store, two_companies(spark, second="Z"), topics, call, judge)
    assert sorted((r.document_id, r.ticker) for r in store.table("documents").collect()) == [("a1", "X"), ("a2", "X"), ("b1", "Z"), ("b2", "Z")]
    assert {r.company_ticker for r in store.table("claims").collect()} == {"X", "Z"} and store.table("contradictions").count() == 2
    again = GraphStore(spark, store.path, buckets=2)
    store.clear_contradictions()
    assert again.table("contradictions").isEmpty() and again.table("claims").count() == 4
    assert not {p.name for p in (tmp_path / "g" / "claims").iterdir()} & {"of_company=it's", "of_company=it%27s%2Fa%3Db"}
