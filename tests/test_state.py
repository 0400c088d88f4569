import json
import threading
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.operators import stateful as ST
from claimweave.operators import upsert as U
from claimweave.plans import adapters as A
from claimweave.plans import service
from claimweave.streaming import ingest as I
from claimweave.streaming import limiter, windows


def test_limit_counts_accepted_turns_only():
    allowed, kept = ST.accept(np.arange(0, 25.0), 20, 60)
    assert allowed == [True] * 20 + [False] * 5 and len(kept) == 20
    assert ST.accept([60.0], 20, 60, kept)[0] == [True]  # the first one is 60 seconds old by then


def test_streamed_limiter_matches_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(3)), i, float(i // 2)) for i in range(200)]
    schema = "session long, turn_id long, at double"
    for k in range(2):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(1.1)  # file times order the batches
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run = limiter.limit_stream(stream, 5, 20.0).writeStream.format("memory").queryName("limited").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination()
    got = {(r.session, r.turn_id): r.allowed for r in spark.table("limited").collect()}
    want = {(r.session, r.turn_id): r.allowed for r in ST.rate_limit(spark.createDataFrame(rows, schema), 5, 20.0).collect()}
    assert got == want and not all(want.values())


def test_windows_take_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events*.parquet")
    run = windows.tumbling(windows.event_time(stream, late="1 hour"), "1 day", "event_type").writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    batch = windows.tumbling(windows.event_time(events), "1 day", "event_type")
    assert sorted(map(str, spark.table("days").collect())) == sorted(map(str, batch.collect()))


def test_ingest_is_incremental_and_idempotent(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    schema = "id string, seq int, v string"

    def put(name, **row):
        (source / name).write_text(json.dumps(row))

    def run():
        I.ingest(spark, str(source), schema, lambda df: df, target, str(tmp_path / "cp")).awaitTermination()
        return {(r.id, r.v) for r in U.merged_deltas(spark, target, ["id"], "seq").collect()}

    put("a.json", id="a", seq=1, v="1")
    put("b.json", id="b", seq=1, v="1")
    assert run() == {("a", "1"), ("b", "1")}
    put("c.json", id="a", seq=2, v="2")
    assert run() == {("a", "2"), ("b", "1")} == run()
    size = lambda: {p.parent.name: p.stat().st_size for p in Path(target).rglob("*.parquet")}
    before = size()
    put("d.json", id="c", seq=1, v="1")
    assert run() == {("a", "2"), ("b", "1"), ("c", "1")}
    assert {k: v for k, v in size().items() if k in before} == before  # only the new batch was written
    again = spark.createDataFrame([("c", 1, "1")], schema)
    U.write_delta(spark, again, target, "again", 0)
    assert {(r.id, r.v) for r in U.merged_deltas(spark, target, ["id"], "seq").collect()} == {("a", "2"), ("b", "1"), ("c", "1")}
    for _ in range(2):
        U.compact_deltas(spark, target, ["id"], "seq")
        assert {(r.id, r.v) for r in U.merged_deltas(spark, target, ["id"], "seq").collect()} == {("a", "2"), ("b", "1"), ("c", "1")}
    U.write_delta(spark, spark.createDataFrame([("b", 5, "5")], schema), target, "again", 1)
    U.compact_deltas(spark, target, ["id"], "seq")
    assert {(r.id, r.v) for r in U.merged_deltas(spark, target, ["id"], "seq").collect()} == {("a", "2"), ("b", "5"), ("c", "1")}


def test_readers_never_miss_a_table_during_swaps(spark, tmp_path):
    path, failed, seen, done = f"file://{tmp_path}/t", [], set(), threading.Event()
    U.swap_table(spark, spark.range(10), path)

    def poll():
        while not done.is_set():
            try:
                seen.add(U.current_table(spark, path, "id long").count())
            except Exception as error:  # noqa: BLE001 - any failure of a reader is what this test looks for
                failed.append(str(error))

    reader = threading.Thread(target=poll)
    reader.start()
    for n in range(11, 16):
        U.swap_table(spark, U.current_table(spark, path).unionByName(spark.range(1)), path)
        assert U.current_table(spark, path).count() == n
    done.set()
    reader.join()
    assert not failed and seen <= set(range(10, 16))


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "k string, v int, seq int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    last = U.last_wins(old, new, ["k"], "seq")
    assert rows(last) == [("a", 1), ("b", 3), ("c", 4)] == rows(U.last_wins(last, new, ["k"], "seq"))
    assert rows(U.first_wins(old, new, ["k"], "seq")) == [("a", 1), ("b", 1), ("c", 4)]
    assert U.duplicate_keys(last, ["k"]).isEmpty()


def test_graph_keys_are_unique(spark, sf):
    from claimweave.schemas import KEYS

    g = A.graph(spark, sf)
    for name, key in KEYS.items():
        if hasattr(g, name):
            assert U.duplicate_keys(getattr(g, name), [{"id": "id"}.get(k, k) for k in key]).isEmpty(), name


def test_company_tools_and_chat(spark, sf):
    tools = service.CompanyTools(A.graph(spark, sf), "7")
    topics = tools.list_topics()
    assert topics and {t.ticker for t in topics} == {"7"}
    timeline = tools.get_claim_timeline(topics[0].topic)
    assert len(timeline) == topics[0].claims and tools.owns(timeline[0].claim_id) and not tools.owns("none")
    question = f"what about {timeline[0].claim_text.split()[0]}?"
    hits, degraded = tools.semantic_search(question)
    assert degraded and hits and all(h.claim_id in service.format_hits(hits) for h in hits)
    good = list(service.answer_turn(tools, question, lambda q: "ok", lambda q, h: f"see [{h[0].claim_id}]"))
    assert [e for e, _ in good] == ["retrieved", "answer"] and good[-1][1]["cited_ids"]
    bad = list(service.answer_turn(tools, question, lambda q: "ok", lambda q, h: "see [0000000000000000]"))
    assert [e for e, _ in bad] == ["retrieved", "retry", "answer"] and bad[-1][1]["cited_ids"] == []
    assert next(service.answer_turn(tools, " ", lambda q: "ok", lambda q, h: ""))[1]["category"] == "off_topic"
    assert next(service.answer_turn(tools, "buy?", lambda q: "INVESTMENT_ADVICE", lambda q, h: ""))[0] == "refused"


def test_pages_say_whether_more_follows(spark, sf):
    g = A.graph(spark, sf)
    whole = service.CompanyTools(g, "7", page=10_000).list_speakers()
    small = service.CompanyTools(g, "7", page=2)
    got, after = [], 0
    while True:
        page = small.list_speakers(after)
        got += page
        if not page.more:
            break
        after = page.next
    assert got == list(whole) and not whole.more and len(got) > 2


def test_a_turn_that_takes_too_long_loses_its_jobs(spark):
    assert service.within(spark, 60, lambda: spark.range(10).count()) == 10
    slow = spark.range(4).select(F.udf(lambda i: __import__("time").sleep(30) or i, "long")("id").alias("x"))
    began = time.monotonic()
    with pytest.raises(TimeoutError):
        service.within(spark, 2, slow.collect)
    assert time.monotonic() - began < 20
    with pytest.raises(ZeroDivisionError):
        service.within(spark, 60, lambda: 1 / 0)
    assert spark.range(3).count() == 3


def test_sessions():
    s = service.Sessions()
    first, session = s.get_or_create(None, "A")
    assert s.get_or_create(first, "A")[0] == first and s.get_or_create(first, "B")[0] != first
    assert [session.record_turn(float(i)) for i in range(21)] == [True] * 20 + [False]
