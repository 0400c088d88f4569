import json

from claimweave.operators import upsert as U
from claimweave.plans.store import GraphStore, process_pages
from claimweave.streaming import ingest as I
from tests.test_store import PAGE, call, judge, two_companies

SCHEMA = "id string, seq int, v string"


def put(folder, name, **row):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps(row))


def test_sources_with_their_own_checkpoints_lose_nothing(spark, tmp_path):
    target = str(tmp_path / "out")

    def run(source, checkpoint=None):
        I.ingest(spark, str(tmp_path / source), SCHEMA, lambda df: df, target, str(tmp_path / (checkpoint or f"cp-{source}"))).awaitTermination()
        return {(r.id, r.v) for r in U.merged_deltas(spark, target, ["id"], "seq").collect()}

    put(tmp_path / "one", "a", id="a", seq=1, v="1")
    put(tmp_path / "two", "b", id="b", seq=1, v="1")
    assert run("one") == {("a", "1")} and run("two") == {("a", "1"), ("b", "1")}
    U.compact_deltas(spark, target, ["id"], "seq")
    put(tmp_path / "three", "c", id="c", seq=1, v="1")
    want = {("a", "1"), ("b", "1"), ("c", "1")}
    assert run("three") == want  # its batch 0 comes after a base that holds other sources' batch 0
    for _ in range(2):
        U.compact_deltas(spark, target, ["id"], "seq")
        assert {(r.id, r.v) for r in U.merged_deltas(spark, target, ["id"], "seq").collect()} == want
    put(tmp_path / "one", "a2", id="a", seq=2, v="2")
    want = {("a", "2"), ("b", "1"), ("c", "1")}
    assert run("one") == want
    assert run("one", "renewed") == want  # a lost checkpoint: everything comes again, as another source
    U.compact_deltas(spark, target, ["id"], "seq")
    assert run("one") == run("two") == want


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    U.write_delta(spark, spark.createDataFrame([("a", 1, "1"), ("b", 1, "x")], SCHEMA), path, "s", 0)
    U.write_delta(spark, spark.createDataFrame([("a", 2, "2"), ("a", 2, "3")], SCHEMA), path, "s", 1)
    rows = lambda: {(r.id, r.v) for r in U.merged_deltas(spark, path, ["id"], "seq").collect()}
    assert rows() == {("a", "3"), ("b", "x")}  # equal in key and order: the larger values
    for again in range(3):
        U.write_delta(spark, spark.createDataFrame([("a", 1, "1"), ("b", 1, "x")], SCHEMA), path, "s", 0)
        assert rows() == {("a", "3"), ("b", "x")}
        if again < 2:
            U.compact_deltas(spark, path, ["id"], "seq")
    assert U.merged_deltas(spark, str(tmp_path / "none"), ["id"], "seq") is None


def test_the_whole_chain_comes_out_of_streams(spark, tmp_path):
    topics = spark.createDataFrame([("margin", "Gross margin", None, ["margin"])], "id string, name string, description string, aliases array<string>")
    pages = two_companies(spark).collect()
    schema = PAGE + ", published timestamp"
    for n, page in enumerate(pages):
        put(tmp_path / f"in{n % 2}", f"{n}.json", **page.asDict(), published="2024-01-02T00:00:00")
    put(tmp_path / "in0", "repeat.json", **pages[0].asDict(), published="2024-01-03T00:00:00")  # the same text a day later
    streamed = GraphStore(spark, f"file://{tmp_path}/streamed", buckets=2)

    def run(n):
        stream = I.new_files(spark, str(tmp_path / f"in{n}"), schema)
        I.ingest_pages(stream, streamed, topics, call, str(tmp_path / f"cp{n}"), judge, event_time="published", now="n").awaitTermination()

    run(0)
    run(1)
    whole = GraphStore(spark, f"file://{tmp_path}/whole", buckets=2)
    process_pages(whole, two_companies(spark), topics, call, judge, now="n")
    for name in ("documents", "claims", "made", "appears_in", "about", "filed_by", "chunks", "contradictions", "claim_vectors", "companies"):
        got = sorted(map(str, streamed.table(name).collect()))
        assert got and got == sorted(map(str, whole.table(name).collect())), name
    before = {n: sorted(map(str, streamed.table(n).collect())) for n in ("claims", "made", "claim_vectors", "contradictions")}
    run(0)
    I.ingest_pages(I.new_files(spark, str(tmp_path / "in1"), schema), streamed, topics, call, str(tmp_path / "renewed"), judge, event_time="published", now="n").awaitTermination()
    assert before == {n: sorted(map(str, streamed.table(n).collect())) for n in before}


def test_repeats_within_the_watermark_are_dropped(spark, tmp_path):
    schema = "document_id string, html string, at timestamp"
    (tmp_path / "in").mkdir()
    stream = I.without_repeats(I.new_files(spark, str(tmp_path / "in"), schema, files=1), ["document_id", "html"], "at", "2 days")
    for n, (text, day) in enumerate([("x", "01"), ("x", "02"), ("y", "02")]):
        put(tmp_path / "in", f"{n}.json", document_id="d", html=text, at=f"2024-01-{day}T00:00:00")
    query = stream.writeStream.format("memory").queryName("repeats").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    assert sorted(r.html for r in spark.table("repeats").collect()) == ["x", "y"]
