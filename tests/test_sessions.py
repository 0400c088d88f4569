import json

from claimweave.streaming import sessions as S

SCHEMA = "session string, seq long, ticker string, role string, text string, at timestamp"


def test_sessions_outlive_their_query_change_company_and_expire(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    checkpoint = str(tmp_path / "cp")

    def put(name, *rows):
        lines = [json.dumps(dict(zip(["session", "seq", "ticker", "role", "text", "at"], r))) for r in rows]
        (tmp_path / "in" / name).write_text("\n".join(lines))

    def run():
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        query = S.session_stream(stream, idle=600).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        rows = spark.read.schema(S.OUTPUT).parquet(str(tmp_path / "out")).collect()
        return {(r.session, r.conversation, r.ticker, r.seq, r.turns, r.event) for r in rows}

    def held():
        return {(r.session, r.seq, r.text) for r in S.held_turns(spark, checkpoint).collect()}

    put("1.json", ("s", 0, "X", "user", "q0", "2024-01-01T10:00:00"), ("s", 1, "X", "assistant", "a0", "2024-01-01T10:00:05"), ("t", 0, "X", "user", "other", "2024-01-01T10:00:00"))
    first = {("s", 0, "X", 0, 1, "opened"), ("s", 0, "X", 1, 2, "turn"), ("t", 0, "X", 0, 1, "opened")}
    assert run() == first and held() == {("s", 0, "q0"), ("s", 1, "a0"), ("t", 0, "other")}
    put("2.json", ("s", 2, "X", "user", "q1", "2024-01-01T10:05:00"))  # a new query on the old state
    second = first | {("s", 0, "X", 2, 3, "turn")}
    assert run() == second and held() == {("s", 0, "q0"), ("s", 1, "a0"), ("s", 2, "q1"), ("t", 0, "other")}
    put("3.json", ("s", 3, "Y", "user", "about another", "2024-01-01T10:06:00"))
    third = second | {("s", 1, "Y", 3, 1, "opened")}
    assert run() == third and held() == {("s", 3, "about another"), ("t", 0, "other")}
    put("4.json", ("u", 0, "X", "user", "late", "2024-01-01T12:00:00"))  # moves the watermark
    got = run()
    assert got == third | {("u", 0, "X", 0, 1, "opened"), ("s", 1, "Y", None, 1, "expired"), ("t", 0, "X", None, 1, "expired")}
    assert held() == {("u", 0, "late")}
    put("5.json", ("s", 4, "Y", "user", "again", "2024-01-01T12:00:30"))
    assert run() == got | {("s", 2, "Y", 4, 1, "opened")}
