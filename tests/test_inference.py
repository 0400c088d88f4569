import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from claimweave.operators import chunks as C
from claimweave.operators import detect as D
from claimweave.operators.inference import Client, Retry, infer, is_transient

QUICK = Retry(first=0.0)


def test_only_transient_errors_are_tried_again():
    waited, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError("reset by peer")
        return "ok"

    assert Retry(first=2.0, longest=3.0, wait=waited.append)(flaky) == "ok"
    assert len(waited) == 2 and 2 <= waited[0] <= 2.5 and 3 <= waited[1] <= 3.75
    calls.clear()

    def broken():
        calls.append(1)
        raise ValueError("malformed schema")

    with pytest.raises(ValueError):
        Retry(tries=5, first=0.0)(broken)
    assert len(calls) == 1
    calls.clear()

    def down():
        calls.append(1)
        raise Exception("HTTP 503 Service Unavailable")

    with pytest.raises(Exception, match="503"):
        Retry(tries=4, first=0.0)(down)
    assert len(calls) == 4
    assert is_transient(Exception("429 Too Many Requests")) and is_transient(TimeoutError("timed out"))
    assert not is_transient(ValueError("bad value")) and not is_transient(KeyError("missing"))


def test_one_failing_call_of_a_thousand_loses_that_chunk_only(spark):
    rows = spark.createDataFrame([(f"c{i}", "d", f"text {i}", "clash") for i in range(1000)], "chunk_id string, document_id string, text string, answer_is string").repartition(3)

    def call(text, attempt):
        if text == "text 617":
            raise RuntimeError("no answer")
        return [{"topic": "t", "quote_span": text, "claim_text": "c"}]

    answers = C.extracted(rows, call, ["t"], retry=QUICK).collect()
    assert [(r.chunk_id, r.answer, r.error) for r in answers if r.error] == [("c617", None, "RuntimeError: no answer")]
    claims = C.claims_in(C.extracted(rows, call, ["t"], retry=QUICK)).collect()
    assert {r.chunk_id for r in claims} == {f"c{i}" for i in range(1000) if i != 617} and {r.attempts for r in claims} == {1}


def test_one_client_a_partition_and_bounded_calls(spark):
    def make():
        lock, state, made = threading.Lock(), {"now": 0, "most": 0}, f"{os.getpid()}-{time.monotonic_ns()}"

        def call(row):
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
            time.sleep(0.002)
            with lock:
                state["now"] -= 1
            return {"client": made, "most": state["most"], "n": row["n"]}

        return call

    rows = spark.range(200).select(F.col("id").alias("n")).repartition(2)
    got = infer(rows, Client(make), "struct<client:string,most:int,n:long>", at_once=3).collect()
    assert len({r.answer.client for r in got}) == 2 and max(r.answer.most for r in got) <= 3
    assert all(r.n == r.answer.n and r.error is None for r in got) and len(got) == 200


def test_flaky_services_are_asked_again_inside_tasks(spark):
    def make():
        failed = set()

        def call(row):
            if row["n"] not in failed:
                failed.add(row["n"])
                raise ConnectionError("connection reset by peer")
            return str(row["n"])

        return call

    got = infer(spark.range(20).select(F.col("id").alias("n")), Client(make), "string", retry=QUICK).collect()
    assert {(r.n, r.answer, r.error) for r in got} == {(i, str(i), None) for i in range(20)}
    assert infer(spark.range(0).select(F.col("id").alias("n")), Client(make), "string").collect() == []


def test_a_failed_verdict_confirms_nothing(spark):
    def call(pair):
        if pair["b_id"] == "y":
            raise RuntimeError("no verdict")
        return '{"contradicts": true, "severity": "high", "reasoning": "r"}'

    pairs = spark.createDataFrame([("a", "x"), ("a", "y")], "a_id string, b_id string")
    assert {(r.b_id, r.contradicts) for r in D.judge_pairs(pairs, call, retry=QUICK).collect()} == {("x", True), ("y", False)}
