"""Long texts in parts of bounded size."""

import pytest
from pyspark.sql import functions as F

from claimweave.functions import render as R
from claimweave.operators import stateful

LINES = "g string, at int, line string"


def joined(parts, by, separator):
    found = {}
    for r in sorted(parts.collect(), key=lambda r: (r[by] is not None, r[by], r.start, r.part)):
        found.setdefault(r[by], []).append(r.text)
    return {g: separator.join(texts) for g, texts in found.items()}


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_parts_put_together_are_the_whole_texts(spark, most):
    rows = [("a", i % 50, f"é{i % 7} line {i}") for i in range(400)] + [("b", 1, ""), ("b", 0, "x" * 100), (None, 3, "of no group"), ("c", 1, None), ("d", 1, "𝄞"), ("d", 1, "𝄞")]
    df = spark.createDataFrame(rows, LINES)
    whole = {r.g: r.text for r in R.as_text(df.filter("line IS NOT NULL"), F.col("line"), ["g"], [F.col("at")]).collect()}
    parts = R.as_text_parts(df, F.col("line"), ["g"], [F.col("at")], most=most)
    assert joined(parts, "g", "\n") == whole
    assert {r.g: r.text for r in R.whole_texts(parts, ["g"]).collect()} == whole
    assert all(len(r.text.encode()) <= most or "\n" not in r.text for r in parts.collect())


def test_a_hot_group_is_spread_over_tasks(spark):
    df = spark.range(60000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 1000).cast("string"))).alias("g"), F.col("id").cast("int").alias("at"), F.repeat(F.lit("y"), 100).alias("line"))
    parts = R.as_text_parts(df, F.col("line"), ["g"], [F.col("at")], most=10000)
    hot = parts.filter("g = 'hot'").withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would make one of so small partitions
    try:
        assert hot.select("task").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = hot.agg(F.max(F.octet_length("text")), F.sum(F.length("text") + 1)).first()
    assert sizes[0] <= 10000 and sizes[1] == 20000 * 101


def test_no_lines_give_no_parts(spark):
    parts = R.as_text_parts(spark.createDataFrame([], LINES), F.col("line"), ["g"], [F.col("at")])
    assert parts.columns == ["g", "start", "part", "text"] and parts.isEmpty()


def test_answers_in_parts(spark):
    log = [(1, i, "token", f"t{i} ") for i in range(300)] + [(1, 300, "retry", None)] + [(1, 301 + i, "token", f"u{i} ") for i in range(300)] + [(2, 0, "error", "e"), (3, 5, "token", None), (3, 6, "token", "z")]
    events = spark.createDataFrame(log, "turn_id long, seq long, event string, data string")
    whole = {r.turn_id: r.answer for r in stateful.replay_answers(events).collect() if r.answer}
    parts = stateful.answer_parts(events, 50)
    assert joined(parts, "turn_id", "") == whole
    assert max(len(r.text) for r in parts.collect()) <= 50
