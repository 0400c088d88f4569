import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.operators import search as S
from claimweave.operators import vector_index as V

POINT, QUERY = "claim_id long, vector array<float>", "query_id long, q_vector array<float>"


def brute(points, queries, k):
    out = set()
    for q, v in queries:
        scored = []
        for i, p in points:
            if p is not None and len(p) == len(v) and np.any(p):
                a, b = np.asarray(p, dtype=np.float32).astype(float), np.asarray(v, dtype=np.float32).astype(float)
                scored.append((-(a @ b) / np.sqrt(a @ a) / np.sqrt(b @ b), i))
        out |= {(q, r + 1, i) for r, (_, i) in enumerate(sorted((round(s, 9), i) for s, i in scored)[:k])}
    return out


@pytest.mark.parametrize("spread", [0.2, 3.0])
def test_equal_to_all_pairs_without_a_cross_join(spark, tmp_path, spread):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(20, 16))
    points = [(i, (middles[i % 20] + spread * rng.normal(size=16) / 4).tolist()) for i in range(2000)] + [(9000 + i, middles[0].tolist()) for i in range(300)]
    points += [(9990, None), (9991, [0.0] * 16), (9992, [1.0, 2.0])]
    queries = [p for p in points if p[0] % 20 == 0 and p[0] < 9990] + [(5, middles[0].tolist())]
    df, asked = spark.createDataFrame(points, POINT), spark.createDataFrame(queries, QUERY)
    index = V.VectorIndex.build(df, path=f"file://{tmp_path}/index")
    again = V.VectorIndex.load(spark, f"file://{tmp_path}/index")
    got = again.search(asked, 10)
    plan = got._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert {(r.query_id, r["rank"], r.claim_id) for r in got.collect()} == brute(points, queries, 10)
    if spread < 1:
        assert index.visited(asked) < 0.3 * len(points) * len(queries)


def test_large_blocks_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(V, "PART_ROWS", 50)
    points = [(i, [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(600)]
    queries = [(0, [1.0, 0.1]), (1, [0.1, 1.0]), (2, [0.0, 0.0])]
    index = V.VectorIndex.build(spark.createDataFrame(points, POINT), blocks=2)
    assert index.parts.max() >= 4
    got = S.vector_topk(None, spark.createDataFrame(queries, QUERY), 5, index=index)
    assert {(r.query_id, r["rank"], r.claim_id) for r in got.collect()} == brute(points, queries[:2], 5)


def test_few_and_no_points(spark):
    asked = spark.createDataFrame([(1, [1.0, 0.0])], QUERY)
    one = spark.createDataFrame([(7, [0.0, 2.0])], POINT).withColumn("name", F.lit("x"))
    assert [(r.claim_id, r.name, r.score) for r in S.vector_topk(one, asked).collect()] == [(7, "x", 0.0)]
    assert S.vector_topk(spark.createDataFrame([], POINT), asked).count() == 0
    assert S.vector_topk(spark.createDataFrame([(1, None)], POINT), asked).count() == 0
