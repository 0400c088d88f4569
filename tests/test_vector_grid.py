import numpy as np
import pytest

from claimweave.operators import search as S
from claimweave.operators import vector_grid as V

POINT, QUERY = "claim_id string, ticker string, vector array<float>", "query_id long, ticker string, q_vector array<float>"


def brute(points, queries, k):
    """Scores added term by term in double precision; of equal ones the smaller key first."""
    out = set()
    for q, company, v in queries:
        scored = []
        for i, ticker, p in points:
            if ticker != company or p is None or len(p) != len(v) or not np.any(p) or None in p or not np.isfinite(p).all() or not np.any(v):
                continue
            a, b = (np.asarray(x, dtype=np.float32).astype(float).tolist() for x in (p, v))
            dot = lambda x, y: sum((s * t for s, t in zip(x, y)), 0.0)
            scored.append((-dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))), i))
        out |= {(q, n + 1, i) for n, (_, i) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("block, part", [(4096, 1 << 15), (7, 50)])
def test_equal_to_all_pairs_with_copies(spark, monkeypatch, block, part):
    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "PART", part)
    rng = np.random.default_rng(5)
    some = rng.normal(size=(40, 6))
    points = [(f"{i:05d}", f"T{i % 2}", some[i % 40].tolist()) for i in range(600)] + [(f"{9000 + i}", "T0", rng.normal(size=6).tolist()) for i in range(900)]
    points += [("a", "T0", None), ("b", "T0", [0.0] * 6), ("c", "T0", [1.0, 2.0]), ("d", "T0", [float("nan")] * 6), ("e", "T1", [None] * 6)]
    queries = [(i, f"T{i % 3}", some[i % 40].tolist()) for i in range(60)] + [(99, "T0", [2.0, 1.0]), (100, "T0", [0.0] * 6)]
    df, asked = spark.createDataFrame(points, POINT), spark.createDataFrame(queries, QUERY)
    got = S.vector_topk(df, asked, 10)
    assert "MapInArrow" in got._jdf.queryExecution().toString()  # no pair is a row of a join
    assert {(r.query_id, r["rank"], r.claim_id) for r in got.collect()} == brute(points, queries, 10)
    everywhere = [(i, "", v) for i, _, v in points]
    got = S.vector_topk(df, asked.drop("ticker"), 10)
    assert {(r.query_id, r["rank"], r.claim_id) for r in got.collect()} == brute(everywhere, [(q, "", v) for q, _, v in queries], 10)
