import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.llm import ann

SCHEMA = "vec_id long, embedding array<float>, leaf int, bound double"


def brute(rows, k=5):
    use = {i: np.array(v, dtype=np.float32).astype(float) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in use:
        if q % 50 == 0:
            score = {i: float((use[q] * v).sum() / (np.sqrt((v * v).sum()) * np.sqrt((use[q] * use[q]).sum()))) for i, v in use.items() if i != q}
            out[q] = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def test_small_table_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist(), 1, 0.5) for i in range(120)]
    rows[3] = (3, rows[50][1], 1, 0.5)
    rows[4] = (4, rows[50][1], 1, 0.5)
    rows += [(200, None, 1, 0.1), (250, [0.0] * 8, 1, 0.1), (300, [float("nan")] * 8, 1, 0.1), (350, [1.0, None] * 4, 1, 0.1), (400, [float("inf")] * 8, 1, 0.1), (None, rows[0][1], 1, 0.1), (7, rows[7][1], 1, 0.1)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q]))


def test_fewer_candidates_and_empty(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0], 1, 0.0), (1, [0.0, 1.0], 1, 0.0), (2, [1.0], 1, 0.0)], SCHEMA)
    assert [(r.query_id, r.vec_id) for r in ann.nearest(two, F.col("vec_id") % 50 == 0).collect()] == [(0, 1)]
    assert ann.nearest(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_recall_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 128)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    want = brute(rows)
    hits = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in found)
    assert hits >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("p, x", [(0.95, 15.507), (0.99, 20.090), (0.5, 7.344)])
def test_chi_square_quantile(p, x):
    assert abs(ann.chi_square_quantile(p, 8) - x) < 1e-3


def test_ties_among_more_copies_than_a_step_and_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 256)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((3, 24))
    # copies of three vectors, doubled ones among them: equal cosines from unequal rows
    rows = [(i, (base[i % 3] * (1 if i % 4 else 2)).tolist()) for i in range(4500)] + [(5000 + i, rng.standard_normal(24).tolist()) for i in range(1500)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(rows)
    assert {q: [i for i, _ in want[q]] for q in want if q < 4500} == {q: v for q, v in got.items() if q < 4500}


def test_search_meets_all_copies_at_bound_zero():
    rng = np.random.default_rng(6)
    missed = 0
    for _ in range(30):
        one = rng.standard_normal(64)
        vectors = np.concatenate([np.tile(one, (500, 1)), rng.standard_normal((77, 64))])
        ids = np.concatenate([rng.permutation(500), 1000 + np.arange(77)])
        r = ann.directions(64)
        q, found, score = ann.Leaf(ids, vectors, r).search(np.stack([one, 3 * one]), ann._unit(np.stack([one, one])) @ r, 6, ann.chi_square_quantile(0.95), np.array([np.inf, np.inf]))
        missed += found[q == 0].tolist() != [0, 1, 2, 3, 4, 5] or found[q == 1].tolist() != [0, 1, 2, 3, 4, 5]
    assert missed == 0


def answers(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


def test_each_length_is_searched(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(6 if i % 3 else 9).tolist()) for i in range(200)] + [(1000, [1.0, 2.0])]
    got = answers(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0))
    want = {}
    for parity in (True, False):
        want |= {q: [i for i, _ in v] for q, v in brute([r for r in rows if (r[0] % 3 == 0) == parity and len(r[1]) > 2]).items()}
    assert got == want and 1000 not in got


@pytest.mark.parametrize("carried", [False, True])
def test_leaves_are_cut_level_by_level(spark, monkeypatch, carried):
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "TOP_LEAVES", 2)
    if carried:
        monkeypatch.setattr(ann, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(ann, "BROADCAST_LEAVES", 0)
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((30, 12)) * 3
    rows = [(i, (centres[i % 30] + 0.3 * rng.standard_normal(12)).tolist()) for i in range(1500)]
    got = answers(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0))
    want = {q: {i for i, _ in v} for q, v in brute(rows).items()}
    assert sum(len(want[q] & set(v)) for q, v in got.items()) >= 0.95 * 5 * len(want)


def test_repeated_vec_ids_count_once_by_a_stated_order(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [-1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0]), (50, [1.0, 0.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.vec_id, round(r.score, 3)) for r in got) == [(0, 1, -1.0), (0, 2, 0.995), (0, 50, 1.0), (50, 0, 1.0), (50, 1, -1.0), (50, 2, 0.995)]
