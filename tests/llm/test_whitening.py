from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.llm import whitening as W
from claimweave.llm.queries import op11_whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows):
    """Codes by row, exact statistics over the distinct ones, eigenvectors of the exact covariance."""
    sound = [(i, [int(np.floor(np.float64(np.float32(c)) * 64)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in sound})
    n, dims = len(distinct), len(distinct[0])
    sums = [sum(x[d] for x in distinct) for d in range(dims)]
    exact = [[n * sum(x[i] * x[j] for x in distinct) - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
    cov = np.array([[float(Fraction(e, n * n)) for e in row] for row in exact])
    return sound, n, sums, exact, cov


def test_against_exact_covariance(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    sound, n, sums, exact, cov = brute(rows)
    got = op11_whitening(spark, sf).collect()
    assert len(got) == 16 * len(sound)
    values = np.linalg.eigvalsh(cov)[::-1]
    by_row = {}
    for r in got:
        by_row.setdefault(r.vec_id, {})[r.component] = r
        assert r.n == n and r.identity_error < 1e-9
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-9
    found = {}
    for i, x in sound:
        off = [n * v - s for v, s in zip(x, sums)]
        own = by_row[i]
        assert sorted(own) == list(range(1, 17)) and own[1].deviation == sum(o * o for o in off)
        found[tuple(x)] = [own[k].whitened for k in range(1, 17)]
    w = np.array(list(found.values()))
    assert np.abs(w.T @ w / n - np.eye(16)).max() < 1e-9 and np.abs(w.mean(axis=0)).max() < 1e-9
    # each component is an eigenvector: covariance with the centred codes is e times its direction
    d = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(x, sums)] for x in found])
    directions = d.T @ w / n / np.sqrt(values[:16])
    assert np.abs(cov @ directions - directions * values[:16]).max() < 1e-9 * values[0]
    assert np.abs((directions**2).sum(axis=0) - 1).max() < 1e-9


def test_outer_sums_keep_what_doubles_lose():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 50, (3000, 5)) + (1 << 51)
    centre = W.Centre(len(x), [int(s) for s in x.astype(object).sum(axis=0)])
    high, low = centre.centred(x)
    sums = W.outer_sums(high, low, (np.zeros((5, 5)), np.zeros((5, 5))))
    off = [[Fraction(len(x) * int(v) - s, len(x)) for v, s in zip(row, centre.sums)] for row in x.tolist()]
    for i in range(5):
        for j in range(5):
            exact = sum(r[i] * r[j] for r in off)
            scale = sum(abs(r[i] * r[j]) for r in off)
            got = Fraction(float(sums[0][i, j])) + Fraction(float(sums[1][i, j]))
            assert abs(got - exact) < scale * Fraction(1, 1 << 60)  # plain doubles reach some 2^-48


def test_low_parts_survive_merging(spark):
    rows = [(0, [1.0], [0.0]), (0, [2.0**-60], [0.0]), (0, [-1.0], [2.0**-80]), (1, [3.0], [0.0])]
    df = spark.createDataFrame(rows, "place long, high array<double>, low array<double>")
    got = df.repartition("place").sortWithinPartitions("place").mapInArrow(W._merged, df.schema).collect()
    assert {(r.place, r.high[0] + r.low[0]) for r in got} == {(0, 2.0**-60 + 2.0**-80), (1, 3.0)}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    base = [(i, [float(i % 3), float(i % 5), 0.25]) for i in range(15)]
    odd = [(100, None), (101, [nan, 1.0, 2.0]), (102, [inf, 1.0, 2.0]), (103, [None, 1.0, 2.0]), (104, []), (105, [1e30, 0.0, 0.0])]
    again = [(0, base[0][1])] * 3 + [(None, base[1][1])]
    df = spark.createDataFrame(base + odd + again, SCHEMA).withColumn("component", F.lit("clash")).withColumn("x", F.lit(1))
    got = W.whiten(df).collect()
    ids = [r.vec_id for r in got]
    assert {r.n for r in got} == {15} and {r.component for r in got} == {1, 2}  # the third place never varies
    assert ids.count(0) == 8 and ids.count(None) == 2 and not {100, 101, 102, 103, 104, 105} & set(ids)
    assert max(r.identity_error for r in got) < 1e-12
    assert sum(r.explained for r in got if r.vec_id == 7) == pytest.approx(1)


def test_lengths_apart_single_and_empty(spark):
    two = [(i, [float(i), float(i * i)]) for i in range(6)]
    one = [(10 + i, [float(i)]) for i in range(4)]
    got = W.whiten(spark.createDataFrame(two + one, SCHEMA)).collect()
    assert {(r.vec_id < 10, r.n) for r in got} == {(True, 6), (False, 4)} and len(got) == 6 * 2 + 4
    assert W.whiten(spark.createDataFrame([(1, [0.5, 0.5])] * 4, SCHEMA)).count() == 0
    empty = W.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_deviations_are_exact():
    x = np.array([[(1 << 45) + 3, 5], [1, -(1 << 44)]])
    fitted = W.Whitening(W.Centre(10**9, [10**9 * 7, -3]), np.eye(2), np.ones(2), 2.0)
    assert fitted.deviations(x) == [sum((10**9 * v - s) ** 2 for v, s in zip(row, fitted.centre.sums)) for row in x.tolist()]
