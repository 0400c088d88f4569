import random
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.llm import runs as R
from claimweave.llm.common import WORD
from claimweave.llm.queries import op13_runs


def brute(w):
    n, out = len(w), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(24, 3 * p):
                out.setdefault((i, j + p), p)  # the smallest period of a stretch comes first
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in out.items())


def expected(doc_id, words):
    rows = brute(words)
    best = min(rows, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    drop = {i for s, n, p in rows for i in range(s + p, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(rows), *top, sha256("".join(f"{s},{n},{p}\n" for s, n, p in rows).encode()).hexdigest(), sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("letters", [1, 2, 3, 5, 50])
def test_against_brute_force(letters):
    rnd = random.Random(letters)
    for _ in range(300):
        n = rnd.randint(0, 160)
        w = [rnd.randrange(letters) for _ in range(n)]
        for _ in range(rnd.randint(0, 3) if n > 30 else 0):
            a, p, m = rnd.randrange(n), rnd.randint(1, 20), rnd.randint(1, 90)
            for i in range(a + p, min(n, a + m)):
                w[i] = w[i - p]
        assert [tuple(r) for r in R._ordered(R.runs_of(np.array(w, dtype=np.int64))).tolist()] == brute(w)


def test_nested_runs_and_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    inner = ([1] * 30 + [2]) * 5
    for w in (b, inner, inner + b, [0, 1] * 12, [0, 1] * 11 + [0], [0] * 24, [0] * 23):
        assert [tuple(r) for r in R._ordered(R.runs_of(np.array(w, dtype=np.int64))).tolist()] == brute(w)


def test_query_against_brute_force(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words, h = WORD.findall(r.text or ""), crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if n < 2000:
            want[r.doc_id] = expected(r.doc_id, words)
    got = {r.doc_id: tuple(r) for r in op13_runs(spark, sf).collect()}
    assert {d: got[d] for d in want} == want and len(got) >= len(want) > 150
    assert sum(r[1] > 0 for r in want.values()) > 10


def test_odd_rows(spark):
    long = " ".join(f"w{i % 17}" for i in range(200_000))
    spread = "\x0b".join(["a b", "c"] * 20)  # a no-break space doesn't part words
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 24), (4, "a " * 24), (None, "b " * 40), (5, long), (6, spread), (7, "x"), (8, " ".join(map(str, range(3000))))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("n_runs", F.lit(1))
    got = R.periodic_runs(df, texts_too=True).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    nothing = sha256(b"").hexdigest()
    for d in (1, 2, 3):
        assert tuple(by[d])[1:8] == (0, None, None, None, None, nothing, nothing)
    assert (by[4].start, by[4].length, by[4].period, by[4].exponent_milli, by[4].collapsed) == (0, 24, 1, 24000, "a")
    assert (by[None].length, by[None].collapsed) == (40, "b")
    assert (by[5].length, by[5].period, by[5].exponent_milli) == (200_000, 17, 1000 * 200_000 // 17)
    assert by[5].collapsed == " ".join(f"w{i}" for i in range(17)) and by[6].period == 2
    assert by[8].n_runs == 0 and by[8].collapsed == rows[-1][1]


def test_ties_and_empty_table(spark):
    rows = [(1, "a " * 24 + "x " + "b " * 24), (2, "a b " * 24 + "c d " * 24 + "e " * 48)]
    got = {r.doc_id: r for r in R.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), True).collect()}
    assert (got[1].n_runs, got[1].start) == (2, 0) and (got[2].n_runs, got[2].start, got[2].exponent_milli) == (3, 96, 48000)
    assert R.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
