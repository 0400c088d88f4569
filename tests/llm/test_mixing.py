import hashlib
import math
from collections import Counter

import pytest

from claimweave.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mix_copy string, draws int"


def brute(rows, weights, total):
    n = Counter(r[3] for r in rows)
    weights = weights or {s: 1.0 for s in n}
    present = sum(w for s, w in weights.items() if s in n)
    out = Counter()
    for doc_id, _, _, source, *_ in rows:
        mean = weights.get(source, 0) * total / present / n[source]
        draws = max(1, math.ceil(mean / mixing.MAX_MEAN))
        for i in range(1, draws + 1):
            key = "" if doc_id is None else str(doc_id)
            u = int(hashlib.md5(f"{mixing.SEED}|{key}|{i}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = math.exp(-mean / draws)
            k = 0
            while c <= u and k < mixing.MAX_COUNT:
                k += 1
                p *= mean / draws / k
                c += p
            out[doc_id] += k
    return +out


@pytest.mark.parametrize("weights, total", [(None, None), ({"a": 3.0, "b": 1.0}, 900), ({"a": 0.0, "tiny": 5.0, "absent": 5.0}, 200)])
def test_counts_match_brute_force(spark, weights, total):
    rows = [(i, f"t{i}", "en", "a" if i % 3 else "b", 1, "c", 9) for i in range(400)] + [(1000, None, None, "tiny", None, "c", 9), (1001, "", None, None, 0, "c", 9), (None, "x", "en", "a", 1, "c", 9)]
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA), weights, total).collect()
    want = brute(rows, weights, total or len(rows))
    assert Counter(r.doc_id for r in got) == want
    seen = {}
    for r in got:
        seen.setdefault(r.doc_id, []).append(r.mix_copy)
    assert all(sorted(v) == list(range(len(v))) for v in seen.values())


def test_many_sources_are_joined_with_salts(spark):
    rows = [(i, f"t{i}", "en", None if i % 7 == 0 else "a" if i % 3 else "b", 1, "c", 9) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    wide, narrow = (Counter((r.doc_id, r.mix_copy, r.mix_rate) for r in mixing.mix_sources(docs, broadcast_limit=n).collect()) for n in (10, 0))
    assert wide == narrow and len(wide) > 200


def test_shares_come_near_the_weights(spark):
    rows = [(i, "t", "en", "hot" if i % 3 else f"s{i % 9}", 1, "c", 9) for i in range(6000)]
    got = Counter(r.source for r in mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect())
    assert all(abs(n - 1500) < 5 * math.sqrt(1500) for n in got.values()) and len(got) == 4


def test_refusals_and_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_sources(docs).count() == 0
    for bad in ({"a": -1.0}, {"a": 0.0}, {"a": float("nan")}):
        with pytest.raises(ValueError):
            mixing.mix_sources(docs, bad)
