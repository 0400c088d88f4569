import random

import numpy as np
import xxhash

from claimweave.llm import simhash
from claimweave.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, component_id int"


def brute(texts):
    def fp(text):
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    return [fp(t) for t in texts]


def test_keys_meet_at_three_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for bits in (0, 1, 2, 3):
        b = a.copy()
        for i in range(len(b)):
            for k in rng.choice(64, bits, replace=False):
                b[i] ^= np.uint64(1 << int(k))
        for keys in (simhash.golay_keys, lambda x: simhash.block_keys(x[:300], 8)):
            mine, other = (set(zip(*(c.tolist() for c in keys(x.view(np.int64))))) for x in (a, b))
            rows = {r for r, _ in mine}
            assert {r for r, _ in mine & other} == rows


def test_groups_match_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "One two", "ONE two", "one", "É È", "é è"]
    for _ in range(60):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, 300))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(3)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "x"
            texts.append(" ".join(copy))
    rows = [(7 * i + 5, t, "clash", 1) for i, t in enumerate(texts)] + [(5, texts[8], "clash", 1), (None, texts[9], "clash", 1)]
    fps = brute([r[1] for r in rows])
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), 1 << 60))
    want = sorted((str(r[0]), fps[i], least[find(i)]) for i, r in enumerate(rows))
    got = sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == want


def test_large_bucket_goes_to_finer_keys(spark, monkeypatch):
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(46, 64) for b in range(23)} | {base ^ (7 << 10) ^ (1 << 60)})
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    monkeypatch.setattr(simhash, "BUCKET", 8)
    links = simhash.fingerprint_links(frame)
    roots = {r.root for r in connected_components(links).collect()}
    assert len(roots) == 1 and links.count() < 40 * len(fps)


def test_empty_table(spark):
    assert simhash.near_duplicate_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
