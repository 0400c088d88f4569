import random

import corpus_pipeline
import numpy as np
import pytest

from claimweave.llm import common, near_copies, simhash
from claimweave.llm.simhash import wide_keys, wide_votes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], SCHEMA)
    return [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]


def _words(rng, n):
    return [f"w{rng.randrange(50_000)}" for _ in range(n)]


def _changed(rng, words, share):
    return [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def _brute(rows):
    """The least doc_id of each component of the pairs at 0.8 or more, and those pairs."""
    sets = {i: near_copies.shingle_set(t) for i, t in rows}
    ids, root = sorted(sets), {i: i for i in sets}
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if near_copies.similarity(sets[a], sets[b]) >= 0.8]
    for _ in ids:
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    return {i for i in ids if root[i] == i}, pairs


def test_stage_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):  # copies around and above 0.8, which three bits of a fingerprint seldom link
        base = _words(rng, rng.randrange(150, 500))
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(_changed(rng, base, rng.choice([0.005, 0.01, 0.02]))))]
        rows.append((3 * i + 2, " ".join(_changed(rng, base, 0.1))))
    rows += [(1000, ""), (1001, None), (1002, " \n"), (1003, "one two"), (1004, "one  Two"), (1005, "one three")]
    keep, pairs = _brute(rows)
    assert len(pairs) > 80
    assert sorted(_kept(spark, rows)) == sorted(keep)


@pytest.mark.parametrize("n, found", [(9, 0.985), (36, 0.985), (180, 0.99), (900, 0.99)])
def test_wide_keys_propose_pairs_just_at_the_bound(n, found):
    rng = np.random.default_rng(2)
    missed, far = 0, 0
    for _ in range(500):
        both, a, b = (rng.integers(0, 1 << 63, m, dtype=np.uint64) for m in (n * 8 // 9, n // 9, n // 9))
        keys, short = wide_keys(np.stack([wide_votes(np.union1d(both, a)), wide_votes(np.union1d(both, b))]))
        missed += not set(keys[0].tolist()) & set(keys[1].tolist())
        far += np.bitwise_count((short[0] ^ short[1]).view(np.uint64)).sum() > near_copies.SHORT_BITS
    assert missed <= 500 * (1 - found) and far == 0  # at exactly 0.8


def test_soft_decoding_against_all_codewords():
    rng = np.random.default_rng(3)
    decode, _ = simhash._balls()
    signs = simhash._codeword_signs()
    assert all(decode[int((signs[:, i] > 0) @ (1 << np.arange(23)))] == i for i in range(0, 4096, 37))
    x = rng.integers(0, 1 << 23, 200)
    bits = (2 * ((x[:, None] >> np.arange(23)) & 1) - 1).astype(np.float32)
    nearest = (bits @ signs).argmax(axis=1)
    assert (nearest == decode[x]).all()  # equal votes: the hard decision, the one codeword within 3 bits


def test_large_buckets_and_chains(spark):
    rng = random.Random(3)
    base = _words(rng, 400)
    rows = [(i, " ".join(_changed(rng, base, 0.004))) for i in range(300)]
    chain = _words(rng, 400)
    for i in range(300, 330):  # each like the one before, the ends unlike
        chain = _changed(rng, chain, 0.012)
        rows.append((i, " ".join(chain)))
    frame = _words(rng, 300)  # half a frame in common: many candidates, no copies
    rows += [(i, " ".join(frame + _words(rng, 150))) for i in range(400, 460)]
    keep, _ = _brute(rows)
    assert sorted(_kept(spark, rows)) == sorted(keep)


def test_repeated_and_null_ids(spark):
    text = " ".join(_words(random.Random(4), 50))
    assert sorted(map(str, _kept(spark, [(None, text), (None, text), (5, text), (5, text), (7, text + " end")]))) == ["5", "None", "None"]
    assert _kept(spark, []) == []


@pytest.mark.parametrize("n", [9, 36, 180, 900])
def test_sketched_votes_let_pairs_at_the_bound_through(n):
    rng = np.random.default_rng(6)
    at, below = 0, 0
    for share in (8 / 9, 0.68):  # of each set in common: similarity 0.8 and 0.52
        for _ in range(200):
            k = round(n * share)
            both, a, b = (rng.integers(0, 1 << 63, m, dtype=np.uint64) for m in (k, n - k, n - k))
            x, y = simhash.sketch_units(simhash.sketches(np.stack([wide_votes(np.union1d(both, a)), wide_votes(np.union1d(both, b))])))
            if share > 0.8:
                at += x @ y < near_copies.COSINE
            else:
                below += x @ y >= near_copies.COSINE
    assert at <= 1 and below == 0


@pytest.mark.parametrize("size", [1, 7, 50, 1000])
def test_members_near_no_other_go_and_no_one_else(size):
    import pyarrow as pa

    rng = np.random.default_rng(8)
    rows = []
    for key, members in enumerate([1, 2, 2, 3, 10, 40, near_copies.CROWD, near_copies.CROWD + 1, 200, 1, 2]):
        middle = rng.integers(0, 1 << 62, 2)
        for i in range(members):
            near = rng.random() < 0.5
            rows.append((key, len(rows), *(middle ^ (1 << i % 20) if near else rng.integers(0, 1 << 62, 2)).tolist()))
    wanted = {}
    for key, node, *short in rows:
        others = [r for r in rows if r[0] == key and r[1] != node]
        if len(others) >= near_copies.CROWD or any(sum((x ^ y).bit_count() for x, y in zip(short, r[2:])) <= near_copies.SHORT_BITS for r in others):
            wanted[node] = key
    names = ["key", "node", "s0", "s1"]
    parts = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size])], names=names) for i in range(0, len(rows), size)]
    found = [x for p in near_copies._meeting_batches(iter(parts)) for x in zip(*(p.column(c).to_pylist() for c in ("key", "node", "members")))]
    assert sorted((node, key) for key, node, _ in found) == sorted(wanted.items())
    counts = {k: sum(key == k for key in wanted.values()) for k in wanted.values()}
    assert all(m in (0, counts[key]) and (m == 0) == (counts[key] > near_copies.CROWD) for key, _, m in found)


def test_filter_of_ids_keeps_all_of_them_and_few_others(spark):
    rows = spark.createDataFrame([(i * 7919 - 40_000, f"t{i}") for i in range(20_000)], "doc_id long, text string")
    some = rows.filter("doc_id % 10 = 0").select("doc_id")
    wanted = {r.doc_id for r in some.collect()}
    kept = {r.doc_id for r in common.maybe_among(rows, "doc_id", some).collect()}
    assert wanted <= kept and len(kept) < len(wanted) + 20
    assert common.maybe_among(rows, "doc_id", some.limit(0)).count() == 0
    assert common.maybe_among(rows.limit(0), "doc_id", some).count() == 0


def test_two_members_are_compared_in_one_of_their_buckets_only():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    node_keys = {node: sorted(rng.choice(12, rng.integers(1, 7), replace=False).tolist()) for node in range(60)}
    rows = sorted((key, node, 1, 2) for node, keys in node_keys.items() for key in keys)  # all are near each other
    names = ["key", "node", "s0", "s1"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 7])], names=names) for i in range(0, len(rows), 7)]
    met = [x for p in near_copies._meeting_batches(iter(batches)) for x in zip(*(p.column(c).to_pylist() for c in ("key", "node", "nth")))]
    places = {node: [key for key, _ in sorted(((k, at) for k, m, at in met if m == node), key=lambda x: (x[1], x[0]))] for node in node_keys}
    assert all(sorted(n for n in node_keys if k in node_keys[n])[at] == node for k, node, at in met)
    sketch = bytes([0x1F] * 224)
    met = sorted((key, node) for key, node, _ in met)
    columns = [pa.array(list(c), pa.int64()) for c in zip(*met)]
    alike = [pa.array([sketch] * len(met), pa.binary()), pa.array([10] * len(met), pa.int64()), pa.array([places[node] for _, node in met], pa.list_(pa.int32()))]
    whole = pa.RecordBatch.from_arrays([*columns, columns[1], *alike], names=["key", "node", "root", "sketch", "n", "places"])
    pairs = []
    for lo, hi in [(0, 1), (1, 4), (4, 16), (16, 64)]:
        for p in near_copies._pair_batches(lo, hi)(whole.slice(i, 11) for i in range(0, len(met), 11)):
            pairs += zip(p.column("a").to_pylist(), p.column("b").to_pylist())
    wanted = {(a, b) for a in node_keys for b in node_keys if a < b and set(node_keys[a]) & set(node_keys[b])}
    assert len(pairs) == len(wanted) and set(pairs) == wanted


def test_places_go_on_in_a_crowd():
    import pyarrow as pa

    rows = [(key, node, 0, 0) for key, many in enumerate([3, near_copies.CROWD + 40, 2, 300]) for node in range(many)]
    for size in (1, 30, 1000):
        parts = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size])], names=["key", "node", "s0", "s1"]) for i in range(0, len(rows), size)]
        found = [x for p in near_copies._meeting_batches(iter(parts)) for x in zip(*(p.column(c).to_pylist() for c in ("node", "nth")))]
        assert len(found) == len(rows) and all(node == nth for node, nth in found)
