"""SimHash fingerprints, Golay-code fuzzy keys for them, and groups of linked documents.

A 64-bit fingerprint is cut into two segments of 23 bits (``A``, ``B``) and a rest ``R`` of 18 bits.
The perfect binary Golay code [23, 12] assigns each 23-bit word to the one codeword at distance at
most 3; ``ball(x)`` is the set of codeword indices (12 bits) to which ``x`` and its 23 neighbours
decode, six at most. Two words at distance 2 or less share an index of their balls, because a word
midway lies in both. With at most three differing bits, (a, b, r) of them in A, B and R, the
pigeonhole leaves these cases, each with a key that both fingerprints hold:

====  =========================  =============================================  ========
key   covers                     made of                                        per row
====  =========================  =============================================  ========
0     b = 0, a <= 2              B exactly, an index of ball(A)                 <= 6
1     a = 0, b <= 2              A exactly, an index of ball(B)                 <= 6
2     r = 0, a <= 2              R exactly, an index of ball(A)                 <= 6
3     a = 3                      B and R exactly                                1
4, 5  a = b = r = 1              indices of A and B, an exact half of R         <= 12
====  =========================  =============================================  ========

For keys 4 and 5 one differing bit flips the parity of A, so even-parity rows give (index of A itself,
ball(B)) and odd-parity rows give (ball(A), index of B itself): six pairs, not 36. Keys hold 30 to 41
bits exactly (no further hashing), so unrelated fingerprints hardly meet.

A key that more than ``BUCKET`` distinct fingerprints share isn't compared pairwise: its members get
keys of a finer pigeonhole (all but three of 8, then of 16 blocks of bits, exactly), by which a bucket
cannot hold more than 2^24, then 2^12, different fingerprints; the last tier is compared in full, in
blocks. Verified links leave a task as a spanning forest of their bucket, never as all pairs.

Shingle sets of similarity 0.8 differ in some 15 % of a fingerprint's bits, more than any three of 64. For
them (:mod:`.near_copies`) there are wide fingerprints of WIDE_SEGMENTS segments, of which each is decoded to
several nearby codewords by its votes: :func:`wide_keys`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty, work_table
from .components import connected_components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Fingerprints of one key that are compared pairwise; larger buckets are keyed more finely.
BUCKET = 256
#: Generator polynomial of the binary Golay code (fixed value): x^11+x^9+x^7+x^6+x^5+x+1.
GOLAY_POLY = 0b101011100011

_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r" + bytes(range(65, 91)), b"     " + bytes(range(97, 123)))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text: a bit is 1 if set in over half of the shingles' hashes."""
    words = [w for w in (text or "").encode("utf-8", "surrogatepass").translate(_SPACES).split(b" ") if w]
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    h = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):  # whole texts, in blocks: bits take 64 times the room of hashes
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            fps = np.fromiter((fingerprint(t) for t in part.column("text").to_pylist()), dtype=np.uint64, count=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)``, ``fp`` being the 64 bits as a signed long; null text counts as empty (fp 0)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


@lru_cache(maxsize=1)
def _balls() -> tuple[np.ndarray, np.ndarray]:
    """``decode[x]``: codeword index of each 23-bit word; the XOR masks of the radius-1 ball."""
    syndrome_bits = np.zeros(23, dtype=np.int32)
    value = 1
    for i in range(23):  # x^i modulo the generator
        syndrome_bits[i] = value
        value <<= 1
        if value >> 11:
            value ^= GOLAY_POLY
    leader = np.zeros(2048, dtype=np.int32)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= int(syndrome_bits[b])
            leader[s] = sum(1 << b for b in bits)
    decode = np.empty(1 << 23, dtype=np.int16)
    for at in range(0, 1 << 23, 1 << 18):
        words = np.arange(at, at + (1 << 18), dtype=np.int32)
        syndrome = np.zeros(1 << 18, dtype=np.int32)
        for i in range(23):
            syndrome ^= ((words >> i) & 1) * syndrome_bits[i]
        # the code is systematic in its upper 12 bits, which therefore number the codewords
        decode[at : at + (1 << 18)] = (words ^ leader[syndrome]) >> 11
    return decode, np.array([0, *(1 << i for i in range(23))], dtype=np.int32)


def _segments(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    f = fp.view(np.uint64)
    return (f & np.uint64(0x7FFFFF)).astype(np.int64), ((f >> np.uint64(23)) & np.uint64(0x7FFFFF)).astype(np.int64), (f >> np.uint64(46)).astype(np.int64)


def _ball_indices(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and codeword indices of all balls, without repeats."""
    decode, masks = _balls()
    found = np.sort(decode[x[:, None].astype(np.int32) ^ masks[None, :]].astype(np.int64), axis=1)
    fresh = np.ones(found.shape, dtype=bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    rows, _ = np.nonzero(fresh)
    return rows, found[fresh]


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` for signed 64-bit fingerprints; the key's family stands in bits 48 and up."""
    decode, _ = _balls()
    a, b, r = _segments(fp)
    ra, ia = _ball_indices(a)
    rb, ib = _ball_indices(b)
    rows = np.arange(len(fp))
    odd = np.bitwise_count(a.astype(np.uint64)) % 2 == 1
    own_a, own_b = decode[a.astype(np.int32)].astype(np.int64), decode[b.astype(np.int32)].astype(np.int64)
    out = [(ra, 0, (b[ra] << 12) | ia), (rb, 1, (a[rb] << 12) | ib), (ra, 2, (r[ra] << 12) | ia), (rows, 3, (b << 18) | r)]
    from_even, from_odd = ~odd[rb], odd[ra]
    pair_rows = np.concatenate([rb[from_even], ra[from_odd]])
    pairs = np.concatenate([(own_a[rb[from_even]] << 12) | ib[from_even], (ia[from_odd] << 12) | own_b[ra[from_odd]]])
    out += [(pair_rows, 4, (pairs << 9) | (r[pair_rows] & 511)), (pair_rows, 5, (pairs << 9) | (r[pair_rows] >> 9))]
    return np.concatenate([x[0] for x in out]), np.concatenate([(np.int64(k) << 48) | v for _, k, v in out])


def block_keys(fp: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of the finer pigeonhole: all but three of ``blocks`` blocks, hashed to 64 bits.

    A hash that two different contents share only adds pairs to verify.
    """
    f, width = fp.view(np.uint64), 64 // blocks
    out = []
    for n, free in enumerate(combinations(range(blocks), MAX_BITS)):
        mask = np.uint64((1 << 64) - 1 - sum(((1 << width) - 1) << (k * width) for k in free))
        mixed = ((f & mask) ^ np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((mixed ^ (mixed >> np.uint64(29))).view(np.int64))
    return np.tile(np.arange(len(fp)), len(out)), np.concatenate(out)


#: Segments of a wide fingerprint, nearby codewords of each that count, and segments that make a key.
WIDE_SEGMENTS, NEARBY, JOINED = 18, 3, 2
#: Bits of the short fingerprint that goes along with wide keys: 64 a word.
SHORT_WORDS = 2
#: Width of a level of the 15 levels of sketched votes, in their root mean squares.
LEVEL = 0.45


@lru_cache(maxsize=1)
def _codeword_signs() -> np.ndarray:
    """The 4096 codewords as columns of signs, in the order of their indices."""
    words = np.arange(4096, dtype=np.int64) << 11
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GOLAY_POLY << (bit - 11)), rest)
    return (2 * (((words | rest)[None, :] >> np.arange(23)[:, None]) & 1) - 1).astype(np.float32)


def wide_votes(hashes: np.ndarray) -> np.ndarray:
    """For each bit of a wide fingerprint how many more of the shingles' hashes set it than clear it.

    Its sign is the fingerprint's bit, its size says how sure the bit is.
    """
    out = []
    for k in range(-(-WIDE_SEGMENTS * 23 // 64)):  # further 64 bits of each shingle
        h = (hashes ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), 1 << 14):
            ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(2 * ones - len(h))
    return np.concatenate(out)


def wide_keys(votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and short fingerprints of rows of :func:`wide_votes`.

    Each segment of 23 bits is decoded, by its bits' votes, to its NEARBY nearest codewords. Of JOINED
    neighbouring segments all combinations of their indices are keys: near copies share one unless each
    such group has a segment with too many errors for that. Where the similarity of shingle sets is 0.8, a segment shares
    a codeword with probability 0.7 or more, and one of the WIDE_SEGMENTS / JOINED groups with more than 0.997.
    """
    n = len(votes)
    segments = votes[:, : WIDE_SEGMENTS * 23].reshape(n * WIDE_SEGMENTS, 23).astype(np.float32)
    near = np.empty((n * WIDE_SEGMENTS, NEARBY), dtype=np.int64)
    for at in range(0, len(segments), 1 << 10):
        match = segments[at : at + (1 << 10)] @ _codeword_signs()
        for k in range(NEARBY):
            near[at : at + len(match), k] = match.argmax(axis=1)
            match[np.arange(len(match)), near[at : at + len(match), k]] = -np.inf
    groups = near.reshape(n, WIDE_SEGMENTS // JOINED, JOINED, NEARBY)
    keys = np.broadcast_to(np.arange(WIDE_SEGMENTS // JOINED, dtype=np.int64)[None, :, None], (n, WIDE_SEGMENTS // JOINED, 1))
    for k in range(JOINED):
        keys = ((keys[:, :, :, None] << 12) | groups[:, :, k, None, :]).reshape(n, WIDE_SEGMENTS // JOINED, -1)
    short = np.packbits(votes[:, : 64 * SHORT_WORDS] > 0, axis=1, bitorder="little").view("<i8")
    return keys.reshape(n, -1), short


def sketches(votes: np.ndarray) -> np.ndarray:
    """Rows of :func:`wide_votes` in 4 bits a vote, as rows of bytes.

    Their cosine (:func:`sketch_units`) estimates that of the shingle sets about three times as sharply as
    the same number of signs: at a similarity of 0.8 it is 0.874 with a deviation of 0.010, at 0.62 0.751 and 0.019.
    """
    spread = np.sqrt((votes.astype(np.float64) ** 2).mean(axis=1, keepdims=True))
    levels = (np.clip(np.rint(votes / np.maximum(spread, 1e-9) / LEVEL), -7, 7) + 8).astype(np.uint8)
    return levels[:, ::2] | (levels[:, 1::2] << 4)


def sketch_units(sketch: np.ndarray) -> np.ndarray:
    """Rows of :func:`sketches` as vectors of length 1 (of no votes: 0)."""
    out = np.empty((len(sketch), 2 * sketch.shape[1]), dtype=np.float32)
    out[:, ::2], out[:, 1::2] = sketch & 15, sketch >> 4
    out -= 8
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _key_batches(tier: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_at_once = 1 << 14 if tier == 0 else 1 << 9
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(fps), rows_at_once):
                part = fps[at : at + rows_at_once]
                rows, key = golay_keys(part) if tier == 0 else block_keys(part, 8 * tier)
                for k in range(0, len(rows), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(key[k : k + (1 << 18)]), pa.array(part[rows[k : k + (1 << 18)]])], names=["key", "fp"])

    return keys


def _forest(members: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links (at most MAX_BITS differing bits) among distinct fingerprints."""
    n = len(members)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out, m = [], members.view(np.uint64)
    for i in range(n - 1):
        for j in np.nonzero(np.bitwise_count(m[i + 1 :] ^ m[i]) <= MAX_BITS)[0] + i + 1:
            a, b = find(i), find(int(j))
            if a != b:
                root[b] = a
                out.append((int(members[i]), int(members[j])))
    return out


def _link_batches(last: bool):
    """Walk over rows sorted by (key, fp). Small buckets give links, the members of large ones go on."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "again"]
        held_key, held = None, []

        def flush(out):
            if len(held) > 1:
                out += [(a, b, False) for a, b in _forest(np.array(held, dtype=np.int64))]

        over = False
        for batch in batches:
            out: list[tuple[int, int, bool]] = []
            key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
            cuts = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1, [len(key)]]) if len(key) else np.array([0])
            runs = len(cuts) - 1
            # a run of one row that neither begins nor ends the batch has nothing to link to
            for k in sorted({0, runs - 1, *np.nonzero(np.diff(cuts) > 1)[0].tolist()}) if runs else ():
                lo, hi = cuts[k], cuts[k + 1]
                if key[lo] != held_key:
                    if not over:
                        flush(out)
                    held_key, held, over = key[lo], [], False
                for f in fp[lo:hi].tolist():
                    if over:
                        out.append((f, f, True))
                    elif not held or held[-1] != f:
                        held.append(f)
                        if len(held) > BUCKET and not last:
                            out += [(x, x, True) for x in held]
                            held, over = [], True
            if out:
                a, b, again = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(again)], names=names)
        out = []
        if not over:
            flush(out)
        if out:
            a, b, again = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(again)], names=names)

    return links


def fingerprint_links(distinct_fps: DataFrame) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs at MAX_BITS or fewer differing bits.

    ``distinct_fps``: one column ``fp`` without repeats. At most BUCKET - 1 links leave each bucket.
    """
    links, todo = None, distinct_fps
    for tier in range(3):
        keyed = todo.mapInArrow(_key_batches(tier), "key long, fp long")
        found = work_table(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_link_batches(tier == 2), "a long, b long, again boolean"), f"links{tier}")
        own = found.filter(~F.col("again")).select("a", "b")
        links = own if links is None else links.unionByName(own)
        todo = found.filter("again").select(F.col("a").alias("fp")).distinct()
        if tier < 2 and todo.isEmpty():
            break
    return links.distinct()


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per input row.

    Documents link when their fingerprints differ in three bits or fewer; ``component_id`` is the
    smallest doc_id reachable. Null and empty texts have fingerprint zero and link like any other;
    a null doc_id takes part but never names a component unless all its members are null. Repeated
    rows give repeated rows. Tables without rows give none.
    """
    fps = work_table(fingerprints(docs), "fingerprints")
    classes = work_table(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    labels = connected_components(fingerprint_links(classes.select("fp")))  # only linked fingerprints
    named = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.select("fp", "root").join(heads, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")
