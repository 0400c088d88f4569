"""Near copies by shingles: SimHash with wide Golay keys proposes pairs of texts, their exact similarity decides.

A text is its set of shingles of WIDTH words. The set's wide SimHash fingerprint (:func:`.simhash.wide_keys`) is
decoded segment by segment to nearby codewords of the Golay code, whose indices make the keys by which texts
meet. Equal sets are one class from the start. Members of a key's bucket whose short fingerprint is near no
other's there go no further: in a large corpus most meet by chance. The others are compared with the bucket's
first member, then with the next 15, the next 240 and so on, as far as they are not connected yet; a bucket
of near copies costs one comparison a member, and no pair of any bucket is left out. Two texts that share several
buckets are compared in one of them only, that in which the first has the lowest place. A pair goes
on to the texts unless sizes or sketched votes already rule out SIMILARITY.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_among, slices, text_or_empty, work_table
from .components import connected_components
from .simhash import _SPACES, SHORT_WORDS, sketch_units, sketches, wide_keys, wide_votes

WIDTH = 5
SIMILARITY = 0.8
#: Bits in which the short fingerprints (128 bits) may differ: at SIMILARITY 19 are expected, with a deviation of 4.
SHORT_BITS = 40
#: Cosine that the sketched votes reach: at SIMILARITY 0.874 is expected, with a deviation of 0.010.
COSINE = 0.833
#: Members of a bucket up to which those near no other are sought; all members of larger ones go on.
CROWD = 64
#: Members of a bucket against which a task holds all behind them, at most.
HELD = 4096
#: Pairs of one first member that a task verifies in a row, on average.
STAR = 4096
#: Texts whose keys are made at once.
TOGETHER = 256

_WORD_FACTORS = np.random.default_rng(20240611).integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of fewer than WIDTH words, one of them all."""
    words = [w for w in (text or "").encode("utf-8", "surrogatepass").translate(_SPACES).split(b" ") if w]
    if len(words) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], dtype=np.uint64)
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    h = np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))
    n = len(h) - WIDTH + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(WIDTH):
        out += h[i : i + n] * _WORD_FACTORS[i]
    return np.unique(out)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


_SIGNED = "doc_id long, digest binary, n long, short array<long>, sketch binary, keys array<long>"


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            for at in range(0, part.num_rows, TOGETHER):
                some = part.slice(at, TOGETHER)
                sets = [shingle_set(t) for t in some.column("text").to_pylist()]
                votes = np.stack([wide_votes(s) for s in sets])
                keys, short = wide_keys(votes)
                drawn = pa.array([row.tobytes() for row in sketches(votes)], pa.binary())
                digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), digests, pa.array([len(s) for s in sets], pa.int64()), _lists(short), drawn, _lists(keys)], names=["doc_id", "digest", "n", "short", "sketch", "keys"])


def _near_some(key: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key: whether a row's short fingerprint is near another's of its key, and how many of a key are.

    In buckets beyond CROWD all are, and the number is 0, as such a bucket may go on in the next rows.
    """
    starts = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
    sizes = np.diff(np.append(starts, len(key)))
    crowd = np.repeat(sizes > CROWD, sizes)
    near, at, step = crowd.copy(), np.nonzero(~crowd)[0], 1
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        met = at[np.bitwise_count(short[at] ^ short[at + step]).sum(axis=1) <= SHORT_BITS]
        near[met] = near[met + step] = True
        step += 1
    return near, np.where(crowd, 0, np.repeat(np.add.reduceat(near.astype(np.int64), starts), sizes))


def _meeting_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, node); a bucket's members at a batch's end wait for the next batch. ``nth``: a member's place among those that go on."""
    names = ["key", "node", *(f"s{k}" for k in range(SHORT_WORDS))]
    held, crowd, gone = np.zeros((0, len(names)), dtype=np.int64), None, 0

    def batch_of(rows: np.ndarray, members: np.ndarray, nth: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(members), pa.array(nth)], names=["key", "node", "members", "nth"])

    def out(rows: np.ndarray) -> pa.RecordBatch:
        near, members = _near_some(rows[:, 0], rows[:, 2:].view(np.uint64))
        rows, members, at = rows[near], members[near], np.arange(int(near.sum()))
        first = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])[: len(rows)]
        return batch_of(rows, members, at - np.maximum.accumulate(np.where(first, at, 0)))

    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
        if crowd is not None:  # the rest of a bucket that has gone on already
            n = int(np.argmin(rows[:, 0] == crowd)) if (rows[:, 0] != crowd).any() else len(rows)
            yield batch_of(rows[:n], np.zeros(n, dtype=np.int64), np.arange(gone, gone + n))
            rows, gone = rows[n:], gone + n
            if not len(rows):
                continue
            crowd = None
        rows = np.ascontiguousarray(np.concatenate([held, rows]))
        if not len(rows):
            continue
        last = int(np.argmax(rows[:, 0] == rows[-1, 0]))
        if len(rows) - last > CROWD:
            gone, last, crowd = len(rows) - last, len(rows), rows[-1, 0]
        if last:
            yield out(rows[:last])
        held = rows[last:]
    if len(held):
        yield out(np.ascontiguousarray(held))


def _pair_batches(lo: int, hi: int):
    """Rows come sorted by (key, node): members ``lo`` to ``hi`` of a bucket against all behind them.

    ``places`` are all keys of a member, by its place in their buckets, then by key. Two members meet in each bucket they share,
    but are compared only in the first by the earlier one's places: none of its keys before that is the other's.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, nth = None, 0
        # nodes, components and sizes of the members lo to hi, and their sketched votes
        held, votes = np.zeros((3, 16), dtype=np.int64), None
        before: list[frozenset[int]] = []  # the keys of each held member before this one
        for batch in batches:
            a, b, rows = [], [], 0
            if not batch.num_rows:
                continue
            units = sketch_units(np.stack([np.frombuffer(x, dtype=np.uint8) for x in batch.column("sketch").to_pylist()]))
            if votes is None:
                votes = np.zeros((16, units.shape[1]), dtype=np.float32)
            places = batch.column("places").to_pylist()
            for i, (key, *member) in enumerate(zip(*(batch.column(c).to_numpy().tolist() for c in ("key", "node", "root", "n")))):
                if key != held_key:
                    held_key, nth, before = key, 0, []
                node, root, n = member
                at = min(nth, hi) - lo
                if at > 0:
                    fits = np.nonzero((held[1, :at] != root) & (np.minimum(held[2, :at], n) >= SIMILARITY * np.maximum(held[2, :at], n) - 1e-6))[0]
                    fits = fits[votes[fits] @ units[i] >= COSINE]
                    others = set(places[i]) if len(fits) else ()
                    own = held[0, [at for at in fits.tolist() if before[at].isdisjoint(others)]]
                    if len(own):
                        a.append(own)
                        b.append(np.full(len(own), node, dtype=np.int64))
                        rows += len(own)
                if lo <= nth < hi:
                    if nth - lo == held.shape[1]:
                        held, votes = np.concatenate([held, np.zeros_like(held)], axis=1), np.concatenate([votes, np.zeros_like(votes)])
                    held[:, nth - lo], votes[nth - lo] = member, units[i]
                    before.append(frozenset(places[i][: places[i].index(key)]))
                nth += 1
                if rows >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                    a, b, rows = [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return pairs


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (a, salt, b), the text of ``a`` itself first, with a null ``b``."""
    first = np.zeros(0, dtype=np.uint64)
    for batch in batches:
        for part in slices(batch, "text"):
            found = []
            for a, b, text in zip(*(part.column(c).to_pylist() for c in ("a", "b", "text"))):
                if b is None:
                    first = shingle_set(text)
                elif similarity(first, shingle_set(text)) >= SIMILARITY:
                    found.append((a, b))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose texts reach SIMILARITY; ``texts`` holds one row a doc_id."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
    text = texts.select(F.col("doc_id").alias("node"), "text")
    others = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), "b", F.col("b").alias("node")).join(text, "node")
    firsts = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), F.col("a").alias("node")).join(text, "node")
    both = others.unionByName(firsts).select("a", "salt", "b", "text")
    return both.repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b")).mapInArrow(_verify_batches, "a long, b long")


def meetings(classes: DataFrame) -> DataFrame:
    """``(key, node, members, nth)``: members of buckets that may have a partner there, and their places; 0 members are more than CROWD."""
    words = [F.col("short")[k].alias(f"s{k}") for k in range(SHORT_WORDS)]
    keyed = classes.select(F.explode("keys").alias("key"), "node", *words)
    return keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_meeting_batches, "key long, node long, members long, nth long")


def near_copy_links(classes: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Verified links ``(a, b)`` whose components are those of all proposed pairs of SIMILARITY or more.

    ``classes`` holds ``(node, n, short, sketch, keys)``, a row for each distinct shingle set. None if nothing is proposed.
    """
    met = work_table(meetings(classes), "meetings")
    crowds = met.filter("members = 0").groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    biggest = met.select("members").unionByName(crowds.select("members")).agg(F.max("members")).first()[0]
    if biggest is None:
        return None
    # a class moves once with all its buckets, of which it has no more than keys
    own = met.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("nth", "key", "members"))).alias("buckets"))
    few = maybe_among(classes.select("node", "n", "sketch"), "node", met.select("node"))
    nodes = work_table(own.join(few, "node"), "nodes")
    ids = nodes.select(F.col("node").alias("doc_id"))
    texts = work_table(maybe_among(texts, "doc_id", ids).join(ids, "doc_id", "left_semi"), "candidates")
    links, lo, hi = None, 0, 1
    while lo < biggest - 1:
        if links is None:
            rooted = nodes.withColumn("root", F.col("node"))
        else:
            rooted = nodes.join(connected_components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = lo + 1
        opened = F.transform(F.filter("buckets", lambda x: (x.members > least) | (x.members == 0)), lambda x: x.key)
        places = F.transform("buckets", lambda x: x.key.cast("int"))  # keys are below 2^28
        ordered = rooted.select("node", "root", "n", "sketch", places.alias("places"), F.explode(opened).alias("key")).repartition("key").sortWithinPartitions("key", "node")
        pairs = work_table(ordered.mapInArrow(_pair_batches(lo, hi), "a long, b long").distinct(), "pairs")
        found = work_table(verified(pairs, texts), "links")
        links = found if links is None else links.unionByName(found)
        lo, hi = hi, min(16 * hi, hi + HELD)
    return links


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """``docs`` less the near copies of documents with a smaller doc_id.

    Groups are the components of the pairs whose shingle sets reach SIMILARITY; null, empty and blank
    texts are equal to each other. Of rows that repeat a doc_id the one with the least text stays (null
    first), the others are lost, as there is but one document of an id; rows with a null doc_id
    stay and link nothing (nothing identifies them).
    """
    named = docs.filter("doc_id IS NOT NULL")
    repeated = named.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not repeated.isEmpty():  # only the rows of those ids move
        least = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.asc_nulls_first("text"), *(c for c in docs.columns if c not in ("doc_id", "text"))))
        few = named.join(repeated, "doc_id", "left_semi").withColumn("nth_", least).filter("nth_ = 1").drop("nth_")
        named = work_table(named.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(few.select(docs.columns)), "named")
    texts = named.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    signed = work_table(texts.mapInArrow(_signature_batches, _SIGNED), "signatures")
    heads = signed.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    classes = signed.join(heads.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "n", "short", "sketch", "keys")
    copies = signed.select("doc_id", "digest").join(heads.filter("copies > 1"), "digest").filter("doc_id <> node").select("doc_id")
    links = near_copy_links(classes, texts)
    if links is not None:
        copies = copies.unionByName(connected_components(links).filter("node <> root").select(F.col("node").alias("doc_id")))
    gone = work_table(copies, "copies")
    return named.join(gone, "doc_id", "left_anti").select(docs.columns).unionByName(docs.filter("doc_id IS NULL"))
