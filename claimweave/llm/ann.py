"""Approximate nearest neighbours by stable projections and a kd-tree, with a chi-square stopping test.

Vectors are scaled to length 1, where the order of Euclidean distances is that of cosines, and
projected on M Gaussian (2-stable) directions. For two vectors at distance d the squared projected
distance over d^2 follows the chi-square law with M degrees of freedom. So once the k-th best verified
distance is d_k, a vector that is nearer than that lies within ``d_k * sqrt(quantile(P))`` in the
projection with probability P, and the search along growing projected distance may stop there.

The kd-tree is over the projections. Its first levels are fitted to a bounded sample; leaves that hold more
than two blocks are cut again on their widest axis at quantiles of all their points, level by level, so the
tree grows with the data and no leaf is cut by anything but an axis. Of equal vectors the k + 1 smallest
vec_ids are candidates, and equal queries are asked once, so copies crowd no leaf. A query first searches its own
leaf, which bounds d_k, and then goes only to the leaves whose boxes reach into that radius, as (query, leaf,
bound). Leaves stream: a task holds one leaf and one batch of queries at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import work_table

M = 8
P = 0.9
SEED = 20240607
#: Rows of a leaf, on average.
BLOCK = 2048
#: Rows to which the first levels of the tree are fitted, and leaves these have at most.
SAMPLE = 1 << 15
TOP_LEAVES = 1 << 12
#: Pieces into which a leaf is cut at a further level, and such levels at most (16^12 leaves for each of the top).
PIECES, MAX_LEVELS = 16, 12
#: Leaves with cuts that are broadcast at most, and bytes of query vectors.
BROADCAST_LEAVES, BROADCAST_BYTES = 1 << 16, 64 << 20
#: Neighbours that are verified at once, and queries of a leaf that are searched together.
STEP, TOGETHER = 128, 128
#: Rounding of squared projected distances: equal vectors may be projected to points this far apart.
MARGIN = 1e-12


def chi_square_quantile(p: float, m: int = M) -> float:
    """Quantile of the chi-square law with an even number of degrees of freedom, by bisection."""
    if m % 2:
        raise ValueError("an even number of projections is needed")

    def cdf(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def directions(dim: int, m: int = M) -> np.ndarray:
    """The Gaussian directions, the same for each run."""
    return np.random.default_rng(SEED).standard_normal((dim, m))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_cuts(sample: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """Cuts ``(axis, value)`` of a kd-tree in heap order: at the median of the widest side.

    A node without spread gets a cut that sends everything left.
    """
    depth = max(0, math.ceil(math.log2(max(1, leaves))))
    parts, cuts = [sample], []
    for _ in range(depth):
        below = []
        for own in parts:
            spread = np.ptp(own, axis=0) if len(own) else np.zeros(sample.shape[1])
            axis = int(np.argmax(spread))
            value = float(np.median(own[:, axis])) if spread[axis] > 0 else math.inf
            cuts.append((axis, value))
            left = own[:, axis] <= value
            below += [own[left], own[~left]]
        parts = below
    return cuts


def leaf_of(points: np.ndarray, cuts: list[tuple[int, float]]) -> np.ndarray:
    """Leaf number of each point."""
    node = np.zeros(len(points), dtype=np.int64)
    axis = np.array([a for a, _ in cuts], dtype=np.int64)
    value = np.array([v for _, v in cuts])
    rows = np.arange(len(points))
    for _ in range((len(cuts) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[rows, axis[node]] > value[node])
    return node - len(cuts)


def _radius(bound, reach: float):
    """Squared projected distance up to which the stopping test goes on, with room for rounding.

    A bound comes from ``2 - 2 * cosine`` and is itself off by some 1e-15.
    """
    return (bound + MARGIN) * reach + MARGIN


class Leaf:
    """The vectors of a leaf of the tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, directions_: np.ndarray):
        self.ids, self.vectors, self.units = ids, vectors, _unit(vectors)
        self.points, self.norms = self.units @ directions_, np.sqrt((vectors * vectors).sum(axis=1))

    def search(self, vectors: np.ndarray, points: np.ndarray, k: int, reach: float, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best ``(query number, vec_id, cosine)`` found, ``k`` a query at most; ``bounds`` are squared k-th distances known before.

        Neighbours in the projection are verified STEP at a time, nearest first, until the next one is
        farther than the stopping test allows. Scores come from the original vectors, each row on its
        own, so that ties are ties.
        """
        n, bounds = len(vectors), bounds.copy()
        away = ((points[:, None, :] - self.points[None]) ** 2).sum(axis=2)
        order = np.argsort(away, axis=1, kind="stable")
        away = np.take_along_axis(away, order, axis=1)
        units, norms = _unit(vectors), np.sqrt((vectors * vectors).sum(axis=1))
        best, best_ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        for at in range(0, len(self.ids), STEP):
            open_ = np.nonzero(away[:, at] <= _radius(bounds, reach))[0]
            if not len(open_):
                break  # the stopping test: nearer vectors would have shown up by now
            rows = order[open_, at : at + STEP]
            rough = 2 - 2 * np.einsum("qsd,qd->qs", self.units[rows], units[open_])
            q, nth = np.nonzero(rough <= (bounds[open_] * (1 + 1e-9) + 1e-9)[:, None])
            row, own = rows[q, nth], open_[q]
            scores, ids = np.full(rough.shape, -np.inf), np.full(rough.shape, np.iinfo(np.int64).max)
            scores[q, nth] = (self.vectors[row] * vectors[own]).sum(axis=1) / (self.norms[row] * norms[own])
            ids[q, nth] = self.ids[row]
            scores, ids = np.concatenate([best[open_], scores], axis=1), np.concatenate([best_ids[open_], ids], axis=1)
            by_id = np.argsort(ids, axis=1, kind="stable")
            scores, ids = np.take_along_axis(scores, by_id, axis=1), np.take_along_axis(ids, by_id, axis=1)
            first = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            best[open_], best_ids[open_] = np.take_along_axis(scores, first, axis=1), np.take_along_axis(ids, first, axis=1)
            worst = best[open_, k - 1]
            bounds[open_] = np.where(worst > -np.inf, np.minimum(bounds[open_], np.maximum(0.0, 2 - 2 * worst)), bounds[open_])
        q, nth = np.nonzero(best > -np.inf)
        return q, best_ids[q, nth], best[q, nth]


_FOUND = "query_id long, vec_id long, score double"


def _search_batches(dim: int, k: int, reach: float, shared):
    """Rows come sorted by (leaf, is_query): a leaf's vectors, then the queries that visit it.

    Queries have their vectors with them, or in ``shared``: sorted ids and a matrix.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, leaf = None, [], None
        r = directions(dim)
        for batch in batches:
            where = batch.column("leaf").to_numpy()
            is_query = batch.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
            ids, bound = batch.column("vec_id").to_numpy(), batch.column("bound").to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.nonzero((np.diff(where) != 0) | (np.diff(is_query.astype(int)) != 0))[0] + 1, [len(where)]])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi == lo:
                    continue
                if where[lo] != held:
                    held, parts, leaf = where[lo], [], None
                if not is_query[lo]:
                    parts.append((ids[lo:hi].copy(), _matrix(batch.column("embedding").slice(lo, hi - lo), dim).copy()))
                    continue
                if not parts:
                    continue
                if leaf is None:
                    leaf = Leaf(np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts]), r)
                for at in range(lo, hi, TOGETHER):
                    to = min(hi, at + TOGETHER)
                    if shared is None:
                        vectors = _matrix(batch.column("embedding").slice(at, to - at), dim)
                    else:
                        vectors = shared.value[1][np.searchsorted(shared.value[0], ids[at:to])]
                    q, v, score = leaf.search(vectors, _unit(vectors) @ r, k, reach, bound[at:to])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at:to][q]), pa.array(v), pa.array(score)], names=["query_id", "vec_id", "score"])

    return search


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` with doubles: not null, not zero, all components finite."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    named = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
    return named.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))


def _place_batches(dim: int, cuts: list[tuple[int, float]]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = directions(dim)
        for batch in batches:
            projected = _unit(_matrix(batch.column("embedding"), dim)) @ r if batch.num_rows else np.zeros((0, M))
            point = pa.ListArray.from_arrays(pa.array(np.arange(0, batch.num_rows * M + 1, M), pa.int32()), pa.array(projected.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf_of(projected, cuts)), point], names=[*batch.schema.names, "leaf", "point"])

    return place


class Tree:
    """The cuts of all levels: those of the top in heap order, and a table ``(leaf, axis, cuts)`` for each further level."""

    def __init__(self, dim: int, top: list[tuple[int, float]]):
        self.dim, self.top, self.levels = dim, top, []

    def place(self, vectors: DataFrame) -> DataFrame:
        """``vectors``, of which ``embedding`` is a column, with ``leaf`` and ``point``."""
        placed = vectors.mapInArrow(_place_batches(self.dim, self.top), f"{', '.join(f'{n} {t}' for n, t in vectors.dtypes)}, leaf long, point array<double>")
        return reduce(self._cut, self.levels, placed)

    @staticmethod
    def _cut(placed: DataFrame, level: tuple[DataFrame, int]) -> DataFrame:
        cuts, n = level
        value = F.get("point", F.col("axis"))
        piece = F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda c: c < value)))
        joined = placed.join(F.broadcast(cuts) if n <= BROADCAST_LEAVES else cuts, "leaf", "left")
        return joined.withColumn("leaf", F.col("leaf") * PIECES + piece).select(placed.columns)

    def grow(self, vectors: DataFrame) -> DataFrame:
        """Cut leaves of more than two blocks until there are none; returns each leaf's ``(leaf, n, box)``."""
        for _ in range(MAX_LEVELS + 1):
            placed = self.place(vectors)
            sides = [f(F.get("point", F.lit(i))).alias(f"{name}{i}") for i in range(M) for name, f in (("low", F.min), ("high", F.max))]
            boxes = work_table(placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *sides), "boxes")
            widths = [F.col(f"high{i}") - F.col(f"low{i}") for i in range(M)]
            widest = F.greatest(*widths)
            axis = F.coalesce(*(F.when(w == widest, i) for i, w in enumerate(widths)))
            large = boxes.filter((F.col("n") > 2 * BLOCK) & (widest > 0)).select("leaf", axis.alias("axis"))
            n = large.count() if len(self.levels) < MAX_LEVELS else 0
            if not n:
                break
            inside = placed.join(F.broadcast(large) if n <= BROADCAST_LEAVES else large, "leaf")
            quantiles = F.percentile_approx(F.get("point", F.col("axis")), F.array(*(F.lit(i / PIECES) for i in range(1, PIECES))), 1000)
            self.levels.append((work_table(inside.groupBy("leaf", "axis").agg(quantiles.alias("cuts")), "cuts"), n))
        return boxes


def _visit_batches(shared, reach: float):
    """For each query the leaves, other than its own, whose boxes reach into its radius."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, low, high = shared.value
        for batch in batches:
            points, own = _matrix(batch.column("point"), M), batch.column("leaf").to_numpy()
            ids, bound = batch.column("vec_id").to_numpy(), batch.column("bound").to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows):  # one query against all boxes
                gap = np.maximum(low - points[at], 0) + np.maximum(points[at] - high, 0)
                found = leaf[(gap * gap).sum(axis=1) <= _radius(bound[at], reach)]
                found = found[found != own[at]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), ids[at])), pa.array(found), pa.array(np.full(len(found), bound[at]))], names=["vec_id", "leaf", "bound"])

    return visit


def nearest(embeddings: DataFrame, is_query, k: int = 5, p: float = P) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each row that is a query.

    ``is_query`` is a condition on ``vec_id``; all other rows with usable vectors are candidates. Between
    vectors of different lengths there is no cosine: each length is searched by itself. Ties of score go
    to the smaller vec_id; rows that repeat a vec_id are one candidate, never of themselves, and the least
    of their longest vectors counts. A query with fewer candidates gets them all. No rows give none.
    """
    spark = embeddings.sparkSession
    vectors = usable_vectors(embeddings)
    if not vectors.groupBy("vec_id").count().filter("count > 1").isEmpty():
        least = F.min(F.struct(-F.size("embedding"), "embedding"))
        vectors = work_table(vectors.groupBy("vec_id").agg(least.alias("x")).select("vec_id", "x.embedding"), "once")
    lengths = vectors.groupBy(F.size("embedding").alias("dim")).count().filter("count > 1").orderBy("dim").collect()  # a row for each length
    found = [_nearest(vectors.filter(F.size("embedding") == r["dim"]), r["dim"], r["count"], is_query, k, p) for r in lengths]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _nearest(vectors: DataFrame, dim: int, n: int, is_query, k: int, p: float) -> DataFrame:
    """:func:`nearest` for ``n`` vectors of one length, each vec_id once."""
    spark, reach = vectors.sparkSession, chi_square_quantile(p)
    # of equal vectors only k + 1 can be anybody's neighbours; Spark limits each group before the shuffle
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    candidates = work_table(vectors.withColumn("nth", nth).filter(F.col("nth") <= k + 1).drop("nth"), "candidates")
    asked = work_table(vectors.filter(is_query), "asked")
    queries = work_table(asked.groupBy("embedding").agg(F.min("vec_id").alias("vec_id")), "queries")  # equal ones are asked once
    n_queries = queries.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = max(1, n // SAMPLE)
    sample = candidates.filter(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).limit(2 * SAMPLE)  # only where to cut hangs on it
    sampled = _matrix(sample.select("embedding").toArrow().column("embedding").combine_chunks(), dim)
    tree = Tree(dim, fit_cuts(_unit(sampled) @ directions(dim) if len(sampled) else np.zeros((0, M)), min(TOP_LEAVES, max(1, n // BLOCK))))
    boxes = tree.grow(candidates).toArrow()  # 18 numbers for each BLOCK vectors
    low, high = (np.stack([boxes.column(f"{side}{i}").to_numpy() for i in range(M)], axis=1) for side in ("low", "high"))
    shared_boxes = spark.sparkContext.broadcast((boxes.column("leaf").to_numpy(), low, high))
    rows = tree.place(candidates).select("leaf", F.lit(False).alias("is_query"), "vec_id", "embedding", F.lit(float("inf")).alias("bound"))
    placed = work_table(tree.place(queries.select("vec_id", "embedding")), "placed")
    shared = None
    if n_queries * dim * 8 <= BROADCAST_BYTES:
        got = placed.select("vec_id", "embedding").orderBy("vec_id").toArrow()
        shared = spark.sparkContext.broadcast((got.column("vec_id").to_numpy(), _matrix(got.column("embedding").combine_chunks(), dim)))

    def searched(visits: DataFrame) -> DataFrame:
        if shared is None:
            visits = visits.join(placed.select("vec_id", "embedding"), "vec_id")
        else:
            visits = visits.withColumn("embedding", F.lit(None).cast("array<double>"))
        both = rows.unionByName(visits.select("leaf", F.lit(True).alias("is_query"), "vec_id", "embedding", "bound"))
        return both.repartition("leaf").sortWithinPartitions("leaf", "is_query", "vec_id").mapInArrow(_search_batches(dim, k + 1, reach, shared), _FOUND)

    at_home = work_table(searched(placed.select("vec_id", "leaf", F.lit(float("inf")).alias("bound"))), "home")
    bounds = at_home.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
    bound = F.when(F.col("n") > k, F.greatest(F.lit(0.0), 2 - 2 * F.col("worst"))).otherwise(F.lit(float("inf")))
    bounded = placed.join(bounds, placed["vec_id"] == bounds["query_id"], "left").select("vec_id", "point", "leaf", F.coalesce(bound, F.lit(float("inf"))).alias("bound"))
    visits = bounded.mapInArrow(_visit_batches(shared_boxes, reach), "vec_id long, leaf long, bound double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = at_home.unionByName(searched(visits)).withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1)
    found = work_table(found.select(F.col("query_id").alias("class"), "vec_id", "score"), "found")
    members = asked.join(queries.withColumnRenamed("vec_id", "class"), "embedding").select(F.col("vec_id").alias("query_id"), "class")
    own = members.join(found, "class").filter("vec_id <> query_id")
    rank = F.row_number().over(best)
    return own.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
