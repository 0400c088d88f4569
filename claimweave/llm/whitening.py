"""Whitening of embeddings by a compensated covariance.

Vectors are coded as whole numbers, x = floor(64 * c) + 1000000, and each distinct vector is fitted once. Its mean
is the quotient of exact sums. Centred vectors are pairs of doubles (high and low part); their outer
products are summed without rounding: each vector is split into slices of so few bits that the matrix product of two
slices over a block of rows is exact, and the products of all slices that matter are added to a double-double accumulator
with an error-free sum (TwoSum). Tasks hand on high and low parts row by row of the matrix, and these are
merged in the same way. The covariance, rounded once, is small (its size is that of one vector squared); the driver solves
it with LAPACK's ``syevd``: reduction to tridiagonal form, then divide and conquer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import work_table

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Rows whose slices are multiplied at once, and bits of a slice: 2 * SLICE_BITS + log2(BLOCK) is at most 53.
BLOCK, SLICE_BITS = 1 << 10, 21
#: Slices of a centred vector: 63 bits.
SLICES = 3
#: Entries above this have no code: 64 * c would not be exact.
LARGEST = float(1 << 46)
#: Components whose eigenvalue is below this share of the largest are rounding errors: the data lie in fewer dimensions.
NO_VARIANCE = 1e-13


def codes(vector: str = "embedding") -> Column:
    """The whole numbers of a vector; null where it is null, empty or holds an entry that is null or not finite or has no code."""
    c = F.col(vector).cast("array<double>")
    sound = F.forall(c, lambda x: F.coalesce(F.abs(x) <= LARGEST, F.lit(False)))  # NaN is above all numbers
    coded = F.transform(c, lambda x: F.floor(x * F.lit(float(SCALE))).cast("long") + F.lit(OFFSET))
    return F.when(F.coalesce(sound & (F.size(c) > 0), F.lit(False)), coded)


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and what rounding took away."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add_double_double(high: np.ndarray, low: np.ndarray, more: np.ndarray, more_low: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    s, e = two_sum(high, more)
    t, f = two_sum(low, np.broadcast_to(more_low, low.shape))
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def _sliced(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Slices whose sum is ``high + low`` down to the last bits, each of SLICE_BITS bits of one grid."""
    out, top = [], np.abs(high).max(initial=0.0)
    bits = int(np.frexp(top)[1])
    for _ in range(SLICES):
        bits -= SLICE_BITS
        grid = np.ldexp(1.5, 52 + bits)  # adding it rounds to multiples of 2^bits
        part = (high + grid) - grid
        out.append(part)
        high, low = two_sum(high - part, low)
        bits -= 1  # rounding leaves at most half a grid's step
    return out


def outer_sums(high: np.ndarray, low: np.ndarray, total: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``total`` with the outer products of the rows ``high + low`` added."""
    for at in range(0, len(high), BLOCK):
        parts = _sliced(high[at : at + BLOCK], low[at : at + BLOCK])
        for i in range(SLICES):
            for j in range(SLICES - i):
                total = add_double_double(*total, parts[i].T @ parts[j])
    return total


@dataclass(frozen=True)
class Centre:
    """Number of distinct vectors, their exact sums, and the mean as pairs of doubles."""

    n: int
    sums: list[int]

    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        exact = [Fraction(s, self.n) for s in self.sums]
        high = [float(m) for m in exact]
        return np.array(high), np.array([float(m - Fraction(h)) for m, h in zip(exact, high)])

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of codes minus the mean, as pairs of doubles."""
        high, low = self.mean()
        s, e = two_sum(x.astype(np.float64), np.broadcast_to(-high, x.shape))  # codes are below 2^53
        return two_sum(s, e - low)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of vectors and sums of each place, high and low halves apart, a row for each length and place."""
    held: dict[int, list] = {}
    for batch in batches:
        lengths = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
        for dims in np.unique(lengths).tolist():
            x = _matrix(batch.column("x").filter(pa.array(lengths == dims)), dims)
            new = [len(x), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]
            old = held.get(dims, [0, 0, 0])
            held[dims] = [a + b for a, b in zip(old, new)]
    for dims, (n, upper, lower) in held.items():
        cols = [[dims] * dims, range(dims), [n] * dims, upper, lower]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["dims", "place", "n", "upper", "lower"])


def centres(distinct: DataFrame) -> dict[int, Centre]:
    """For each length of vectors their number and exact sums: a row a place comes to the driver."""
    parts = distinct.mapInArrow(_sum_batches, "dims long, place long, n long, upper long, lower long")
    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "upper", "lower")]
    out: dict[int, Centre] = {}
    for row in parts.groupBy("dims", "place").agg(*whole).orderBy("dims", "place").collect():
        out.setdefault(row.dims, Centre(int(row.n), [])).sums.append((int(row.upper) << 32) + int(row.lower))
    return out


def _products(dims: int, rows_of):
    """Sums of outer products of what ``rows_of`` makes of a batch's vectors, as matrix rows of high and low parts."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, k = None, 0
        for batch in batches:
            if batch.num_rows:
                high, low = rows_of(_matrix(batch.column("x"), dims))
                k = high.shape[1]
                total = outer_sums(high, low, total or (np.zeros((k, k)), np.zeros((k, k))))
        if total:
            rows = [pa.array(range(k), pa.int64()), *(pa.array(list(t), pa.list_(pa.float64())) for t in total)]
            yield pa.RecordBatch.from_arrays(rows, names=["place", "high", "low"])

    return sums


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each place of rows sorted by place; nothing but the current sums is held."""
    now, total = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), *(pa.array([t], pa.list_(pa.float64())) for t in total)], names=["place", "high", "low"])

    for batch in batches:
        highs, lows = (batch.column(c) for c in ("high", "low"))
        for i, place in enumerate(batch.column("place").to_pylist()):
            high, low = highs[i].values.to_numpy(), lows[i].values.to_numpy()
            if place != now:
                if total:
                    yield row()
                now, total = place, (np.zeros(len(high)), np.zeros(len(high)))
            total = add_double_double(*total, high, low)
    if total:
        yield row()


def second_moments(distinct: DataFrame, dims: int, rows_of) -> tuple[np.ndarray, np.ndarray]:
    """Sums of outer products over all vectors, merged in Spark; the finished matrix comes to the driver."""
    schema = "place long, high array<double>, low array<double>"
    parts = distinct.mapInArrow(_products(dims, rows_of), schema)
    found = parts.repartition("place").sortWithinPartitions("place").mapInArrow(_merged, schema).toArrow().sort_by("place")
    return tuple(np.array(found.column(c).to_pylist()).reshape(found.num_rows, -1) for c in ("high", "low"))


@dataclass(frozen=True)
class Whitening:
    """Eigenvectors (columns) and eigenvalues of the codes' covariance, by falling eigenvalue."""

    centre: Centre
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        high, low = self.centre.centred(x)
        scaled = self.vectors / np.sqrt(self.values)
        return high @ scaled + low @ scaled

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sum over places of (n * x - sum)^2 of each row."""
        n, sums = self.centre.n, self.centre.sums
        reach = max(max(abs(n * int(v) - s) for v, s in zip(edge, sums)) for edge in (x.min(axis=0), x.max(axis=0)))
        if max(map(abs, sums)) + reach < 1 << 62 and x.shape[1] * reach * reach < 1 << 63:
            off = n * x - np.array(sums, dtype=np.int64)
            return (off * off).sum(axis=1).tolist()
        off = x.astype(object) * n - np.array(sums, dtype=object)
        return (off * off).sum(axis=1).tolist()


def solve(covariance: np.ndarray, centre: Centre, components: int = COMPONENTS) -> Whitening:
    """The leading components; those without variance are left out. The largest entry of each eigenvector is positive."""
    values, vectors = np.linalg.eigh(covariance)  # syevd: tridiagonal divide and conquer
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > NO_VARIANCE * max(values[0], 0.0)).sum()))
    vectors = vectors[:, :k] * np.sign(vectors[np.abs(vectors[:, :k]).argmax(axis=0), range(k)])
    return Whitening(centre, vectors, values[:k], float(np.trace(covariance)))


def fit(distinct: DataFrame, dims: int, centre: Centre, components: int = COMPONENTS) -> Whitening:
    """Whitening of the distinct code vectors ``x`` of one length."""
    high, low = second_moments(distinct, dims, centre.centred)
    covariance = (high + low) / centre.n
    return solve((covariance + covariance.T) / 2, centre, components)


def identity_error(distinct: DataFrame, dims: int, fitted: Whitening) -> float:
    """How far the covariance of the whitened distinct vectors is from the identity, as its largest entry."""
    k = len(fitted.values)
    if not k:
        return 0.0

    def with_one(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = np.concatenate([fitted.whiten(x), np.ones((len(x), 1))], axis=1)  # its products with the ones are the sums
        return w, np.zeros_like(w)

    high, low = second_moments(distinct, dims, with_one)
    moments = (high + low) / fitted.centre.n
    mean = moments[k, :k]
    return float(np.abs(moments[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def _whiten_batches(dims: int, fitted: Whitening):
    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"), dims)
                off = pa.array([Decimal(d) for d in fitted.deviations(x)], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), off, pa.array(list(fitted.whiten(x)), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

    return whiten


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row for each vector and component.

    ``vectors``: ``vec_id`` and ``embedding``, other columns are not read. Dropped are rows whose vector is null or empty or holds
    an entry that is null, not finite or beyond 2^46 (no exact code). Vectors of each length are fitted by themselves.
    Repeated rows come out repeatedly, though a vector is fitted once; a null vec_id stays null. Components
    without variance (a single distinct vector has no other) give no rows, nor does an empty table.
    ``deviation`` is a decimal, exact up to 38 digits.
    """
    coded = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), codes().alias("x")).filter("x IS NOT NULL")
    distinct = work_table(coded.select("x").distinct(), "whitening")
    out = None
    for dims, centre in sorted(centres(distinct).items()):
        own = distinct.filter(F.size("x") == dims)
        fitted = fit(own, dims, centre, components)
        error = identity_error(own, dims, fitted)
        rows = coded.filter(F.size("x") == dims).mapInArrow(_whiten_batches(dims, fitted), "vec_id long, deviation decimal(38,0), whitened array<double>")
        exploded = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
        shares = F.array(*(F.lit(float(v / fitted.trace)) for v in fitted.values)) if len(fitted.values) else F.array().cast("array<double>")
        found = exploded.select(
            "vec_id",
            (F.col("at") + 1).cast("int").alias("component"),
            F.lit(centre.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.get(shares, F.col("at")).alias("explained"),
            F.lit(error).alias("identity_error"),
        )
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    return out
