"""Nearest vectors for many queries at once: blocks of queries meet parts of the points in cells.

A cell holds at most some thousand queries and streams its points; products of slices come from BLAS in double precision, and
whatever comes near a query's k-th score is scored again term by term, so that equal vectors score alike and ties go by the key.
A cell hands on ``k`` points a query. The driver sees no vectors, and no pair is a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Queries of a block and points of a part, on average; points that are multiplied at once.
BLOCK, PART, SLICE = 4096, 1 << 15, 1024
#: More than a product in double precision can be off.
MARGIN = 1e-9
#: Pairs that are scored term by term at once.
PAIRS = 1 << 16


def sound(vector: Column) -> Column:
    """Whether a vector has a direction: not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, added term by term as Spark's ``aggregate`` does."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


class _Cell:
    def __init__(self, k: int):
        self.k, self.ids, self.vectors, self.best = k, [], [], None

    def ask(self, rows: pa.RecordBatch) -> None:
        self.ids.append(rows.column("query_id"))
        self.vectors.append(_matrix(rows.column("vector")))

    def begin(self) -> None:
        self.q = np.concatenate(self.vectors)
        self.length = np.sqrt(_dots(self.q, self.q))
        self.unit = self.q / self.length[:, None]
        self.least = np.full(len(self.q), -np.inf)

    def meet(self, rows: pa.RecordBatch) -> None:
        if not self.ids:
            return
        if self.best is None:
            self.begin()
        p = _matrix(rows.column("vector"))
        length = np.sqrt(_dots(p, p))
        close = self.unit @ (p / length[:, None]).T
        bound, fresh = self.least.copy(), np.isneginf(self.least)
        if len(p) > self.k and fresh.any():
            bound[fresh] = np.partition(close[fresh], len(p) - self.k, axis=1)[:, len(p) - self.k]
        at, to = np.nonzero(close >= bound[:, None] - MARGIN)
        if not len(at):
            return
        score = np.concatenate([_dots(self.q[at[i : i + PAIRS]], p[to[i : i + PAIRS]]) for i in range(0, len(at), PAIRS)]) / (length[to] * self.length[at])
        new = pa.table({"at": pa.array(at), "score": pa.array(score), "key": rows.column("key").take(pa.array(to)), "row": rows.column("row").take(pa.array(to))})
        held = pa.concat_tables([self.best, new]) if self.best is not None else new
        held = held.take(pc.sort_indices(held, sort_keys=[("at", "ascending"), ("score", "descending"), ("key", "ascending")]))
        of = held.column("at").to_numpy()
        starts = np.nonzero(np.concatenate([[True], of[1:] != of[:-1]]))[0]
        nth = np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of))))
        self.best = held.filter(pa.array(nth < self.k)).combine_chunks()
        last = nth == self.k - 1
        self.least[of[last]] = held.column("score").to_numpy()[last]

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.best is not None:
            ids = pa.concat_arrays(self.ids).take(self.best.column("at").combine_chunks())
            out = pa.table({"query_id": ids, "score": self.best.column("score"), "row": self.best.column("row")})
            yield from out.to_batches()


def _cells(k: int):
    """Rows come sorted by (cell, asked): a cell's queries, which have ``asked`` 0, before its points."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, now = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names, asked = batch.column("cell").to_pylist(), batch.column("asked").to_numpy()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1] or asked[i] != asked[i - 1]), len(names)]
            for lo, hi in zip(cuts, cuts[1:]):
                if names[lo] != cell:
                    if now is not None:
                        yield from now.found()
                    cell, now = names[lo], _Cell(k)
                if asked[lo] == 0:
                    now.ask(batch.slice(lo, hi - lo))
                else:
                    for i in range(lo, hi, SLICE):
                        now.meet(batch.slice(i, min(SLICE, hi - i)))
        if now is not None:
            yield from now.found()

    return cells


def grid_topk(points: DataFrame, queries: DataFrame, k: int, key: str, by: list[str]) -> DataFrame:
    """The ``k`` points nearest to each query of the same ``by`` and length, by cosine; ties go to the smaller key.

    Vectors without a direction take no part. A cell's points are read as often as there are blocks of its group's queries, and the
    other way round; both numbers follow from counts of the groups, which stay in Spark.
    """
    group = [*(f"by_{i}" for i in range(len(by))), "dims"]
    named = lambda df, vector: df.filter(sound(F.col(vector))).withColumns({**{f"by_{i}": F.col(b) for i, b in enumerate(by)}, "dims": F.size(vector)})
    p, q = named(points, "vector"), named(queries, "q_vector")
    kind = points.schema["vector"].dataType
    if kind != queries.schema["q_vector"].dataType:
        p, q, kind = p.withColumn("vector", F.col("vector").cast("array<double>")), q.withColumn("q_vector", F.col("q_vector").cast("array<double>")), "array<double>"
    sizes = p.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts")).join(q.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), group)
    other = [c for c in points.columns if c != "vector"]
    cell = F.concat_ws("|", *(F.col(c).cast("string") for c in group), "block", "part").alias("cell")
    dealt = lambda df, of, n: df.withColumn(of, F.pmod(F.xxhash64(*df.columns), F.col(n)))
    own_id, own_key, row = queries.schema["query_id"].dataType, points.schema[key].dataType, F.struct(*other)
    asks = dealt(q.join(sizes, group), "block", "blocks").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    asks = asks.select(cell, F.lit(0).alias("asked"), "query_id", F.col("q_vector").alias("vector"), F.lit(None).cast(own_key).alias("key"), F.lit(None).cast(StructType([points.schema[c] for c in other])).alias("row"))
    meets = dealt(p.join(sizes, group), "part", "parts").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    meets = meets.select(cell, F.lit(1).alias("asked"), F.lit(None).cast(own_id).alias("query_id"), "vector", F.col(key).alias("key"), row.alias("row"))
    both = asks.unionByName(meets)
    schema = StructType().add("query_id", own_id).add("score", "double").add("row", both.schema["row"].dataType)
    found = both.repartition("cell").sortWithinPartitions("cell", "asked").mapInArrow(_cells(k), schema)
    rows = found.select("query_id", "score", "row.*")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
