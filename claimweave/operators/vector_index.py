"""A block index of vectors, with bounds that keep searches exact.

Vectors are dealt to the nearest of some hundred centres by angle; each block knows the largest angle to its centre.
A search visits a query's nearest blocks first. The k-th score found there rules out every block whose nearest
conceivable member is worse; the others are visited, too. Blocks and queries meet in equi-joins only; large blocks are dealt in
parts, so that a block of copies is no single task's. How many rows a search visits depends on how well the data cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.functions.vectors import dot

#: Vectors that the centres are fitted to, those of the smallest hashes; rounds of k-means.
SAMPLE, ROUNDS = 20_000, 8
#: Most blocks, and rows of a part of a block.
MOST_BLOCKS, PART_ROWS = 1024, 1 << 16
#: Blocks that a query visits first.
FIRST = 4
#: What rounding may add to a bound.
MARGIN = 1e-6


def _length(vector: str) -> Column:
    return F.sqrt(dot(F.col(vector), F.col(vector)))


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def _nearest(vectors: pd.Series, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block and angle of each vector; -1 for those that have no direction, or another length."""
    dims = centres.shape[1]
    fit = np.array([v is not None and len(v) == dims for v in vectors])
    block, angle = np.full(len(fit), -1), np.zeros(len(fit))
    if fit.any():
        v = np.array([np.asarray(x, dtype=np.float64) for x in vectors[fit]])
        norm = np.linalg.norm(v, axis=1)
        sound = np.isfinite(norm) & (norm > 0)
        close = _units(np.where(sound[:, None], v, 1.0)) @ centres.T
        at = close.argmax(axis=1)
        where = np.nonzero(fit)[0]
        block[where] = np.where(sound, at, -1)
        angle[where] = np.arccos(np.clip(close[np.arange(len(at)), at], -1, 1))
    return block, angle


@dataclass(frozen=True)
class VectorIndex:
    """``points`` with ``block`` and ``part``; the blocks' centres, largest angles and numbers of parts."""

    points: DataFrame
    centres: np.ndarray
    angles: np.ndarray
    parts: np.ndarray
    key: str

    @classmethod
    def build(cls, points: DataFrame, key: str = "claim_id", blocks: int | None = None, path: str | None = None) -> VectorIndex:
        """Deal points ``(key, vector, …)`` to blocks (about the root of their number); with a ``path`` they are written by block.

        Points without a direction (null, zero) are left out: they have no cosine.
        """
        found = points.filter("vector IS NOT NULL").select("vector", F.xxhash64(key).alias("h")).orderBy("h").limit(SAMPLE).toPandas()
        counts = points.count()
        longest = found["vector"].map(len).mode() if len(found) else pd.Series([1])
        sample = np.array([np.asarray(v, dtype=np.float64) for v in found["vector"] if len(v) == longest.iloc[0]]) if len(found) else np.ones((1, 1))
        sample = sample[np.isfinite(sample).all(axis=1) & (np.abs(sample).sum(axis=1) > 0)]
        centres = _fitted(_units(sample) if len(sample) else np.ones((1, int(longest.iloc[0]))), blocks or min(MOST_BLOCKS, max(1, int(counts**0.5))))

        @F.pandas_udf("block int, angle double")
        def place(vectors: pd.Series) -> pd.DataFrame:
            block, angle = _nearest(vectors, centres)
            return pd.DataFrame({"block": block.astype(np.int32), "angle": angle})

        placed = points.withColumn("_at", place("vector")).select(*points.columns, "_at.block", "_at.angle", _length("vector").alias("length")).filter("block >= 0")
        if path:
            placed.write.mode("overwrite").partitionBy("block").parquet(path)
            placed = points.sparkSession.read.schema(placed.schema).parquet(path)
        angles, rows = np.zeros(len(centres)), np.zeros(len(centres), dtype=np.int64)
        for r in placed.groupBy("block").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")).collect():  # MOST_BLOCKS rows at most
            angles[r.block], rows[r.block] = r.angle, r.n
        parts = -(-rows // PART_ROWS)
        index = cls(placed, centres, angles, parts, key)
        if path:
            index._save(points.sparkSession, f"{path}/_centres")
        return index

    def _save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, c.tolist(), float(a), int(p)) for i, (c, a, p) in enumerate(zip(self.centres, self.angles, self.parts))]
        spark.createDataFrame(rows, "block int, centre array<double>, angle double, parts long").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, key: str = "claim_id") -> VectorIndex:
        """An index that :meth:`build` wrote."""
        rows = spark.read.parquet(f"{path}/_centres").orderBy("block").collect()
        return cls(spark.read.parquet(path), np.array([r.centre for r in rows]), np.array([r.angle for r in rows]), np.array([r.parts for r in rows]), key)

    def _visits(self, queries: DataFrame) -> DataFrame:
        """``(query_id, q_vector, block, part)``: the FIRST nearest blocks where ``least`` is null, else the others that may hold as good a score."""
        centres, angles, parts = self.centres, self.angles, self.parts

        @F.pandas_udf("array<struct<block:int,part:int>>")
        def blocks(vectors: pd.Series, least: pd.Series) -> pd.Series:
            out = []
            for v, bound in zip(vectors, least):
                v = np.asarray(v if v is not None else [], dtype=np.float64)
                if len(v) != centres.shape[1] or not np.isfinite(v).all() or not np.any(v):
                    out.append([])
                    continue
                close = centres @ (v / np.linalg.norm(v))
                away = np.maximum(np.arccos(np.clip(close, -1, 1)) - angles, 0)
                order = np.argsort(-np.where(parts > 0, close, -np.inf), kind="stable")
                chosen = order[:FIRST] if np.isnan(bound) else np.array([b for b in order[FIRST:] if np.cos(away[b]) >= bound - MARGIN], dtype=int)
                out.append([{"block": int(b), "part": p} for b in chosen for p in range(parts[b])])
            return pd.Series(out)

        found = queries.withColumn("_to", F.explode(blocks("q_vector", F.col("least").cast("double"))))
        return found.select("query_id", "q_vector", _length("q_vector").alias("q_length"), "_to.*")

    def _scored(self, visits: DataFrame) -> DataFrame:
        sizes = F.create_map(*[F.lit(x) for b, p in enumerate(self.parts.tolist()) if p > 1 for x in (b, p)]) if (self.parts > 1).any() else None
        part = F.lit(0) if sizes is None else F.coalesce(F.pmod(F.xxhash64(self.key), sizes[F.col("block")]), F.lit(0)).cast("int")
        pairs = self.points.withColumn("part", part).join(visits, ["block", "part"])
        score = dot(F.col("vector"), F.col("q_vector")) / (F.col("length") * F.col("q_length"))
        return pairs.withColumn("score", score).drop("q_vector", "vector", "block", "part", "angle", "length", "q_length")

    def _best(self, scored: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), self.key)
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The ``k`` points nearest to each query ``(query_id, q_vector)`` by cosine, exactly; ties go to the smaller key."""
        asked = queries.select("query_id", "q_vector")
        first = self._best(self._scored(self._visits(asked.withColumn("least", F.lit(None)))), k)
        enough = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("least"))
        rest = self._visits(asked.join(enough, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0))))
        return self._best(first.drop("rank").unionByName(self._scored(rest)), k)

    def visited(self, queries: DataFrame, k: int = 10) -> int:
        """How many (query, point) pairs a search scores."""
        asked = queries.select("query_id", "q_vector")
        visits = self._visits(asked.withColumn("least", F.lit(None)))
        first = self._best(self._scored(visits), k)
        enough = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("least"))
        rest = self._visits(asked.join(enough, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0))))
        return self._scored(visits).count() + self._scored(rest).count()


def _fitted(sample: np.ndarray, blocks: int) -> np.ndarray:
    """Unit centres by spherical k-means from a seeded start; a centre that loses all its vectors stays where it is."""
    rng = np.random.default_rng(17)
    centres = sample[rng.choice(len(sample), min(blocks, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        at = np.concatenate([(sample[i : i + 2048] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        lost = np.linalg.norm(sums, axis=1) < 1e-12
        centres = np.where(lost[:, None], centres, _units(sums))
    return centres
