"""Connected components over a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import work_table

#: Rounds after which something must be wrong; the alternation needs O(log^2 n).
MAX_ROUNDS = 60


def _with_least_neighbour(edges: DataFrame) -> DataFrame:
    """``(u, v)`` with ``m``, the least of u and all its v. The minimum is combined map-side."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least_neighbour(both).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _with_least_neighbour(down)
    moved = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(near.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of the links ``(a, b)``; root is the least node reachable.

    Alternates large-star and small-star steps until the edges no longer change. Each round is
    written to the shared folder, so that lineage stays short and a lost executor costs one round.
    Self-links are ignored; nodes without a link don't appear.
    """
    edges = work_table(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if (now.n, now.s) == mark:
            break
        mark = (now.n, now.s)
        edges = work_table(_small_star(_large_star(edges)), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
