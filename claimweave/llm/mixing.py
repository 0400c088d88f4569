"""Mixing sources to target weights by Poisson replication, with DataFrame expressions only.

A source with n rows and target share w gets the mean repetition rate ``w * total / n``. Each row's
number of copies is a Poisson variate with that mean, inverted from a uniform number that a seeded
hash of its key gives: the same row has the same copies in each run and on any cluster. Rows are
exploded by their counts and dealt out anew by a hash of (key, copy), which shuffles them globally
and spreads a hot source over all partitions. That is the only shuffle of the rows: the sources' rates
are broadcast while there are at most BROADCAST_SOURCES of them, and beyond that joined with salted keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import work_table

SEED = "mixing-1"
#: A larger mean is drawn as a sum of variates of at most this mean, so that exp(-mean) is exact enough.
MAX_MEAN = 16.0
#: Inversion stops here: the chance of more at mean MAX_MEAN is far below 2^-52, the uniform's step.
MAX_COUNT = 96
#: Sources whose rates (some 0.8 KB each) are broadcast at most.
BROADCAST_SOURCES = 10_000
#: Beyond that, the partitions over which the rows of one source are spread in the join.
SALTS = 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts: its first 52 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_bounds(mean: Column) -> Column:
    """Cumulative probabilities P(X <= k) for k from 0 to MAX_COUNT - 1."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.array_append(acc["c"], F.element_at(acc["c"], -1) + p).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_COUNT - 1)), start, step)["c"]


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None) -> DataFrame:
    """``(source, n, rate, draws, bounds)`` for each source of ``docs``.

    ``weights`` are relative; sources without one get zero copies; no weights mean equal shares of all
    sources that occur. ``total`` is the number of rows aimed at, by default as many as there are.
    Negative weights are refused. A null source is a source of its own, without a name to weigh.
    """
    if weights is not None and (any(w < 0 or not math.isfinite(w) for w in weights.values()) or sum(weights.values()) <= 0):
        raise ValueError("weights must be finite, not negative, and not all zero")
    counts = work_table(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "sources")
    if weights is None:
        weighed = counts.withColumn("weight", F.lit(1.0))
    else:
        known = [x for name, w in weights.items() for x in (F.lit(name), F.lit(float(w)))]
        weighed = counts.withColumn("weight", F.coalesce(F.get(F.transform(F.array(F.create_map(*known)), lambda m: m[F.coalesce("source", F.lit(""))]), 0), F.lit(0.0)))
    all_ = weighed.agg(F.sum("n").alias("rows"), F.sum("weight").alias("weight")).first()  # one row
    aim = float(total) if total is not None else float(all_["rows"] or 0)
    rated = weighed.withColumn("rate", F.col("weight") * F.lit(aim) / F.lit(float(all_["weight"] or 1)) / F.col("n"))
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_MEAN).cast("int"))
    return rated.withColumn("draws", draws).select("source", "n", "rate", "draws", poisson_bounds(F.col("rate") / F.col("draws")).alias("bounds"))


def copy_count(key: Column, seed: str = SEED) -> Column:
    """Poisson variate of a row with ``draws`` and ``bounds``: how many bounds its uniforms reach."""

    def one(acc: Column, i: Column) -> Column:
        u = uniform(F.lit(seed), key, i.cast("string"))
        return acc + F.size(F.filter("bounds", lambda c: c <= u))

    return F.aggregate(F.sequence(F.lit(1), F.col("draws")), F.lit(0), one)


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: str = SEED, partitions: int | None = None, broadcast_limit: int = BROADCAST_SOURCES) -> DataFrame:
    """``docs`` with each row repeated, plus ``mix_copy`` (from 0), ``mix_rate`` and ``mix_order``.

    Rows come in a global random order: by partition, then by ``mix_order`` inside it. A row's key is
    its doc_id (null: the empty key); rows that repeat a doc_id get the same count. Empty tables give
    none. The column names that this adds replace columns of the same names.
    """
    rates = source_rates(docs, weights, total).select(F.col("source").alias("mix_source"), F.col("rate").alias("mix_rate"), "draws", "bounds")
    own = [c for c in docs.columns if c not in ("mix_copy", "mix_rate", "mix_order", "mix_source", "mix_salt", "draws", "bounds")]
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    same = F.col("source").eqNullSafe(F.col("mix_source"))
    if rates.count() <= broadcast_limit:
        rated = docs.select(own).join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(F.lit("salt"), key), F.lit(SALTS)).cast("int")
        rated = docs.select(own).join(salted.hint("shuffle_merge"), same & (salt == F.col("mix_salt")))
    counted = rated.withColumn("mix_n", copy_count(key, seed)).filter("mix_n > 0").select(*own, "mix_rate", "mix_n")
    copies = counted.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_n") - 1))).drop("mix_n")
    ordered = copies.withColumn("mix_order", F.xxhash64(F.lit(seed), key, F.col("mix_copy")))
    dealt = ordered.repartition(partitions, "mix_order", "doc_id") if partitions else ordered.repartition("mix_order", "doc_id")
    return dealt.sortWithinPartitions("mix_order", "doc_id")
